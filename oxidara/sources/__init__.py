"""Readers, sinks and the store between steps."""
