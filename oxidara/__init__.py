"""Condition analytics over inspection histories, on Spark."""
