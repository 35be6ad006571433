"""Special functions."""
