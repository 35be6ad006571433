"""Dataframe operators of the analytics."""
