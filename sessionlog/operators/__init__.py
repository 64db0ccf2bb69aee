"""Joins, windows and aggregates over session logs."""
