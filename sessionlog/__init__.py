"""Batch jobs over coding-agent session logs."""
