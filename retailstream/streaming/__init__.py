"""Sinks and the continuous jobs."""
