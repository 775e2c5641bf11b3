"""Streaming of the tracking engine."""
