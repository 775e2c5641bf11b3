"""Operators over detection and track tables."""
