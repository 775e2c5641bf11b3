"""Plans of the tracking engine."""
