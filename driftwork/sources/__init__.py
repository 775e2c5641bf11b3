"""Sources of the tracking engine."""
