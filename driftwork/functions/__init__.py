"""Functions of the tracking engine."""
