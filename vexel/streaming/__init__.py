"""streaming of vexel."""
