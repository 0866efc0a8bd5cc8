"""sources of vexel."""
