"""operators of vexel."""
