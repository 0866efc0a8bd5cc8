"""functions of vexel."""
