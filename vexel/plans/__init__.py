"""plans of vexel."""
