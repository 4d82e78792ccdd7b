"""Column functions: strings and geometry."""
