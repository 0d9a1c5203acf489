"""Reading named tables, seeds and literal relations; keeping versioned tables."""
