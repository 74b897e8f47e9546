"""Column functions: text, durations, numbers."""
