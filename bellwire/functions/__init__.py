"""Column-level functions: time zones, text, numbers, vectors."""
