"""Column functions on paths, names and events."""
