"""Column functions: the statistics catalogue and scalar helpers."""
