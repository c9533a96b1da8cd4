"""Column functions: strict JSON parsing, JSON paths, Python-compatible text size."""
