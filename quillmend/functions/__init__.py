"""Column functions and parameter helpers."""
