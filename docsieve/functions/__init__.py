"""Column functions and their plain-Python counterparts for single strings."""
