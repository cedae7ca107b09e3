"""Column functions: URLs, scalars, gates."""
