"""Column-level helpers: byte access, protocol fields, formatting."""
