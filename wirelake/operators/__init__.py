"""DataFrame operators over packet tables."""
