"""Column builders for pitch sequences."""
