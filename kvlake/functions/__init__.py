"""Column functions on keys and visibility."""
