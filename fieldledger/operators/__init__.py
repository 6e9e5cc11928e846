"""Ways to combine, check and order record tables."""
