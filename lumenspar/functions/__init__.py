"""Column functions: vector algebra, distances, geometry, quantization and fuzzy logic."""
