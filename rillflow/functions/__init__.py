"""Column functions: output records and smoothing."""
