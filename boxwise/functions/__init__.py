"""Column functions: geometry, hashing, labels and risk."""
