"""Column functions and the skew-safe building blocks the operators share."""
