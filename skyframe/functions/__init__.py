"""Column builders and NumPy kernels."""
