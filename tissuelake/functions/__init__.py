"""Column expressions that Catalyst sees, and the NumPy kernels that it can't."""
