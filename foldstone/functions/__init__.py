"""Column functions and batch kernels shared by the operators."""
