"""Column expressions and Arrow kernels over packets, headers and samples."""
