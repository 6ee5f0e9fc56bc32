"""Column expressions and the numpy kernels that run inside Arrow tasks."""
