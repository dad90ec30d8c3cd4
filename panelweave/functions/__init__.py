"""Column expressions and the small numeric kernels run inside Arrow groups."""
