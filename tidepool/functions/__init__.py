"""Column expressions, and the small numeric helpers of grouped maps."""
