"""Column expressions of the interval and sequence domain."""
