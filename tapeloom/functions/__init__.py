"""Column functions: time rules, guarded arithmetic, statistics."""
