"""Column expressions: no DataFrame, no job, only built-in functions."""
