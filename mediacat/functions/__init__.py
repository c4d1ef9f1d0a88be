"""Column expressions; each takes and returns columns and never touches rows in Python."""
