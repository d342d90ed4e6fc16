"""Column expressions: every function maps Columns to Columns and stays inside the JVM."""
