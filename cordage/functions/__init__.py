"""Column functions: each takes and gives Spark columns and stays inside generated code."""
