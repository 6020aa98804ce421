"""Column expressions shared by the operators. Every one is built from Spark's own functions."""
