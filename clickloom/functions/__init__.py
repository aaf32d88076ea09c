"""Column expressions shared by the operators; all run inside Spark, none is a Python UDF."""
