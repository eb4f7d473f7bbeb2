"""Research-trend analytics and corpus processing as plain Spark DataFrame functions."""
