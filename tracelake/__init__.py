"""Session analytics and corpus processing on PySpark."""
