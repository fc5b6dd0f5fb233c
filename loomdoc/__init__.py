"""Document analytics and hybrid retrieval on PySpark."""
