"""Document and retrieval analytics on PySpark."""
