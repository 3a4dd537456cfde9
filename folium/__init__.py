"""Document and event analytics as PySpark DataFrame operators."""
