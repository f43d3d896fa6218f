"""A batch analytics engine on PySpark."""
