"""A lakehouse table engine on PySpark."""
