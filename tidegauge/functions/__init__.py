"""Function registry: Python semantics, types and Spark expressions."""
