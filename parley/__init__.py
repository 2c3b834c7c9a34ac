"""parley: coded-dialogue analytics expressed as PySpark DataFrame operations."""
