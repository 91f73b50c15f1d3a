"""Review sentiment analytics as PySpark DataFrame operators."""
