"""Public-budget analytics as PySpark DataFrame operators."""
