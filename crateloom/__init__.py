"""Media-catalog and listening analytics as PySpark DataFrame operators."""
