"""Evidence retrieval and regulatory analytics as PySpark DataFrame jobs."""
