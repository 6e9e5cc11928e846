"""Versioned, template-checked observation records as Spark DataFrame jobs."""
