"""Document traceability and corpus processing on Spark."""
