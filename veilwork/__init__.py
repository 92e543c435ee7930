"""Document privacy analytics on Spark."""
