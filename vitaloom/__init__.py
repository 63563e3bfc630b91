"""Document-to-profile analytics on Spark."""
