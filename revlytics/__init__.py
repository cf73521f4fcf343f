"""Review-evaluation analytics on Spark."""
