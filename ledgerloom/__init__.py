"""Chain-history analytics on Spark."""
