"""Property-graph queries on Spark."""
