"""Graph traversal analytics and training-data preparation, written for Spark."""
