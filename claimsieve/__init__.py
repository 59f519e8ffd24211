"""Text-classification features and evolutionary model search as Spark jobs."""
