"""Text privatisation, evaluation and corpus preparation on Spark."""
