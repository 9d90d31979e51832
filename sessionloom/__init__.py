"""Session recommendation jobs and training-text operators on Spark."""
