"""Quality analytics for sequencing reads, and data preparation, on Spark."""
