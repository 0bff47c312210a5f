"""Entity analytics for archival text, on Spark."""
