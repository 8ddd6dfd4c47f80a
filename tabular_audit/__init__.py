"""Review of the quality and content of multi-table programme data on Spark."""
