"""Literature-corpus jobs on Spark: documents, chunks, retrieval, libraries and event logs as tables."""
