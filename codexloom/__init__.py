"""Text-library analytics on Spark: relational library queries, lexical search, ingest, replicated state, layout."""
