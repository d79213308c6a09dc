"""A Spark-native engine for citation-aware retrieval, ranking, evaluation and training-data work."""
