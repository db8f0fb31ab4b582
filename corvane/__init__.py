"""A Spark-native engine for hybrid retrieval over code and text corpora."""
