"""A Spark-native engine for bi-temporal knowledge graphs: storage, search, traversal, extraction and evaluation."""
