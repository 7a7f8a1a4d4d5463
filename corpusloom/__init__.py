"""A PySpark-native engine for document corpora, retrieval tables and conversation analytics."""
