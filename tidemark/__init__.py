"""tidemark: a PySpark-native engine for clickstream and order analytics."""
