"""millrace: a PySpark-native analytics library (DataFrame, SQL and Structured Streaming)."""
