"""Spark-native analytics over spatial tissue tables, and operators for text corpora (``lamina.llm``)."""
