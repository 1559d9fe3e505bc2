"""Spark-native data work behind a question-answering help desk."""
