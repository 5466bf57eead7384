"""Spark-native corpus and tokenizer analytics."""
