"""Spark-native engine that measures how unusual a piece of writing is for its writer."""
