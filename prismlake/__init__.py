"""Spark-native engine for lossy multi-source codec analytics and training-data preparation."""
