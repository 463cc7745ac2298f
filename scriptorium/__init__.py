"""Spark-native document analytics and lexical search."""
