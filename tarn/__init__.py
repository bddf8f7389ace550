"""A Spark-native engine for linking records across sources and preparing text corpora."""
