"""A Spark-native engine that curates marker-gene collections and training corpora."""
