"""Spark-native analytics for sample-by-gene expression data and free-text sample labels."""
