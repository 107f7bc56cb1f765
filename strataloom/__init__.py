"""strataloom: a Spark-native library of document-analytics operators."""

__version__ = "0.1.0"
