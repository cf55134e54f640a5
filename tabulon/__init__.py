"""tabulon: a Spark-native engine for semi-structured statement tables."""

__version__ = "0.1.0"
