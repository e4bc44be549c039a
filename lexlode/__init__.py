"""lexlode: a Spark-native retrieval, evaluation and text analytics engine."""

__version__ = "0.1.0"
