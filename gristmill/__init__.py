"""gristmill: Spark-native screening, splitting and evaluation of training data."""

__version__ = "0.1.0"
