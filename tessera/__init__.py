"""tessera: a Spark-native engine for sensitive-data detection and lake analytics."""

__version__ = "0.1.0"
