"""genoloom: a Spark-native pan-genome analytics engine."""

__version__ = "0.1.0"
