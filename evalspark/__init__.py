"""Spark-native engine for language-model evaluation data. Workers import it from their own installed copy."""

__version__ = "0.1.0"
