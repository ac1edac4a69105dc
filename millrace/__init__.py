"""Spark-native document intelligence: ingestion, derivation, retrieval and analytics as DataFrame plans."""
