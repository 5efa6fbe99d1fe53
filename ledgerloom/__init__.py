"""Spark-native commercial analytics: normalisation, attributes, graphs, search and optimisation."""
