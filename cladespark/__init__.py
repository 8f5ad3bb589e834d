"""Spark-native analytics for tree samples, parameter traces, alignments and Metropolis-coupled sampling."""
