"""Spark-native engine for tagged map data (nodes, ways, relations) queried with DataFrames."""
