"""Spark-native analytics over omics tables and knowledge graphs."""
