"""Spark-native analytics for region-centred spatial-omics tables."""
