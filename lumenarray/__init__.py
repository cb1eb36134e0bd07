"""Spark-native analytics for dense sensor-array recordings and their catalogues."""
