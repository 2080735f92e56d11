"""Spark-native analytics for per-parcel earth-observation time series."""
