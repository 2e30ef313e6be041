"""Spark-native analytics for fleets of degrading assets: panels of ordered sensor rows per entity."""
