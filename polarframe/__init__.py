"""Spark-native analytics for gridded polar ice-sheet observations."""
