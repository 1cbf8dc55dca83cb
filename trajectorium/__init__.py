"""PySpark-native analytics for trajectory tables."""
