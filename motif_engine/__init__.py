"""PySpark-native analytics over melodic note sequences."""
