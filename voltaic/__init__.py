"""PySpark-native analytics for regimes of hourly series."""
