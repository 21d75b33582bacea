"""measured: a PySpark-native analytics library."""
