"""A PySpark-native SQL analytics engine."""
