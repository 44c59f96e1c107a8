"""A PySpark-native engine for screening text evidence."""
