"""A PySpark-native analytics engine for pyramidal slide images and their patch features."""
