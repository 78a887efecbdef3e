"""A PySpark-native analytics engine for curating image datasets."""
