"""A PySpark-native engine for versioned, permissioned data and training-data pipelines."""
