"""A PySpark-native engine for evidence queries over source repositories and their history."""
