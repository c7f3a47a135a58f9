"""A PySpark-native engine that turns page observations into typed change events."""
