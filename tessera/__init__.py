"""A PySpark-native engine for frame-indexed observations, interval events and agreement statistics."""
