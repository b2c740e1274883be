"""PySpark-native analytics for event-level demand data."""
