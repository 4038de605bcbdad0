"""turnstream: a PySpark-native engine for long-form spoken-content data."""
