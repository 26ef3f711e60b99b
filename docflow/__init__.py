"""docflow: a PySpark-native engine for trade documents and their analytics."""
