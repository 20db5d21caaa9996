"""lakeloom: a PySpark-native document-evidence analytics engine."""
