"""corpuslake: a PySpark-native analytics engine for document corpora."""
