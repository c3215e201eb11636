"""corpuslake: a PySpark-native engine for building and scoring text corpora."""
