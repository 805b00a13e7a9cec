"""Part of corpusmill, a PySpark-native engine for text corpora."""
