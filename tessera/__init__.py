"""PySpark-native analytics over source repositories and text corpora."""
