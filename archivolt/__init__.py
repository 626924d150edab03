"""A PySpark-native engine for transcriptome archives and their metadata."""
