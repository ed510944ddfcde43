"""A PySpark-native engine for repeat and gene expression from aligned reads."""
