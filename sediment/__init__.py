"""A PySpark-native engine for archives, catalogs and training corpora."""
