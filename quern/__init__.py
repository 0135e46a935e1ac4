"""quern: a PySpark-native engine for protein-sequence and protein-structure screening."""
