"""A PySpark-native engine that turns sourced claims about institutions into scored, ranked, searchable tables."""
