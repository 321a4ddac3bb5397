"""policylake: a PySpark-native engine for versioned policy documents and eligibility rules."""
