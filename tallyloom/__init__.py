"""tallyloom: a PySpark-native analytics engine for customer-feedback corpora."""
