"""pkgloom: a PySpark-native software-provenance analytics engine."""
