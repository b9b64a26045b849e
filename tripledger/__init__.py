"""tripledger: a PySpark-native analytics engine for vehicle-operations data."""
