"""postmill: a PySpark-native engine that turns semi-structured posts into clean documents."""
