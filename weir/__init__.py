"""weir: a PySpark-native engine for provider-registry data and the sales activity around it."""
