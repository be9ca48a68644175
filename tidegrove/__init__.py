"""A PySpark-native engine for array-valued time series and the datasets built around them."""
