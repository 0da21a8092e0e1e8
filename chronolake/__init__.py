"""chronolake: a PySpark-native analytics engine for multidimensional time series."""
