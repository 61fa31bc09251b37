"""touchline: Spark-native match-data quality, history features and forecast evaluation."""
