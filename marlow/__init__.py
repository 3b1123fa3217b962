"""marlow: Spark-native operators for records, text, series and geometry."""
