"""A Spark-native analytics engine that takes T-SQL."""
