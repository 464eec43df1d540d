"""braidflow: Spark-native river-migration analytics on DataFrames and Spark SQL."""
