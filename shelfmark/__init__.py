"""Media-catalogue analytics on Spark: DataFrame, SQL and streaming operators."""
