"""Settings the plans are written for. The cluster's own values win where it sets them."""

TUNING = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Split skewed join partitions even where that costs one more shuffle.
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.sql.files.maxPartitionBytes": "134217728",
}


def tuned(builder):
    """A session builder with the settings above."""
    for key, value in TUNING.items():
        builder = builder.config(key, value)
    return builder
