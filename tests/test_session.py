"""Settings of a session somebody else made."""

from pyspark.sql import functions as F

from basketry.session import configure

KEPT = ["spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.adaptive.coalescePartitions.initialPartitionNum", "spark.sql.shuffle.partitions"]


def test_large_shuffles_are_cut_into_small_tasks(spark):
    held = {k: spark.conf.get(k, None) for k in KEPT}
    spark.conf.unset(KEPT[0])
    try:
        spark.conf.set(KEPT[2], "2")
        rows = spark.range(500_000, numPartitions=4).select(F.sha2(F.col("id").cast("string"), 256).alias("k")).distinct()
        assert rows.rdd.getNumPartitions() <= 2  # some 20 MB in two tasks
        configure(spark)
        rows = spark.range(500_000, numPartitions=4).select(F.sha2(F.col("id").cast("string"), 256).alias("k")).distinct()
        assert rows.rdd.getNumPartitions() > 2
        spark.conf.set(KEPT[2], "600")
        configure(spark)
        assert spark.conf.get(KEPT[1]) == "600"
    finally:
        for k, v in held.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
