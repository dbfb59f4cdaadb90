"""Session settings that the plans rest on."""

from pyspark.sql import functions as F

from doorlens.session import land, sized_by_rows


def test_joins_are_planned_by_the_size_of_rows(spark):
    """Rows of 100 MB whose file holds less than 10 MB are not sent through the driver; a factor of the session's own stays."""
    key = "spark.sql.sources.fileCompressionFactor"
    wide = land(spark.range(400_000).withColumn("text", F.lit("x" * 250)), "wide")
    other = land(spark.range(400_000).withColumn("more", F.lit("y" * 250)), "other")
    assert "BroadcastHashJoin" not in wide.join(other, "id")._jdf.queryExecution().sparkPlan().toString()
    before = spark.conf.get(key)
    try:
        spark.conf.set(key, "2.0")
        sized_by_rows(spark)
        assert spark.conf.get(key) == "2.0"
    finally:
        spark.conf.set(key, before)


def test_label_files_do_not_grow_with_the_table(spark):
    from doorlens.plans.landed import label_files

    files = label_files(spark.range(9_000).select(F.col("id").alias("event_id"), F.lit("1").alias("text"))).collect()
    assert sorted(len(f.value.split(",")) for f in files) == [1500, 2500, 2500, 2500]
