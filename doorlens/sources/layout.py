"""Dated records landed by town and year, so that a window of a few towns opens their folders only.

The town and the year are folders: filters on them never reach a file of another one. The day is a column with statistics,
so it is pushed into the files that are opened. Towns given as a table prune at run time, when the join's small side is known.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def land_by_town_and_year(records: DataFrame, root: str, town: str = "mun", day: str = "issue_date") -> None:
    """Replaces `root`. Rows of one town and year come together first, large ones over several tasks; a null day has its own folder."""
    dated = records.withColumn("year", F.year(day)).hint("rebalance", town, "year")
    dated.sortWithinPartitions(town, "year", day).write.mode("overwrite").partitionBy(town, "year").parquet(root)


def read_window(
    spark: SparkSession, root: str, as_of: dt.date, days: int, towns: Sequence[str] | DataFrame | None = None, town: str = "mun", day: str = "issue_date"
) -> DataFrame:
    """Records of the last `days` before and on no bound after `as_of`, of some towns or all; a table of towns has their column."""
    first = as_of - dt.timedelta(days=days)
    # Town codes are text, whatever they look like.
    schema = spark.read.parquet(root).schema
    schema[town].dataType = StringType()
    rows = spark.read.schema(schema).parquet(root).filter((F.col("year") >= first.year) & (F.col(day) >= F.lit(first)))
    if towns is None:
        return rows
    if isinstance(towns, DataFrame):
        return rows.join(towns.select(town).distinct(), town, "left_semi")
    return rows.filter(F.col(town).isin(*towns))

