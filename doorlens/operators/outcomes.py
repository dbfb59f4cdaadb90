"""Field outcomes: the record contract, and outcome rates by score band."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from doorlens.functions.text import safe_rate

# Fixed values.
PRIMARY = ("receptive_conversation", "not_receptive", "no_answer")


def validate_outcomes(outcomes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, invalid with `reason`): the first broken rule names the reason."""
    def blank(name):
        return F.trim(F.coalesce(name, F.lit(""))) == ""

    time = F.col("attempt_time")
    iso = time.rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}(:\d{2}(:\d{2}(\.\d{1,6})?)?)?(Z|[+-]\d{2}:?\d{2})?)?$")
    reason = (
        F.when(blank("door_id"), "door_id must be a non-empty string")
        .when(time.isNull() | ~iso | time.try_cast("timestamp").isNull(), "attempt_time not ISO-8601")
        .when(blank("score_contract_version"), "score_contract_version must be a non-empty string")
        .when(F.col("attempt_score").isNull() | ~F.col("attempt_score").between(0, 100), "attempt_score must be an integer 0-100")
        .when(F.col("primary_outcome").isNull() | ~F.col("primary_outcome").isin(*PRIMARY), "unknown primary_outcome")
        .when(F.col("follow_up_requested").isNull() | F.col("service_booked").isNull(),
              "secondary outcome must be a boolean")
    )
    checked = outcomes.withColumn("reason", reason)
    return checked.filter("reason is null").drop("reason"), checked.filter("reason is not null")


def band_table(spark: SparkSession, edges: Sequence[float]) -> DataFrame:
    return spark.range(len(edges) + 1).select(F.col("id").cast("int").alias("band"))


def band_lift(outcomes: DataFrame, edges: Sequence[float]) -> DataFrame:
    """Rates per score band; N ascending edges make N+1 bands, empty ones listed with zeros."""
    if list(edges) != sorted(edges):
        raise ValueError("edges must be ascending")
    cuts = F.array(*[F.lit(float(e)) for e in edges]) if edges else F.array().cast("array<double>")
    band = F.size(F.filter(cuts, lambda edge: edge <= F.col("attempt_score")))
    tally = outcomes.groupBy(band.alias("band")).agg(
        F.count(F.lit(1)).alias("attempts"), F.count_if(F.col("primary_outcome") == PRIMARY[0]).alias("receptive"),
        F.count_if("follow_up_requested").alias("follow_up"), F.count_if("service_booked").alias("booked"),
    )
    rows = band_table(outcomes.sparkSession, edges).join(tally, "band", "left").na.fill(0)
    return rows.select(
        "band", "attempts",
        *[safe_rate(F.col(c), F.col("attempts")).alias(n) for c, n in (
            ("receptive", "receptive_rate"), ("follow_up", "follow_up_rate"), ("booked", "service_booked_rate"))],
    )


def spend_ledger(spend: DataFrame) -> DataFrame:
    """Units and dollars per source, and the total as the row whose source is NULL."""
    return spend.rollup("source").agg(F.sum("units").alias("units"), F.sum("usd").alias("usd"))
