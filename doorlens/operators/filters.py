"""Row filters and flags of the published rules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values.
EXCLUSION_REASON = "parcel record incomplete in county data"
UNSPEAKABLE = ("capacity_territory_percentile", "capacity_local_relative_value")


def of_class(parcels: DataFrame, prop_class: str = "2") -> DataFrame:
    return parcels.filter(F.col("prop_class") == prop_class)


def score_range(doors: DataFrame, low: int, high: int, show_unscored: bool = False) -> DataFrame:
    inside = F.col("score").between(low, high)
    return doors.filter(F.coalesce(inside, F.lit(show_unscored)))


def with_exclusion(doors: DataFrame, deed: str = "deed_day") -> DataFrame:
    """Adds the reason a door cannot be scored: no deed, no year and no value."""
    bare = F.col(deed).isNull() & (F.coalesce("yr_constr", F.lit(0)) <= 0) & (F.coalesce("net_value", F.lit(0.0)) <= 0)
    return doors.withColumn("exclusion_reason", F.when(bare, EXCLUSION_REASON))


def routable(doors: DataFrame) -> DataFrame:
    return doors.filter("score is not null and lon is not null and lat is not null")


def speakable(evidence: DataFrame) -> DataFrame:
    return evidence.filter(~F.col("type").isin(*UNSPEAKABLE))
