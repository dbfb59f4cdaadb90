"""First-wins, last-wins, positions, quantiles and top-k that survive a hot key.

Input order always comes as a column. Nothing here puts a whole key into one
window: positions are counted level by level, so one window holds the distinct
values of one level under one prefix.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def tie_break(columns: Sequence[Column]) -> Column:
    """A hash that orders rows which `ordinal` leaves level, so a pick among them does not depend on the order they arrive in."""
    return F.xxhash64(*columns, *[c.isNull() for c in columns])


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """One row per key, the smallest by `order`. A combinable aggregate: one row per key and task is shuffled."""
    return _extreme(df, keys, order, F.min_by)


def last_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    return _extreme(df, keys, order, F.max_by)


def _extreme(df, keys, order, pick):
    rest = [c for c in df.columns if c not in keys]
    rank = F.struct(*[(F.col(c) if isinstance(c, str) else c).alias(f"o{i}") for i, c in enumerate(order)])
    return df.groupBy(*keys).agg(pick(F.struct(*rest), rank).alias("_row")).select(*keys, "_row.*")


def count_below(
    df: DataFrame,
    keys: Sequence[str],
    levels: Sequence[str],
    weight: str,
    out: str = "below",
    descending: Sequence[bool] | None = None,
) -> DataFrame:
    """Adds the summed weight of rows that come before each row within its key.

    `levels` are columns that refine one another in sort order (say bucket, then
    value); each is ranked only within the one before it. `descending` says so per
    level. The last level must be unique within the levels above it.
    """
    downward = list(descending) if descending is not None else [False] * len(levels)
    prefix = [*keys, *levels[:-1]]
    last = F.col(levels[-1]).desc() if downward[-1] else F.col(levels[-1]).asc()
    window = Window.partitionBy(*prefix).orderBy(last).rowsBetween(Window.unboundedPreceding, -1)
    local = F.coalesce(F.sum(weight).over(window), F.lit(0))
    if len(levels) == 1:
        return df.withColumn(out, local)
    upper = df.groupBy(*prefix).agg(F.sum(weight).alias("_weight"))
    base = f"_base{len(levels)}"
    upper = count_below(upper, keys, levels[:-1], "_weight", base, downward[:-1]).drop("_weight")
    return df.withColumn("_local", local).join(upper, prefix).withColumn(out, F.col("_local") + F.col(base)).drop(
        "_local", base
    )


def value_bucket(value: Column) -> Column:
    """A coarse bucket that never falls as the value grows: equal ratios, about 0.4 % wide."""
    return (F.signum(value) * F.floor(F.log1p(F.abs(value)) * 256.0)).cast("bigint")


def histogram(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Distinct values with their count `n`; a value held by a third of the rows is one row."""
    return df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))


def ranked_histogram(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """The histogram plus `below` (rows with a smaller value) and `total` (rows of the key)."""
    counts = histogram(df, keys, value).withColumn("_bucket", value_bucket(F.col(value)))
    totals = counts.groupBy(*keys).agg(F.sum("n").alias("total"))
    return count_below(counts, keys, ["_bucket", value], "n").drop("_bucket").join(totals, list(keys))


def quantiles(df: DataFrame, keys: Sequence[str], value: str, at: dict[str, float]) -> DataFrame:
    """Exact linear-interpolated quantiles per key, read off the ranked histogram."""
    ranked = ranked_histogram(df.filter(F.col(value).isNotNull()), keys, value)
    aggregates = []
    for name, p in at.items():
        position = (F.col("total") - 1) * F.lit(p)
        for suffix, rank in (("lo", F.floor(position)), ("hi", F.ceil(position))):
            inside = (F.col("below") <= rank) & (rank < F.col("below") + F.col("n"))
            aggregates.append(F.max(F.when(inside, F.col(value))).alias(f"{name}_{suffix}"))
    rows = ranked.groupBy(*keys).agg(F.max("total").alias("total"), *aggregates)
    columns = []
    for name, p in at.items():
        position = (F.col("total") - 1) * F.lit(p)
        low, high = F.col(f"{name}_lo"), F.col(f"{name}_hi")
        columns.append((low + (high - low) * (position - F.floor(position))).alias(name))
    return rows.select(*keys, "total", *columns)


def medians(df: DataFrame, keys: Sequence[str], value: str, out: str = "median") -> DataFrame:
    return quantiles(df, keys, value, {out: 0.5})


def top_per_key(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    limit: int | str,
    spread: str,
    position: str = "position",
    slices: int = 32,
) -> DataFrame:
    """The first `limit` rows per key with their 1-based `position`.

    The key is first cut into slices by a hash of `spread`, each slice keeps its own
    first `limit` rows, and only those meet in the final ranking.
    """
    bound = F.col(limit) if isinstance(limit, str) else F.lit(limit)
    sliced = df.withColumn("_slice", F.pmod(F.xxhash64(spread), F.lit(slices)))
    local = F.row_number().over(Window.partitionBy(*keys, "_slice").orderBy(*order))
    kept = sliced.withColumn("_local", local).filter(F.col("_local") <= bound).drop("_local", "_slice")
    final = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return kept.withColumn(position, final).filter(F.col(position) <= bound)
