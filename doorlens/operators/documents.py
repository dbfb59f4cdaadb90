"""JSON documents of unknown shape: every key path, private keys found and removed at any depth.

A document is parsed into a variant and opened one level a round, all documents together; a round's rows are the members
of what the round before found, so no document is walked by one task as a whole and no schema has to be known. Removal
closes the levels again from the deepest up, leaving out the members that have to go.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doorlens.operators.publish import IDENTITY_PATTERNS
from doorlens.session import cut_lineage, land
from doorlens.sources.readers import PRIVATE_KEYS

IDENTITY_PATTERN = "(?i)" + "|".join(IDENTITY_PATTERNS)


def _kind(value: Column) -> Column:
    kind = F.schema_of_variant(value)
    return F.when(kind.startswith("OBJECT"), "object").when(kind.startswith("ARRAY"), "array").otherwise("value")


def members(df: DataFrame, column: str, ids: Sequence[str], drop: Column | None = None, max_depth: int = 1000) -> list[DataFrame]:
    """Per depth, one written table of (ids, node, parent, pos, key, path, kind, text).

    The root has depth 0 and node ''. `key` is null for members of a list, whose path ends in `[]`. `text` is the JSON of a plain
    value. Members for which `drop` (over `key`) holds are not opened and not listed. A text that is no JSON has no root row.
    """
    spark = df.sparkSession
    root = df.select(*ids, F.try_parse_json(F.col(column)).alias("v")).filter("v is not null")
    level = land(root.select(
        *ids, F.lit("").alias("node"), F.lit(None).cast("string").alias("parent"), F.lit(0).alias("pos"), F.lit(None).cast("string").alias("key"),
        F.lit("").alias("path"), _kind(F.col("v")).alias("kind"), F.to_json("v").alias("text")), "depth")
    levels = [level]
    while not (open_ := levels[-1].filter("kind != 'value'")).isEmpty():
        if len(levels) > max_depth:
            raise RuntimeError(f"documents are deeper than {max_depth} levels")
        given = open_.select(*ids, F.col("node").alias("parent"), "path", "kind", F.parse_json("text").alias("v"))
        # A key of the list's own row number keeps equal members apart.
        opened = given.lateralJoin(spark.tvf.variant_explode_outer(F.col("v").outer())).filter("pos is not null")
        path = F.when(F.col("kind") == "array", F.concat("path", F.lit("[]"))).otherwise(
            F.concat("path", F.when(F.col("path") == "", F.lit("")).otherwise(F.lit(".")), "key"))
        rows = opened.select(
            *ids, F.concat_ws("/", "parent", F.col("pos").cast("string")).alias("node"), "parent", "pos", "key", path.alias("path"),
            _kind(F.col("value")).alias("kind"), F.to_json("value").alias("text"))
        if drop is not None:
            rows = rows.filter(~F.coalesce(drop, F.lit(False)))
        levels.append(land(rows, "depth"))
    return levels


def key_paths(df: DataFrame, column: str, ids: Sequence[str]) -> DataFrame:
    """(ids, path, key): every key of every document with the path that leads to it, list members as `[]`."""
    levels = members(df, column, ids)
    found = None
    for level in levels[1:]:
        rows = level.filter("key is not null").select(*ids, "path", "key")
        found = rows if found is None else found.unionByName(rows)
    return found if found is not None else levels[0].filter("false").select(*ids, "path", "key")


def identity_paths(df: DataFrame, column: str, ids: Sequence[str]) -> DataFrame:
    """(path, rows): identity-shaped keys by full path, with the number of documents that carry each."""
    hits = key_paths(df, column, ids).filter(F.col("key").rlike(IDENTITY_PATTERN)).select(*ids, "path").distinct()
    return hits.groupBy("path").agg(F.count(F.lit(1)).alias("rows"))


def without_keys(df: DataFrame, column: str, ids: Sequence[str], private: Sequence[str] = PRIVATE_KEYS) -> DataFrame:
    """`df` with the private keys, in any case and at any depth, taken out of the JSON in `column`; keys of an object come in order.

    `ids` identify the rows. A text that is no JSON becomes null.
    """
    levels = members(df, column, ids, drop=F.lower("key").isin(*private))
    closed = None
    for level in reversed(levels):
        rows = level
        if closed is not None:
            rows = rows.join(closed.withColumnRenamed("parent", "node"), [*ids, "node"], "left")
        else:
            rows = rows.withColumn("inner", F.lit(None).cast("array<struct<pos:int,part:string>>"))
        parts = F.array_join(F.transform(F.array_sort(F.coalesce("inner", F.array())), lambda m: m.part), ",")
        text = F.when(F.col("kind") == "object", F.concat(F.lit("{"), parts, F.lit("}"))).when(
            F.col("kind") == "array", F.concat(F.lit("["), parts, F.lit("]"))).otherwise(F.col("text"))
        # The key as a JSON string: that of a list of it, without the brackets.
        name = F.to_json(F.array("key"))
        part = F.when(F.col("key").isNull(), text).otherwise(F.concat(F.substring(name, F.lit(2), F.length(name) - 2), F.lit(":"), text))
        done = rows.select(*ids, "parent", "pos", part.alias("part"))
        if level is levels[0]:
            return df.drop(column).join(done.select(*ids, F.col("part").alias(column)), list(ids), "left").select(*df.columns)
        # The members of one object or list, gathered as its text asks.
        closed = cut_lineage(done.groupBy(*ids, "parent").agg(F.collect_list(F.struct("pos", "part")).alias("inner")))
    raise AssertionError("unreachable")
