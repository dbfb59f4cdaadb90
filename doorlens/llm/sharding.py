"""Proportional stratified interleaving, on DataFrame functions alone.

Rows are shuffled by a seeded hash and ranked within their source; the rank as a fraction of the
source's rows, over all sources, is the order of the output. Any stretch of it holds the sources in
the proportion of the whole, so shards cut from it at equal row counts all match the mixture.
Ranks are counted in runs of the hash (and of the fraction), so no window holds a source or the table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from doorlens.llm.common import ROW, field, key_pair, packed, row_key, source_key
from doorlens.operators.ordering import count_below

SHARDS = 8
SEED = 11
LAW = "rows"
#: Runs that a source, and the whole order, are cut into.
_RUN_BITS = 12


def interleaved(keyed: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """Adds `shard` and `slot` to a table with source, k1, k2 (no nulls); row counts differ by one at most."""
    counts = _offsets(keyed.groupBy("source").agg(F.count(F.lit(1)).alias("_n")), seed)
    total = keyed.agg(F.count(F.lit(1)).alias("_all"))  # one row
    counts = counts.join(F.broadcast(total), F.col("_n") <= F.col("_all"))
    place = F.struct(F.xxhash64(F.lit(seed), "k1", "k2").alias("h"), "k1", "k2")
    placed = keyed.withColumn("_one", F.lit(1).cast("long")).withColumn("_place", place)
    placed = placed.withColumn("_run", F.shiftrightunsigned(F.col("_place.h"), 64 - _RUN_BITS))
    ranked = count_below(placed, ["source"], ["_run", "_place"], "_one", "_rank").join(counts, "source")
    fraction = (F.col("_rank") + F.col("_offset")) / F.col("_n")
    ranked = ranked.withColumn("_run", F.floor(fraction * (1 << _RUN_BITS)))
    ranked = ranked.withColumn("_place", F.struct(fraction.alias("f"), F.col("_place.h").alias("h"), "source", "k1", "k2"))
    spread = count_below(ranked, [], ["_run", "_place"], "_one", "_at")
    shard = F.expr(f"(_at * {shards}) div _all")
    first = F.expr(f"(shard * _all + {shards - 1}) div {shards}")
    return spread.withColumn("shard", shard.cast("int")).withColumn("slot", F.col("_at") - first).drop(
        "_one", "_place", "_run", "_rank", "_n", "_all", "_at", "_offset")


def _offsets(counts: DataFrame, seed: int) -> DataFrame:
    """Adds `_offset` in (0, 1): sources of one size stand evenly between 0 and 1, in seeded order, so that many small ones spread."""
    placed = counts.withColumn("_place", F.struct(F.xxhash64(F.lit(seed), "source").alias("h"), "source")).withColumn("_one", F.lit(1).cast("long"))
    placed = placed.withColumn("_run", F.shiftrightunsigned(F.col("_place.h"), 64 - _RUN_BITS))
    sizes = counts.groupBy("_n").agg(F.count(F.lit(1)).alias("_alike"))
    ranked = count_below(placed, ["_n"], ["_run", "_place"], "_one", "_before").join(sizes, "_n")
    return ranked.select("source", "_n", ((F.col("_before") + 0.5) / F.col("_alike")).alias("_offset"))


def shard_report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source",
                 shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """One row per document: doc_id, size (UTF-8 bytes + 1), text_crc32, law, shard, slot, grown_shard (null), source.

    The law is `rows`: shards differ by one row at most. Rows are dealt one by one, equal texts
    like any others. A null text has size 1 and the checksum of the empty text; null sources are
    one source; repeated rows are rows of their own; an empty table gives no rows.
    """
    one, two = key_pair(F.col(doc_id), F.col(text))
    keyed = docs.select(
        F.col(doc_id).alias("doc_id"), source_key(F.col(source)).alias("source"), one.alias("k1"), two.alias("k2"),
        (F.octet_length(F.coalesce(F.col(text), F.lit(""))) + 1).cast("long").alias("size"),
        F.crc32(F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8")).alias("text_crc32"),
    )
    return interleaved(keyed, shards, seed).select(
        "doc_id", "size", "text_crc32", F.lit(LAW).alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
        _name(F.col("source")).alias("source"),
    )


def _name(key: Column) -> Column:
    return F.when(F.left(key, F.lit(1)) == "0", F.substring(key, 2, 1 << 30))


def shard_documents(docs: DataFrame, source: str = "source", shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """The documents with columns `shard` and `slot` (replacing any of that name); same cases as `shard_report`."""
    columns = [c for c in docs.columns if c not in ("shard", "slot")]
    one, two = row_key(docs)
    keyed = packed(docs).select(ROW, source_key(field(source)).alias("source"), one.alias("k1"), two.alias("k2"))
    dealt = interleaved(keyed, shards, seed)
    return dealt.select(*[field(c).alias(c) for c in columns], "shard", "slot")
