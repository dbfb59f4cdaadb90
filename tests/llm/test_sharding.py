"""Interleaved shards: counts, mixture, determinism."""

import collections
import random
import zlib

from pyspark.sql import functions as F

from doorlens.llm import sharding
from doorlens.llm.common import key_pair, source_key
from tests.llm.fixtures import awkward_docs, frame


def test_counts_and_mixture(spark):
    rows = awkward_docs()
    got = sharding.shard_report(frame(spark, rows)).collect()
    counts = collections.Counter(r.shard for r in got)
    assert set(counts) == set(range(8)) and max(counts.values()) - min(counts.values()) <= 1
    for shard in counts:
        assert sorted(r.slot for r in got if r.shard == shard) == list(range(counts[shard]))
    for source in {r.source for r in got}:
        each = [sum(r.shard == s and r.source == source for r in got) for s in range(8)]
        assert max(each) - min(each) <= 2
    order = lambda t: tuple((x is None, x or 0) for x in t)
    data = [(r[0], (r[1] or "").encode(), r[3]) for r in rows]
    assert sorted(((r.doc_id, r.size, r.text_crc32, r.source) for r in got), key=order) == sorted(
        ((i, len(t) + 1, zlib.crc32(t), s) for i, t, s in data), key=order)
    assert {(r.law, r.grown_shard) for r in got} == {("rows", None)}
    again = sharding.shard_report(frame(spark, rows).repartition(7)).collect()
    assert sorted(map(tuple, got), key=order) == sorted(map(tuple, again), key=order)


def test_documents_keep_their_columns(spark):
    df = frame(spark, awkward_docs())
    got = sharding.shard_documents(df)
    assert got.columns == [c for c in df.columns if c != "slot"] + ["shard", "slot"]
    order = lambda t: tuple((x is None, str(x)) for x in t)
    kept = [c for c in df.columns if c != "slot"]
    assert sorted(map(tuple, got.select(*kept).collect()), key=order) == sorted(map(tuple, df.select(*kept).collect()), key=order)


def test_fewer_rows_than_shards_and_none(spark):
    rows = awkward_docs()[:3]
    assert {(r.shard, r.slot) for r in sharding.shard_report(frame(spark, rows)).collect()} == {(0, 0), (2, 0), (5, 0)}
    assert sharding.shard_report(frame(spark, [])).count() == 0
    assert sharding.shard_documents(frame(spark, [])).count() == 0


def test_no_python_in_the_plan(spark):
    plan = sharding.shard_report(frame(spark, awkward_docs()))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_many_small_sources_spread(spark):
    """Sources of one row stand evenly in the order: each shard holds its share of them, to within one row."""
    rows = [(i, f"text {i}", "en", f"single {i}" if i < 400 else "large", 0, 1, "x", "y", "z") for i in range(1200)]
    got = sharding.shard_report(frame(spark, rows)).collect()
    small = collections.Counter(r.shard for r in got if r.source != "large")
    assert sorted(small) == list(range(8)) and max(small.values()) - min(small.values()) <= 1


def test_order_equals_a_plain_sort(spark):
    """Rank within the source by hash, offset of the source among those of its size, fraction, cut at equal counts."""
    rng = random.Random(4)
    rows = [(i, f"text {i}", "en", rng.choice(["a", "a", "a", "b", None, f"s{i}"]), 0, 1, "x", "y", "z") for i in range(300)]
    df = frame(spark, rows)
    one, two = key_pair(F.col("doc_id"), F.col("text"))
    hashed = df.select("doc_id", source_key(F.col("source")).alias("s"), F.xxhash64(F.lit(sharding.SEED), one, two).alias("h"), one.alias("k1"), two.alias("k2"))
    hashed = hashed.withColumn("sh", F.xxhash64(F.lit(sharding.SEED), "s")).collect()
    unsigned = lambda h: h % (1 << 64) >> 52
    sources, sizes = {}, collections.Counter(r.s for r in hashed)
    for s, sh in {(r.s, r.sh) for r in hashed}:
        sources.setdefault(sizes[s], []).append((unsigned(sh), sh, s))
    offset = {s: (i + 0.5) / len(same) for same in sources.values() for i, (_, _, s) in enumerate(sorted(same))}
    placed = []
    for s in sizes:
        mine = sorted((unsigned(r.h), r.h, r.k1, r.k2, r.doc_id) for r in hashed if r.s == s)
        placed += [((i + offset[s]) / len(mine), h, s, k1, k2, d) for i, (_, h, k1, k2, d) in enumerate(mine)]
    want = {d: at * 8 // len(placed) for at, (*_, d) in enumerate(sorted(placed))}
    assert {r.doc_id: r.shard for r in sharding.shard_report(df).collect()} == want
