"""Hard negatives against scoring every pair."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from doorlens.llm import hard_negatives
from doorlens.session import land

SCHEMA = "vec_id long, embedding array<float>, label int, key string, q int"


def plain(rows, n_positives=5, n_negatives=5, low=80, high=100):
    seen = {}
    for vec_id, x, label, *_ in rows:
        if vec_id is None or label is None or x is None or any(v is None or not math.isfinite(v) for v in x):
            continue
        seen[vec_id, label, tuple(math.floor(256 * float(np.float32(v))) for v in x)] = 1
    out = []
    for a in seen:
        if a[0] % 100:
            continue
        scored = sorted(((-sum(p * q for p, q in zip(a[2], b[2])), b[0], b[1]) for b in seen if b != a))
        positives = [(i, -s) for s, i, lab in scored if lab == a[1]][:n_positives]
        for pid, ps in positives:
            fits = [(i, -s) for s, i, lab in scored if lab != a[1] and low * ps <= 100 * -s <= high * ps][:n_negatives]
            out += [(a[0], pid, k + 1, nid, ps, ns) for k, (nid, ns) in enumerate(fits)]
    return sorted(out)


def table(n=700, dims=12, seed=1, labels=4):
    rng = random.Random(seed)
    middles = [[rng.gauss(0, 1) for _ in range(dims)] for _ in range(5)]
    rows = []
    for i in range(n):
        middle = rng.choice(middles) if i % 3 else middles[0]
        x = [m * 0.2 + rng.gauss(0, 0.1) for m in middle]
        rows.append((i, x, rng.randrange(labels)))
    rows += [(2000 + 50 * i, rows[0][1], i % 2) for i in range(12)]
    rows += [(3000, [0.0] * dims, 1), (3100, [], 1), (3200, rows[5][1][:4], 2), (3300, [-v for v in rows[0][1]], 0)]
    rows += [(None, rows[1][1], 1), (3400, None, 1), (3500, rows[1][1], None), (3600, [None] * dims, 1), (3700, [float("nan")] * dims, 1), (3800, [float("inf")] * dims, 1)]
    rows += [(3900, rows[2][1], 3)] * 3
    return [(*r, "k", 1) for r in rows]


def mined(spark, rows, **options):
    df = land(hard_negatives.vectors(spark.createDataFrame(rows, SCHEMA).repartition(5)), "vectors")
    return hard_negatives.mine(df, F.col("vec_id") % 100 == 0, **options)


@pytest.mark.parametrize("options", [{}, {"block": 40, "members": 3, "cells": 4}])
def test_equals_scoring_every_pair(spark, options):
    rows = table()
    got = mined(spark, rows, **options)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    want = plain(rows)
    assert len(want) > 100 and sorted(map(tuple, got.collect())) == want


def test_other_windows_and_counts(spark):
    rows = table(300, seed=4)
    got = mined(spark, rows, n_positives=3, n_negatives=2, low=50, high=95, block=64)
    assert sorted(map(tuple, got.collect())) == plain(rows, 3, 2, 50, 95)


def test_large_components_stay_exact(spark):
    rng = random.Random(2)
    rows = [(i, [rng.uniform(-2e5, 2e5) for _ in range(6)], i % 2, "k", 1) for i in range(0, 3000, 10)]
    assert sorted(map(tuple, mined(spark, rows).collect())) == plain(rows)


def test_empty_table(spark):
    assert mined(spark, []).count() == 0
    assert mined(spark, table()[1:30]).count() == 0


def test_a_walk_stops_early_and_loses_nothing():
    rng = np.random.default_rng(1)
    members = rng.normal(0, 3, (20, 16)).astype(np.int64) + 200
    rows = np.concatenate([rng.normal(0, 3, (3000, 16)) + 200, rng.normal(0, 30, (20000, 16))]).astype(np.int64)
    walk = hard_negatives.Walk(members, np.full((20, 1), -(1 << 62)), np.full((20, 1), 1 << 62), 5)
    seen = []
    ids = np.arange(len(rows))
    owner, score, found, _ = walk.take(rows, ids, ids, lambda a, p: seen.append(len(p)) or np.ones((len(a), len(p)), bool))
    assert sum(seen) < 6000
    exact = members @ rows.T
    for m in range(20):
        order = np.lexsort((ids, -exact[m]))[:5]
        assert list(found[owner == m]) == list(order) and list(score[owner == m]) == list(exact[m][order])


def test_packs_are_dealt_and_not_sent_through_the_driver(spark):
    rows = land(hard_negatives.vectors(spark.createDataFrame(table(), SCHEMA)), "vectors")
    packs = land(hard_negatives.packed_rows(rows.withColumn("cell", F.lit(0)), 100).groupBy("pack").applyInArrow(
        hard_negatives._pack, hard_negatives.PACKED), "packs")
    plan = hard_negatives._best(packs, packs, 4, 1, True, 5)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_every_group_meets_every_block_once_on_a_grid(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "grid", lambda *_: (3, 2))
    rows = table()
    assert sorted(map(tuple, mined(spark, rows, block=40, members=3).collect())) == plain(rows)


def test_grid_balances_what_both_sides_send():
    assert hard_negatives.grid(100, 10_000, 100, 500) == (100, 1) and hard_negatives.grid(100, 10_000, 100, 7) == (7, 1)
    assert hard_negatives.grid(10_000, 10 ** 8, 10 ** 6, 10 ** 5) == (1000, 10) and hard_negatives.grid(8, 0, 0, 0) == (1, 1)
