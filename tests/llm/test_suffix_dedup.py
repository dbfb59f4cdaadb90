"""Repeated strings against a plain reading of the rule."""

import hashlib
import random

import numpy as np
import pytest

from doorlens.llm import suffix_dedup
from tests.llm.fixtures import awkward_docs, frame, prose


def plain(rows, length):
    """Every window of every text counted; bytes under a window met twice go."""
    count: dict[bytes, int] = {}
    texts = [(r[0], (r[1] or "").encode()) for r in rows]
    for _, t in texts:
        for i in range(len(t) - length + 1):
            count[t[i:i + length]] = count.get(t[i:i + length], 0) + 1
    out = []
    for doc_id, t in texts:
        gone = np.zeros(len(t) + 1, bool)
        for i in range(len(t) - length + 1):
            if count[t[i:i + length]] > 1:
                gone[i:i + length] = True
        kept = bytes(b for b, g in zip(t, gone) if not g)
        spans = int((gone[1:] & ~gone[:-1]).sum() + gone[0]) if len(t) else 0
        out.append((doc_id, len(t), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def corpus(seed=3, n=60):
    """Shared passages at random places, near copies, periodic texts, and texts just above and below the length."""
    rng = random.Random(seed)
    shared = [prose(rng, 12) for _ in range(4)]
    rows = []
    for i in range(n):
        parts = [prose(rng, rng.randrange(0, 30))]
        for _ in range(rng.randrange(3)):
            parts += [rng.choice(shared)[rng.randrange(5):], prose(rng, rng.randrange(0, 9))]
        rows.append((100 + i, " ".join(parts)))
    near = prose(rng, 200)
    rows += [(200 + i, near[:i * 37] + "X" * (i % 3) + near[i * 37:]) for i in range(6)]
    rows += [(300, "ab" * 90), (301, "a" * 39), (302, "a" * 40), (303, "b" * 41), (304, "é" * 41), (305, near[3:43]), (306, near[3:42])]
    return [(i, t, "en", "a", 1, 1, "x", "y", "z") for i, t in rows]


@pytest.mark.parametrize("group", [8192, 2])
@pytest.mark.parametrize("length", [40, 7])
def test_report_equals_brute_force(spark, group, length):
    rows = corpus() + [r for r in awkward_docs() if len(r[1] or "") < 5000]
    got = suffix_dedup.removal_report(frame(spark, rows).repartition(5), length=length, group=group)
    assert got.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == plain(rows, length)


def test_production_length_and_long_texts(spark, monkeypatch):
    rng = random.Random(5)
    passage = prose(rng, 70)
    body = prose(rng, 9000, 5000)
    rows = [(1, body[:30000] + passage + body[30000:]), (2, passage + prose(rng, 40)), (3, body[20000:20199]), (4, body[20000:20200]), (5, None)]
    rows = [(*r, "en", "a", 1, 1, "x", "y", "z") for r in rows]
    want = plain(rows, 200)
    assert sorted(map(tuple, suffix_dedup.removal_report(frame(spark, rows)).collect()), key=str) == want
    spans = {r.doc_id: [(s.a, s.b) for s in r.spans] for r in suffix_dedup.removed_spans(frame(spark, rows)).collect()}
    assert set(spans) == {1, 2, 4} and spans[4] == [(0, 200)]


def test_parts_of_a_long_text_find_the_same_anchors():
    rng = np.random.default_rng(1)
    data = rng.integers(97, 101, 5000).astype(np.uint8)
    rolling = suffix_dedup._Rolling(8192)
    whole = suffix_dedup.segment_anchors(rolling, data, np.array([5000]), 50)
    owner = {}
    for grams, at, first, last in zip(*whole):
        owner |= {p: (grams, at) for p in range(first, last + 1)}
    assert sorted(owner) == list(range(4951))
    grams, at, first, last = suffix_dedup.segment_anchors(rolling, data[1000:3000], np.array([2000]), 50)
    for g, a, x, y in zip(grams, at, first, last):
        assert all(owner[p + 1000] == (g, a + 1000) for p in range(x, y + 1))


def test_empty_table_and_repeated_rows(spark):
    assert suffix_dedup.removal_report(frame(spark, [])).count() == 0
    rows = [(1, "x" * 10, "en", "a", 1, 1, "x", "y", "z")] * 2 + [(None, None, None, None, None, None, None, None, None)]
    assert sorted(map(tuple, suffix_dedup.removal_report(frame(spark, rows), length=10).collect()), key=str) == plain(rows, 10)
