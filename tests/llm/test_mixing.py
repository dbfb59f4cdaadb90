"""Targets, permutations, and what the mix takes, against plain readings."""

import collections

import numpy as np
import pytest

from doorlens.llm import mixing
from tests.llm.fixtures import awkward_docs, frame, prose, split_words


def plain_targets(sizes, weights=mixing.WEIGHTS, most=3):
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, excess, open_ = dict.fromkeys(names, 0.0), float(sum(sizes.values())), set(names)
    while excess > 1e-9 and open_:
        total = sum(weight[s] for s in open_)
        for s in list(open_):
            target[s] += excess * weight[s] / total
        excess = 0.0
        for s in list(open_):
            if target[s] >= most * sizes[s]:
                excess += target[s] - most * sizes[s]
                target[s] = float(most * sizes[s])
                open_.discard(s)
    return target


def test_permutation_is_one():
    rng = np.random.default_rng(1)
    for size in [1, 2, 3, 4, 5, 63, 64, 65, 1000]:
        key = np.full(size, rng.integers(1 << 63), np.uint64)
        index, sizes = np.arange(size), np.full(size, size)
        out = mixing.permute(index, sizes, key)
        assert sorted(out) == list(range(size))
        assert (mixing.permute(out, sizes, key, inverse=True) == index).all()


@pytest.mark.parametrize("block", [1, 7, 128])
def test_mix_meets_targets(spark, block):
    rows = awkward_docs()
    got = mixing.mix(frame(spark, rows), block_words=block).collect()
    size, source = collections.Counter(), {}
    for r in rows:
        size[r[3]] += len(split_words(r[1]))
    want = plain_targets(dict(size))
    order = lambda t: tuple((x is None, x or 0) for x in t)
    assert sorted(((r.doc_id, r.size, r.source_size) for r in got), key=order) == sorted(
        ((r[0], len(split_words(r[1])), size[r[3]]) for r in rows), key=order)
    taken, target = collections.Counter(), {}
    for r in got:
        assert 0 <= r.taken <= 3 * r.size
        taken[r.source_size, r.target] += r.taken
    for s in size:
        match = [k for k in taken if k[0] == size[s] and abs(k[1] - want[s]) < 1e-6 * (1 + want[s])]
        assert match, (s, want[s])
        assert taken[match[0]] == int(match[0][1] + 0.5) or len([x for x in size if size[x] == size[s]]) > 1
    again = mixing.mix(frame(spark, rows).repartition(5), block_words=block).collect()
    assert sorted(map(tuple, got), key=order) == sorted(map(tuple, again), key=order)


def test_blocks_and_documents_hold_the_same_words(spark):
    rows = awkward_docs()
    df = frame(spark, rows)
    per_doc = mixing.mix(df, block_words=16).collect()
    blocks = mixing.mixed_blocks(df, block_words=16).collect()
    docs = mixing.mix_documents(df, block_words=16)
    total = sum(r.taken for r in per_doc)
    assert sum(b.n_words for b in blocks) == total and {b.shard for b in blocks} <= set(range(8))
    assert docs.columns == df.columns
    found = docs.collect()
    assert sum(len(split_words(r.text)) for r in found) == total
    by_source = lambda pairs: collections.Counter((s, w) for s, text in pairs for w in text)
    assert by_source((b.source, b.words) for b in blocks) == by_source((r.source, split_words(r.text)) for r in found)
    texts = {r[0]: r[1] for r in rows}
    for r in found:
        assert r.n_chars == len(r.text)
        assert r.text == texts.get(r.doc_id) or r.doc_id is None or set(split_words(r.text)) <= set(split_words(texts[r.doc_id]))


def test_cut_keeps_text_as_written():
    text = "  a\tb\n\nc d  e "
    assert mixing.cut_words(text, [(0, 2), (2, 3)]) == "a\tb\n\nc"
    assert mixing.cut_words(text, [(0, 1), (3, 5)]) == "a\nd  e"


def test_no_words_and_no_rows(spark):
    got = mixing.mix(frame(spark, [(1, None, None, "a", 0, 1, "", "", ""), (2, " ", None, None, 0, 1, "", "", "")])).collect()
    assert [(r.size, r.target, r.taken) for r in got] == [(0, 0.0, 0)] * 2
    assert mixing.mix(frame(spark, [])).count() == 0
    assert mixing.mix_documents(frame(spark, [])).count() == 0


def test_one_source_and_many(spark):
    rows = [(i, prose(__import__("random").Random(i), 40), "en", f"s{i}", 0, 1, "", "", "") for i in range(40)]
    got = mixing.mix(frame(spark, rows)).collect()
    assert abs(sum(r.taken for r in got) - 1600) <= 20 and max(r.taken for r in got) <= 120
    want = plain_targets({f"s{i}": 40 for i in range(40)})
    assert sorted(round(r.target, 6) for r in got) == sorted(round(v, 6) for v in want.values())
