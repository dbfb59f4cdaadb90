"""SimHash groups against all pairs."""

import random

import numpy as np
import pytest
import xxhash

from doorlens.llm import simhash
from tests.llm.fixtures import awkward_docs, frame, split_words


def plain_fingerprint(text):
    words = split_words("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i:i + 4]).encode(), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints, radius=4):
    label = {p: p for p in prints}

    def find(p):
        while label[p] != p:
            p = label[p]
        return p

    distinct = sorted(label)
    for i, a in enumerate(distinct):
        for b in distinct[i + 1:]:
            if (a ^ b).bit_count() <= radius:
                x, y = sorted((find(a), find(b)))
                label[y] = x
    return {p: find(p) for p in distinct}


def check(rows, got):
    prints = [plain_fingerprint(r[1]) for r in rows]
    root = plain_components(prints)
    low = {}
    for r, p in zip(rows, prints):
        if r[0] is not None:
            low[root[p]] = min(low.get(root[p], r[0]), r[0])
    order = lambda t: tuple((x is None, x or 0) for x in t)
    want = sorted(((r[0], f"{p:016x}", low.get(root[p])) for r, p in zip(rows, prints)), key=order)
    assert sorted(map(tuple, got), key=order) == want


def test_groups_equal_all_pairs(spark):
    rows = awkward_docs()
    check(rows, simhash.near_duplicates(frame(spark, rows)).collect())


def test_empty_table(spark):
    assert simhash.near_duplicates(frame(spark, [])).count() == 0


@pytest.mark.parametrize("tile", [4, 64, 4096])
def test_crowds_lose_no_link(spark, tile):
    """Fingerprints crowded on one piece: second pieces and tiles find the same components."""
    rng = random.Random(tile)
    centre = [rng.getrandbits(64) for _ in range(6)]
    prints = {0, (1 << 64) - 1, 1 << 63}
    for c in centre:
        for _ in range(40):
            value = c
            for b in rng.sample(range(64), rng.randrange(0, 7)):
                value ^= 1 << b
            prints.add(value)
    prints |= {(0x1FFF | rng.getrandbits(64)) & ~(1 << 20) for _ in range(150)}
    signed = [(int(np.uint64(p).view(np.int64)),) for p in prints]
    links = simhash.links(spark.createDataFrame(signed, "fp long"), tile=tile).collect()
    label = {p: p for p in prints}

    def find(p):
        while label[p] != p:
            p = label[p]
        return p

    for link in links:
        a, b = (int(np.int64(x).view(np.uint64)) for x in link)
        assert (a ^ b) != 0
        x, y = sorted((find(a), find(b)))
        label[y] = x
    assert {p: find(p) for p in prints} == plain_components(prints)


def test_carry_save_counts():
    rng = np.random.default_rng(0)
    values = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    values[100:200] = values[:100] ^ (np.uint64(1) << rng.integers(0, 64, 100).astype(np.uint64))
    planes = simhash._planes(values)
    for radius in range(0, 33):
        rows, blocks = np.repeat(np.arange(300), 5), np.tile(np.arange(5), 300)
        words = simhash.linked_words(planes, values, rows, blocks, radius)
        for r, b, w in zip(rows[::7], blocks[::7], words[::7]):
            for k in range(64):
                if 64 * b + k < 300:
                    assert bool(int(w) >> k & 1) == (int(values[r] ^ values[64 * b + k]).bit_count() <= radius)
