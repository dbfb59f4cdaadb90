"""Trie nodes against a plain dictionary of prefixes."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from doorlens.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, k1 string, position string"


def plain_turns(rows):
    convs = {}
    for conv_id, turn, role, text, *_ in rows:
        if conv_id is not None:
            convs.setdefault(conv_id, []).append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [(r, t) for _, _, r, t in sorted(x)] for c, x in convs.items()}


def plain_branched(convs):
    out = {}
    for c, turns in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = convs.get(c - c % 5, [])[:h] + turns[h:]
    return out


def plain_nodes(convs):
    members = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    out = []
    for p, ids in members.items():
        under = [q for q in members if q[:len(p)] == p]
        children = [q for q in under if len(q) == len(p) + 1]
        leaves = [q for q in under if not any(len(r) == len(q) + 1 and r[:len(q)] == q for r in under)]
        saved = sum((len(members[q]) - 1) * len(q[-1][1].encode()) for q in under if q)
        ends = ",".join(map(str, sorted(c for c in ids if len(convs[c]) == len(p))))
        out.append((min(ids), len(p), min(members[p[:-1]]) if p else None, len(ids), len(children), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def conversations(seed=2):
    rng = random.Random(seed)
    rows = [(None, 1, "user", "lost", "a", "b"), (3, None, None, None, "a", "b"), (3, 5, "user", "é", "a", "b"), (3, 5, "user", "é", "a", "b"), (3, 5, "assistant", "x", "a", "b")]
    for c in range(5, 60):
        for t in range(rng.randrange(1, 12)):
            rows.append((c, t, rng.choice(["user", "assistant"]) if c % 7 else "user", rng.choice(["hi", "there", ""]) if t else "hello", "a", "b"))
    rows += [(1000 + i, t, "user", f"same {t}", "a", "b") for i in range(7) for t in range(30)]
    rows += [(2000 + i, t, "user", f"same {t}" if t < 20 + i else f"own {i}", "a", "b") for i in range(6) for t in range(26)]
    rows += [(5000, t, "user", "", "a", "b") for t in range(3)]
    return rows


@pytest.mark.parametrize("shard_turns", [1, 40, 200_000])
def test_nodes_equal_brute_force(spark, shard_turns):
    rows = conversations()
    df = spark.createDataFrame(rows, SCHEMA).repartition(6)
    got = prefix_trie.trie_nodes(prefix_trie.branched(df), shard_turns)
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == plain_nodes(plain_branched(plain_turns(rows)))


def test_conversations_as_given_and_empty_table(spark):
    rows = conversations(4)[:200]
    df = spark.createDataFrame(rows, SCHEMA)
    assert sorted(map(tuple, prefix_trie.trie_nodes(prefix_trie.as_given(df), 30).collect()), key=str) == plain_nodes(plain_turns(rows))
    assert prefix_trie.trie_nodes(prefix_trie.branched(df.filter("false"))).count() == 0


def test_a_hot_first_turn_is_divided(spark):
    rows = [(c, t, "user", "the same greeting" if t == 0 else f"{c % 50} {t}", "a", "b") for c in range(200) for t in range(4)]
    found = prefix_trie.dealt(prefix_trie.folded(prefix_trie.as_given(spark.createDataFrame(rows, SCHEMA))), 40).collect()
    assert {r.cut for r in found} == {2} and len({r.shard for r in found}) > 2


def test_double_array_holds_what_it_was_given():
    rng = np.random.default_rng(3)
    lengths = rng.integers(0, 9, 400)
    ids = rng.integers(0, 60, lengths.sum())
    trie = prefix_trie.packed_trie(lengths, ids)
    begin = np.cumsum(lengths) - lengths
    prefixes, at = {}, {}
    for i, (b, n) in enumerate(zip(begin, lengths)):
        state = 0
        for d in range(n):
            state = int(trie.step(np.array([state]), np.array([ids[b + d]]))[0])
            assert state > 0
            assert prefixes.setdefault(tuple(ids[b:b + d + 1]), state) == state and at.setdefault(state, tuple(ids[b:b + d + 1])) == tuple(ids[b:b + d + 1])
    children = {c for (c, *rest) in prefixes if not rest}
    assert all((trie.step(np.array([0]), np.array([c]))[0] >= 0) == (c in children) for c in range(-5, 70))
    assert (trie.check >= 0).sum() == len(prefixes) + 1
