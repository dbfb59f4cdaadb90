"""Prefix trie of conversations, in double arrays per prefix shard.

Equal sequences of turns are folded into one with its number of conversations. Sequences are then
dealt into shards by a prefix: the shortest one on a ladder of depths under which no more turns hang
than a task should hold, so a first turn that very many conversations share is divided further
down. A shard numbers its turns densely and packs the trie into BASE and CHECK: the child of node s
by turn c stands at BASE[s] + c, and CHECK there is s. Sequences walk it level by level, all at
once, and leave their counts on the nodes they pass. Below the shard's prefix a node is complete.
Nodes above it are shared between shards: their parts are added up over all shards afterwards, and
what they save themselves is added along their paths.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from doorlens.llm.common import key_pair
from doorlens.session import land

#: Most turns of different sequences under one shard prefix; a prefix beyond it is divided.
SHARD_TURNS = 200_000
#: Places tried for a node with several children before they go behind all others.
_TRIES = 64
NO_ENDS = hashlib.sha256(b"").hexdigest()


def turn_rows(conversations: DataFrame) -> DataFrame:
    """(conv_id, position, k1, k2, bytes) per turn: its place from 1, two hashes that identify role and text, its text's bytes.

    Turns go by `turn`, null first, ties by role and text. A null role or text is empty. Rows without conv_id are left out.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = conversations.filter(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("r"), text.alias("t"))
    one, two = key_pair(F.col("r"), F.col("t"))
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "r", "t"))
    return rows.select("conv_id", place.alias("position"), one.alias("k1"), two.alias("k2"), F.octet_length("t").cast("long").alias("bytes"))


def _sequences(rows: DataFrame) -> DataFrame:
    """(conv_id, turns) from rows with `part`, `position` and `keep`; a conversation without a kept row has no turns."""
    entry = F.when(F.col("keep"), F.struct("part", "position", "k1", "k2", "bytes"))
    ordered = F.array_sort(F.collect_list(entry))
    turns = F.transform(ordered, lambda t: F.struct(t.k1.alias("k1"), t.k2.alias("k2"), t.bytes.alias("bytes")))
    return rows.groupBy("conv_id").agg(turns.alias("turns"))


def as_given(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns) of the conversations as they stand."""
    return _sequences(turn_rows(conversations).withColumns({"part": F.lit(1), "keep": F.lit(True)}))


def branched(conversations: DataFrame, family: int = 5, shared: int = 9) -> DataFrame:
    """(conv_id, turns) of conversations rebuilt as branches of their family's first one.

    Conversation c begins with the first h turns of conversation c - c % family (fewer if it has fewer, none if it is
    absent) and goes on with its own turns after its first h, h = crc32 of decimal c, modulo `shared`.
    """
    rows = land(turn_rows(conversations), "turns")
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % shared
    own = rows.withColumns({"part": F.lit(1), "keep": F.col("position") > h})
    members = rows.select("conv_id").distinct().select("conv_id", (F.col("conv_id") - F.col("conv_id") % family).alias("first"), h.alias("h"))
    heads = rows.filter(F.col("position") < shared).withColumnRenamed("conv_id", "first")
    lent = members.join(heads, "first").filter(F.col("position") <= F.col("h"))
    return _sequences(own.unionByName(lent.select(*rows.columns, F.lit(0).alias("part"), F.lit(True).alias("keep"))))


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (s1, s2, conv_id) to one row per sequence: members, the smallest, and the hash of all ids; constant memory."""
    key, low, n, digest = None, 0, 0, None
    names = ["s1", "s2", "n", "low", "ends"]
    for batch in batches:
        s1, s2, ids = (batch.column(i).to_pylist() for i in range(3))
        done = []
        for a, b, c in zip(s1, s2, ids):
            if (a, b) != key:
                if key is not None:
                    done.append((*key, n, low, digest.hexdigest()))
                key, low, n, digest = (a, b), c, 1, hashlib.sha256(str(c).encode())
            else:
                n += 1
                digest.update(b",%d" % c)
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done)], names=names)
    if key is not None:
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*key, n, low, digest.hexdigest())], names=names)


def folded(sequences: DataFrame) -> DataFrame:
    """One row per distinct sequence: s1, s2, turns, n, low, ends."""
    keys = F.transform("turns", lambda t: F.struct(t.k1.alias("k1"), t.k2.alias("k2")))
    keyed = land(sequences.select("conv_id", "turns", F.xxhash64(keys).alias("s1"), F.xxhash64(F.lit(1), keys).alias("s2")), "sequences")
    ends = keyed.select("s1", "s2", "conv_id").repartition("s1", "s2").sortWithinPartitions("s1", "s2", "conv_id").mapInArrow(
        _ends, "s1 long, s2 long, n long, low long, ends string")
    return keyed.groupBy("s1", "s2").agg(F.any_value("turns").alias("turns")).join(ends, ["s1", "s2"])


def ladder(longest: int) -> list[int]:
    """Depths a prefix may be cut at, growing by half."""
    depths = [1]
    while depths[-1] < longest:
        depths.append(max(depths[-1] + 1, depths[-1] * 3 // 2))
    return depths


def dealt(distinct: DataFrame, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """Adds `cut`, the depth from which the sequence's nodes are its shard's alone, and `shard`.

    A sequence that ends before its prefix is small enough has no such depth: `cut` is behind its last turn.
    """
    found = distinct.agg(F.max(F.size("turns")), F.sum(F.size("turns"))).first()
    depths = ladder(found[0] or 1)
    shards = -(-(found[1] or 1) // shard_turns)
    keys = F.transform("turns", lambda t: F.struct(t.k1.alias("k1"), t.k2.alias("k2")))
    cuts = F.filter(F.array(*[F.lit(d) for d in depths]), lambda d: d <= F.size("turns"))
    marks = F.transform(cuts, lambda d: F.struct(
        d.alias("depth"), F.xxhash64(F.slice(keys, 1, d)).alias("m1"), F.xxhash64(F.lit(1), F.slice(keys, 1, d)).alias("m2")))
    rows = distinct.select("s1", "s2", F.size("turns").alias("size"), F.explode(marks).alias("m")).select("s1", "s2", "size", "m.*")
    large = rows.groupBy("m1", "m2").agg(F.sum("size").alias("held")).filter(F.col("held") > shard_turns).select("m1", "m2", F.lit(True).alias("large"))
    small = rows.join(large, ["m1", "m2"], "left").filter("large is null").groupBy("s1", "s2").agg(
        F.min(F.struct("depth", "m1", "m2")).alias("m"))
    home = F.xxhash64(F.coalesce("m.m1", "s1"), F.coalesce("m.m2", "s2"))
    return distinct.join(small, ["s1", "s2"], "left").select(
        *distinct.columns, F.coalesce("m.depth", F.size("turns") + 1).alias("cut"), F.pmod(home, F.lit(shards)).alias("shard"))


class DoubleArray:
    """A trie over dense ids: the child of s by c stands at base[s] + c, where check is s. Node 0 is the root."""

    def __init__(self):
        self.base, self.check, self.free = np.zeros(1024, np.int64), np.full(1024, -1, np.int64), 1
        self.check[0] = 0

    def _room(self, upto: int) -> None:
        if upto > len(self.check):
            more = max(upto, 2 * len(self.check)) - len(self.check)
            self.base = np.concatenate([self.base, np.zeros(more, np.int64)])
            self.check = np.concatenate([self.check, np.full(more, -1, np.int64)])

    def _free_slots(self, n: int) -> np.ndarray:
        """The first n free slots."""
        while True:
            slots = np.flatnonzero(self.check[self.free:] == -1)[:n] + self.free
            if len(slots) == n:
                return slots
            self._room(len(self.check) + n)

    def add_level(self, parents: np.ndarray, ids: np.ndarray) -> None:
        """Children `ids` of `parents`, pairs distinct and sorted by parent, then id; each parent comes once in all."""
        if not len(parents):
            return
        starts = np.flatnonzero(np.concatenate([[True], parents[1:] != parents[:-1]]))
        sizes = np.diff(np.append(starts, len(parents)))
        for at, size in zip(starts[sizes > 1].tolist(), sizes[sizes > 1].tolist()):
            self._place(parents[at], ids[at:at + size])
        lone = starts[sizes == 1]
        if len(lone):
            slots = self._free_slots(len(lone))
            self.base[parents[lone]] = slots - ids[lone]
            self.check[slots] = parents[lone]
            self.free = int(slots[-1]) + 1

    def _place(self, parent: int, ids: np.ndarray) -> None:
        offsets = ids - ids[0]
        for slot in self._free_slots(_TRIES):
            self._room(int(slot + offsets[-1]) + 1)
            if (self.check[slot + offsets] == -1).all():
                break
        else:
            slot = len(self.check)
            self._room(slot + int(offsets[-1]) + 1)
        self.base[parent] = slot - ids[0]
        self.check[slot + offsets] = parent

    def step(self, states: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """The children of `states` by `ids`; -1 where there is none."""
        at = self.base[states] + ids
        inside = (at >= 0) & (at < len(self.check))
        at = np.where(inside, at, 0)
        return np.where(inside & (self.check[at] == states) & (at != 0), at, -1)


def dense_ids(k1: np.ndarray, k2: np.ndarray) -> np.ndarray:
    """0, 1, ... for the distinct pairs."""
    order = np.lexsort((k2, k1))
    fresh = np.ones(len(k1), bool)
    fresh[1:] = (k1[order[1:]] != k1[order[:-1]]) | (k2[order[1:]] != k2[order[:-1]])
    ids = np.empty(len(k1), np.int64)
    ids[order] = np.cumsum(fresh) - 1
    return ids


def packed_trie(lengths: np.ndarray, ids: np.ndarray) -> DoubleArray:
    """The trie of sequences that stand one after another in `ids`, built level by level."""
    trie, begin = DoubleArray(), np.cumsum(lengths) - lengths
    states = np.zeros(len(lengths), np.int64)
    for depth in range(int(lengths.max(initial=0))):
        going = np.flatnonzero(lengths > depth)
        c = ids[begin[going] + depth]
        order = np.lexsort((c, states[going]))
        s, c_sorted = states[going][order], c[order]
        fresh = np.ones(len(order), bool)
        fresh[1:] = (s[1:] != s[:-1]) | (c_sorted[1:] != c_sorted[:-1])
        trie.add_level(s[fresh], c_sorted[fresh])
        states[going] = trie.step(states[going], c)
    return trie


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


NODE = pa.schema([
    ("p1", pa.int64()), ("p2", pa.int64()), ("q1", pa.int64()), ("q2", pa.int64()), ("depth", pa.int64()), ("shared", pa.bool_()), ("under_shared", pa.bool_()),
    ("low", pa.int64()), ("parent_low", pa.int64()), ("n", pa.int64()), ("bytes", pa.int64()), ("children", pa.int64()), ("leaves", pa.int64()),
    ("saved", pa.int64()), ("ends", pa.string()), ("path", pa.list_(pa.struct([("a1", pa.int64()), ("a2", pa.int64())]))),
])
NODE_COLUMNS = (
    "p1 long, p2 long, q1 long, q2 long, depth long, shared boolean, under_shared boolean, low long, parent_low long, n long, bytes long, "
    "children long, leaves long, saved long, ends string, path array<struct<a1:long,a2:long>>"
)


def shard_nodes(table: pa.Table) -> pa.Table:
    """The nodes of one shard. Of a shared node, children, leaves and saved count only what hangs below in complete nodes."""
    table = table.combine_chunks()
    turns = table.column("turns").combine_chunks()
    offsets = turns.offsets.to_numpy().astype(np.int64)
    lengths, flat = np.diff(offsets), turns.values.slice(int(offsets[0]), int(offsets[-1] - offsets[0]))
    k1, k2, size = (flat.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3))
    weight, low_in, cut = (table.column(c).to_numpy().astype(np.int64) for c in ("n", "low", "cut"))
    ids = dense_ids(k1, k2)
    trie = packed_trie(lengths, ids)
    total = len(trie.check)
    n, low = np.zeros(total, np.int64), np.full(total, np.iinfo(np.int64).max)
    depth, size_of, shared = np.full(total, -1, np.int64), np.zeros(total, np.int64), np.zeros(total, bool)
    key = np.zeros((2, total), np.uint64)
    ends: dict[int, str] = {}
    n[0], low[0], depth[0], shared[0] = weight.sum(), low_in.min(), 0, True
    begin, states = np.cumsum(lengths) - lengths, np.zeros(len(lengths), np.int64)
    said = table.column("ends").to_pylist()
    for d in range(int(lengths.max(initial=0)) + 1):
        ends |= {int(states[i]): said[i] for i in np.flatnonzero(lengths == d)}
        going = np.flatnonzero(lengths > d)
        if not len(going):
            break
        at = begin[going] + d
        to = trie.step(states[going], ids[at])
        np.add.at(n, to, weight[going])
        np.minimum.at(low, to, low_in[going])
        depth[to], size_of[to], shared[to] = d + 1, size[at], d + 1 < cut[going]
        for lane, odd in ((0, 0x9E3779B97F4A7C15), (1, 0xD1342543DE82EF95)):
            mixed = _mix(key[lane, states[going]] * np.uint64(odd) + k1[at].view(np.uint64))
            key[lane, to] = _mix(mixed * np.uint64(odd) + k2[at].view(np.uint64))
        states[going] = to
    nodes = np.flatnonzero(depth >= 0)
    nodes = nodes[np.argsort(depth[nodes], kind="stable")]
    parent = trie.check
    children, leaves, saved = (np.zeros(total, np.int64) for _ in range(3))
    below = nodes[1:]
    own = below[~shared[below]]
    np.add.at(children, parent[own], 1)
    leaves[own] = children[own] == 0
    saved[own] = (n[own] - 1) * size_of[own]
    levels = np.searchsorted(depth[nodes], np.arange(depth[nodes[-1]] + 2))
    for d in range(len(levels) - 2, 0, -1):
        level = nodes[levels[d]:levels[d + 1]]
        np.add.at(leaves, parent[level], leaves[level])
        np.add.at(saved, parent[level], saved[level])
    signed = key.view(np.int64)
    top = nodes == 0
    up = parent[nodes]
    under = shared[up] & ~top
    paths = []
    for node in nodes[shared[nodes]].tolist():
        path, at = [], node
        while at:
            at = int(parent[at])
            path.append({"a1": int(signed[0, at]), "a2": int(signed[1, at])})
        paths.append(path)
    each = iter(paths)
    return pa.Table.from_arrays([
        pa.array(signed[0, nodes]), pa.array(signed[1, nodes]), pa.array(signed[0, up], mask=top), pa.array(signed[1, up], mask=top),
        pa.array(depth[nodes]), pa.array(shared[nodes]), pa.array(under), pa.array(low[nodes]), pa.array(low[up], mask=top | under), pa.array(n[nodes]),
        pa.array(size_of[nodes]), pa.array(children[nodes]), pa.array(leaves[nodes]), pa.array(saved[nodes]),
        pa.array([ends.get(x) for x in nodes.tolist()], pa.string()),
        pa.array([next(each) if s else None for s in shared[nodes]], NODE.field("path").type),
    ], schema=NODE)


def trie_nodes(sequences: DataFrame, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """One row per distinct prefix of the sequences (conv_id, turns), the empty one included.

    conv_id is the smallest member, parent_conv_id that of the node above (null at the root), n_convs the members, n_children
    the nodes one turn longer, n_leaves the childless nodes at or below it, saved_tokens the sum at or below it of members less
    one times the bytes of the last text, ends_sha256 the hash of the ids of members without a further turn, ascending, joined
    by commas. Repeated conversations are members each; an empty table has no node, not even a root.
    """
    distinct = land(folded(sequences), "folded")
    nodes = land(dealt(distinct, shard_turns).groupBy("shard").applyInArrow(shard_nodes, NODE_COLUMNS), "nodes")
    merged = land(
        nodes.filter("shared").groupBy("p1", "p2").agg(
            F.any_value("q1").alias("q1"), F.any_value("q2").alias("q2"), F.any_value("depth").alias("depth"), F.min("low").alias("low"), F.sum("n").alias("n"),
            F.any_value("bytes").alias("bytes"), F.sum("children").alias("children"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"),
            F.max("ends").alias("ends"), F.any_value("path").alias("path"),
        ), "shared")
    inner = merged.filter("depth > 0").groupBy(F.col("q1").alias("p1"), F.col("q2").alias("p2")).agg(F.count(F.lit(1)).alias("inner"))
    whole = merged.join(inner, ["p1", "p2"], "left").withColumn("children", F.col("children") + F.coalesce("inner", F.lit(0))).withColumns({
        "leaf": (F.col("children") == 0).cast("long"), "own": (F.col("n") - 1) * F.col("bytes")})
    whole = land(whole, "whole")
    # What a shared node adds to itself and to everything above it; all of that is shared.
    added = whole.filter("leaf > 0 or own > 0").select(
        F.explode(F.concat("path", F.array(F.struct(F.col("p1").alias("a1"), F.col("p2").alias("a2"))))).alias("a"), "leaf", "own"
    ).groupBy(F.col("a.a1").alias("p1"), F.col("a.a2").alias("p2")).agg(F.sum("leaf").alias("more_leaves"), F.sum("own").alias("more_saved"))
    upper = whole.join(added, ["p1", "p2"], "left").select(
        "q1", "q2", "low", "depth", "n", "children", (F.col("leaves") + F.coalesce("more_leaves", F.lit(0))).alias("leaves"),
        (F.col("saved") + F.coalesce("more_saved", F.lit(0))).alias("saved"), "ends")
    lows = whole.select(F.col("p1").alias("q1"), F.col("p2").alias("q2"), F.col("low").alias("parent_low"))
    columns = ["q1", "q2", "low", "depth", "n", "children", "leaves", "saved", "ends"]
    hanging = upper.unionByName(nodes.filter("under_shared and not shared").select(*columns)).join(lows, ["q1", "q2"], "left")
    deep = nodes.filter("not under_shared and not shared").select(*columns, "parent_low")
    return deep.unionByName(hanging).select(
        F.col("low").alias("conv_id"), "depth", F.col("parent_low").alias("parent_conv_id"), F.col("n").alias("n_convs"), F.col("children").alias("n_children"),
        F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("ends", F.lit(NO_ENDS)).alias("ends_sha256"),
    )
