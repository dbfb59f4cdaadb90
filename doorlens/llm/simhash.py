"""SimHash near-duplicate groups: every pair of fingerprints within the radius is found.

Fingerprints are worked out per document from its 4-word shingles. Equal fingerprints are one
node. A fingerprint is cut into radius + 1 pieces; two within the radius agree on one piece, so
only fingerprints that share a piece are compared. A crowd that shares a piece is dealt again by
pieces of the remaining bits (the same argument holds for them), and what is still crowded is
compared tile against tile, so no task holds more than two tiles. Within a group the members'
bits lie in vertical planes, 64 members to a word; distances of one member to 64 others grow in
carry-save counters, and a word is given up once all its 64 distances exceed the radius. A task
hands on a spanning forest of what it links, not the pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doorlens.operators.graph import components
from doorlens.session import land

BITS = 64
SHINGLE = 4
RADIUS = 4
SEED = 42
#: Most fingerprints compared as one group; a crowd beyond it is split, never dropped.
TILE = 4096
#: Hashes whose bits are counted at once.
_RUN = 1 << 14
#: Probe-and-word pairs worked on at once.
_BATCH = 1 << 16


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The 64-bit SimHash of one text; 0 for a text without a word."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    n = max(1, len(words) - shingle + 1)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    last = ends[min(shingle, len(words)) - 1:]
    counts = np.zeros(BITS, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, _RUN):
        hashes = np.array(
            [digest(line[a:b], SEED) for a, b in zip(starts[at:min(n, at + _RUN)].tolist(), last[at:at + _RUN].tolist())],
            np.uint64,
        )
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.uint64)[0])


def with_fingerprint(df: DataFrame, text: str, out: str) -> DataFrame:
    """Replaces column `text` by its fingerprint as a signed long."""
    at = df.columns.index(text)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.fromiter((fingerprint(t.as_py()) for t in batch.column(at)), np.uint64, batch.num_rows)
            columns = [c for i, c in enumerate(batch.columns) if i != at] + [pa.array(prints.view(np.int64))]
            names = [n for i, n in enumerate(batch.schema.names) if i != at] + [out]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    kept = df.drop(text)
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields]
    return df.mapInArrow(work, ", ".join([*fields, f"`{out}` long"]))


def piece_masks(bits: list[int], pieces: int) -> list[int]:
    """`bits` dealt into `pieces` masks of nearly equal size."""
    return [sum(1 << b for b in bits[i * len(bits) // pieces:(i + 1) * len(bits) // pieces]) for i in range(pieces)]


def _long(mask: int) -> Column:
    """64 unsigned bits as Spark's signed long."""
    return F.lit(mask - (1 << 64) if mask >> 63 else mask).cast("long")


def linked_words(planes: np.ndarray, probes: np.ndarray, rows: np.ndarray, blocks: np.ndarray, radius: int) -> np.ndarray:
    """For each (probe row, block) pair the 64-bit word of block members within `radius` of the probe.

    `planes[b, w]` holds bit b of the 64 members of block w. Distances are counted in vertical
    carry-save counters: two planes enter the ones at a time and their carry moves up a level.
    A pair leaves the work once every distance in its word exceeds the radius.
    """
    levels = max(1, (radius + 1).bit_length())
    found = np.zeros(len(rows), np.uint64)
    alive = np.arange(len(rows))
    counters = np.zeros((levels, len(rows)), np.uint64)
    over = np.zeros(len(rows), np.uint64)
    values, where = probes[rows], blocks
    for bit in range(0, BITS, 2):
        a = planes[bit, where] ^ (np.uint64(0) - ((values >> np.uint64(bit)) & np.uint64(1)))
        b = planes[bit + 1, where] ^ (np.uint64(0) - ((values >> np.uint64(bit + 1)) & np.uint64(1)))
        half = counters[0] ^ a
        carry = (counters[0] & a) | (half & b)
        counters[0] = half ^ b
        for level in range(1, levels):
            counters[level], carry = counters[level] ^ carry, counters[level] & carry
        over |= carry
        if bit % 8 == 6 and bit < BITS - 2:
            live = ~(over | _exceeds(counters, radius)) != 0
            if live.sum() < 0.7 * len(live):
                alive, values, where = alive[live], values[live], where[live]
                counters, over = counters[:, live], over[live]
                if not len(alive):
                    return found
    found[alive] = ~(over | _exceeds(counters, radius))
    return found


def _exceeds(counters: np.ndarray, radius: int) -> np.ndarray:
    """Which of the vertical counters exceed `radius`: a comparison from the highest level down."""
    above = np.zeros(counters.shape[1], np.uint64)
    equal = ~above
    for level in range(len(counters) - 1, -1, -1):
        if radius >> level & 1:
            equal = equal & counters[level]
        else:
            above |= equal & counters[level]
            equal = equal & ~counters[level]
    return above


def _planes(values: np.ndarray) -> np.ndarray:
    """Bit planes of `values`, 64 to a word; the last word is filled up with zeros."""
    padded = np.zeros(-(-len(values) // 64) * 64, np.uint64)
    padded[:len(values)] = values
    bits = np.unpackbits(padded.view(np.uint8).reshape(-1, 64, 8), axis=2, bitorder="little")
    packed_bits = np.packbits(bits.transpose(2, 0, 1), axis=2, bitorder="little")
    return np.ascontiguousarray(packed_bits).view(np.uint64)[:, :, 0]


def forest(values: np.ndarray, starts: np.ndarray, tiles: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (value, smallest index value of its tree) that span everything within `radius` inside each group.

    `starts` are the groups' first positions. Where a group holds two tiles (`tiles` 0 and 1 both
    occur), only members of different tiles are compared: each tile alone is another group's work.
    """
    n = len(values)
    ends = np.append(starts[1:], n)
    # Groups are padded to whole words, so that a word never mixes groups.
    sizes = ends - starts
    n_words = -(-sizes // 64)
    first_word = np.concatenate([[0], np.cumsum(n_words)])[:-1]
    group = np.repeat(np.arange(len(starts)), sizes)
    slot = first_word[group] * 64 + np.arange(n) - starts[group]
    padded = np.zeros(int(n_words.sum()) * 64, np.uint64)
    used = np.zeros(len(padded), bool)
    at = np.zeros(len(padded), np.int64)
    padded[slot], used[slot], at[slot] = values, True, np.arange(n)
    planes = _planes(padded)
    valid = np.packbits(used, bitorder="little").view(np.uint64)
    second = np.zeros(len(padded), bool)
    second[slot] = tiles == 1
    seconds = np.packbits(second, bitorder="little").view(np.uint64)
    mixed = np.zeros(len(starts), bool)
    np.logical_or.at(mixed, group, tiles == 1)
    mixed &= np.logical_or.reduceat(tiles == 0, starts) if n else mixed
    parent = np.arange(n)
    # Every member probes the words of its group from its own word on.
    own_word = slot // 64
    todo = np.where(mixed[group], np.where(tiles == 0, n_words[group], 0), first_word[group] + n_words[group] - own_word)
    begin = np.where(mixed[group], first_word[group], own_word)
    bounds = np.concatenate([[0], np.cumsum(todo)])
    for lo in range(0, int(bounds[-1]), _BATCH):
        pair = np.arange(lo, min(lo + _BATCH, int(bounds[-1])))
        rows = np.searchsorted(bounds, pair, "right") - 1
        blocks = begin[rows] + pair - bounds[rows]
        hit = linked_words(planes, values, rows, blocks, radius) & valid[blocks]
        crossing = mixed[group[rows]]
        hit = np.where(crossing, hit & seconds[blocks], hit)
        same = ~crossing & (blocks == own_word[rows])
        shift = (slot[rows] % 64).astype(np.uint64)
        later = ~((np.uint64(2) << shift) - np.uint64(1))
        hit = np.where(same, hit & later, hit)
        some = np.flatnonzero(hit)
        if not len(some):
            continue
        bits = np.unpackbits(hit[some].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        which, offset = np.nonzero(bits)
        parent = _union(parent, rows[some[which]], at[blocks[some[which]] * 64 + offset])
    child = np.flatnonzero(parent != np.arange(n))
    return values[child], values[parent[child]]


def _union(parent: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Joins the trees of `left[i]` and `right[i]`; every member then points at its tree's smallest index."""
    while True:
        a, b = parent[left], parent[right]
        apart = a != b
        if not apart.any():
            return parent
        left, right, a, b = left[apart], right[apart], a[apart], b[apart]
        parent = parent.copy()
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent = up


def _compare_sorted(radius: int):
    """Arrow batches sorted by group, whole groups at a time, as links."""

    def links(groups: list[np.ndarray], fps: list[np.ndarray], tiles: list[np.ndarray]) -> pa.RecordBatch:
        g, v, t = np.concatenate(groups), np.concatenate(fps).view(np.uint64), np.concatenate(tiles)
        starts = np.flatnonzero(np.concatenate([[True], (g[1:] != g[:-1]).any(1)]))
        u, w = forest(v, starts, t, radius)
        return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(w.view(np.int64))], names=["src", "dst"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups, fps, tiles = [], [], []
        for batch in batches:
            if not batch.num_rows:
                continue
            g = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3)], 1)
            v, t = batch.column(3).to_numpy(), batch.column(4).to_numpy()
            fresh = not groups or (g[0] != groups[-1][-1]).any()
            if fresh and groups:
                yield links(groups, fps, tiles)
                groups, fps, tiles = [], [], []
            # All but the last group of a batch are complete.
            cut = int(np.flatnonzero((g != g[-1]).any(1))[-1]) + 1 if (g != g[-1]).any() else 0
            if cut:
                yield links([*groups, g[:cut]], [*fps, v[:cut]], [*tiles, t[:cut]])
                groups, fps, tiles = [], [], []
            groups.append(g[cut:]), fps.append(v[cut:]), tiles.append(t[cut:])
        if groups:
            yield links(groups, fps, tiles)

    return work


def _dealt(prints: DataFrame, masks: list[int]) -> DataFrame:
    """Each fingerprint once per mask of its table: (`table`, `key`, `fp`)."""
    entries = [F.struct(_long(m).alias("table"), F.col("fp").bitwiseAND(_long(m)).alias("key")) for m in masks]
    return prints.select("fp", F.explode(F.array(*entries)).alias("e")).select("e.table", "e.key", "fp")


def links(prints: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """(src, dst) fingerprints whose trees are the components of "within `radius` bits".

    `prints` has distinct, non-null `fp`. No pair is dropped whatever the crowding: a first-level
    crowd is dealt by second pieces, a second-level crowd tile by tile.
    """
    first = piece_masks(list(range(BITS)), radius + 1)
    second = []
    for mask in first:
        rest = [b for b in range(BITS) if not mask >> b & 1]
        second += [_long(mask), F.array(*[_long(mask | m) for m in piece_masks(rest, radius + 1)])]
    once = _dealt(prints, first)
    crowds = once.groupBy("table", "key").agg(F.count(F.lit(1)).alias("n"))
    sized = once.join(crowds.filter(F.col("n") > 1), ["table", "key"])
    calm = sized.filter(F.col("n") <= tile).select("table", "key", F.lit(0).alias("part"), "fp", F.lit(0).alias("tile"))
    again = (
        sized.filter(F.col("n") > tile)
        .select("fp", F.explode(F.element_at(F.create_map(*second), F.col("table"))).alias("table"))
        .select("table", F.col("fp").bitwiseAND(F.col("table")).alias("key"), "fp")
        .distinct()
    )
    deep = again.join(again.groupBy("table", "key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1), ["table", "key"])
    tiles = F.ceil(F.col("n") / (tile // 2)).cast("int")
    mine = F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int")
    small = deep.filter(F.col("n") <= tile).select("table", "key", F.lit(0).alias("part"), "fp", F.lit(0).alias("tile"))
    large = deep.filter(F.col("n") > tile).withColumn("tiles", tiles).withColumn("mine", mine)
    # Tile i meets every tile j: pair (i, j), i < j, has the number i * tiles + j; (i, i) is the tile with itself.
    large = large.select("table", "key", "fp", "mine", "tiles", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("other"))
    large = large.select(
        "table", "key", (F.least("mine", "other") * F.col("tiles") + F.greatest("mine", "other") + 1).cast("int").alias("part"),
        "fp", (F.col("mine") > F.col("other")).cast("int").alias("tile"),
    )
    dealt = calm.unionByName(small).unionByName(large)
    return (
        dealt.repartition("table", "key", "part")
        .sortWithinPartitions("table", "key", "part")
        .mapInArrow(_compare_sorted(radius), "src long, dst long")
    )


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id.

    component_id is the smallest doc_id among all documents reachable over links of at most
    `radius` differing bits. A null or blank text has fingerprint zero and is linked like any
    other; a repeated row comes out as often as it came in; a null doc_id is kept and never names
    a component unless the component has no other, which is then null. An empty table gives none.
    """
    prints = land(with_fingerprint(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), "text", "fp"), "fingerprints")
    return components_of(prints).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def components_of(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Adds `component` (a fingerprint) and `component_id` to a written table with `doc_id` and `fp`."""
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("low"))
    grouped = components(land(links(nodes.select("fp"), radius), "links")).withColumnsRenamed({"id": "fp"})
    labelled = nodes.join(grouped, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    lowest = labelled.groupBy("component").agg(F.min("low").alias("component_id"))
    names = land(labelled.join(lowest, "component").select("fp", "component", "component_id"), "components")
    return prints.join(names, "fp")
