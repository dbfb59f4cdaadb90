"""Near duplicates by what texts share: 5-word shingles with a Jaccard similarity of 0.8 or more.

Each text is its set of shingle hashes; equal sets are one node. MinHash values in BANDS bands of
ROWS make buckets: two texts with Jaccard s share none with probability (1 - s ** ROWS) ** BANDS,
0.00035 at 0.8 and less above. Within buckets nothing is guessed: every link is an exact comparison of
two whole sets. First SimHash fingerprints of the sets make groups within a few bits, by the operator of
`simhash.py`, and each member is compared with its group's first; so is each member of a bucket with the
bucket's member of most company. Fingerprints alone miss most links near 0.8: buckets that then still hold
several components have all their pairs across components compared, tile against tile.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doorlens.llm import simhash
from doorlens.llm.common import ROW, field, let, packed, row_key, unpacked
from doorlens.operators.graph import components
from doorlens.session import land

SHINGLE = 5
BANDS = 20
ROWS = 5
SEED = 42
#: Most members of a bucket compared as one group; a crowd beyond it is split, never dropped.
TILE = 512
#: Hashes that are multiplied at once.
_RUN = 1 << 11
_RNG = np.random.default_rng(SEED)
_TIMES = _RNG.integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
_PLUS = _RNG.integers(0, 1 << 63, BANDS * ROWS, np.uint64)


def shingles(text: str | None) -> np.ndarray:
    """The distinct shingle hashes of a text, sorted; a text of fewer words is one shingle."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter((len(w) + 1 for w in words), np.int64, len(words))) - 1
    last = ends[SHINGLE - 1:].tolist() or [len(line)]
    starts = [0, *(ends[:len(last) - 1] + 1).tolist()]
    return np.unique(np.array([xxhash.xxh64_intdigest(line[a:b], SEED) for a, b in zip(starts, last)], np.uint64))


def bands(hashes: np.ndarray) -> list[int]:
    """The bucket keys of a set, one a band, as signed longs."""
    low = np.full(BANDS * ROWS, ~np.uint64(0))
    for at in range(0, len(hashes), _RUN):
        np.minimum(low, (hashes[at:at + _RUN, None] * _TIMES + _PLUS).min(0), out=low)
    keys = [xxhash.xxh64_intdigest(low[i * ROWS:(i + 1) * ROWS].tobytes(), i) for i in range(BANDS)]
    return np.array(keys, np.uint64).view(np.int64).tolist()


def _mapped(df: DataFrame, of_text, kinds: dict[str, str]) -> DataFrame:
    """Replaces column `text` by the columns that `of_text` makes of it."""
    at = df.columns.index("text")
    arrow = {"binary": pa.binary(), "array<long>": pa.list_(pa.int64()), "long": pa.int64()}

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [of_text(t.as_py()) for t in batch.column(at)]
            columns = [c for i, c in enumerate(batch.columns) if i != at]
            columns += [pa.array([m[i] for m in made], arrow[k]) for i, k in enumerate(kinds.values())]
            names = [n for i, n in enumerate(batch.schema.names) if i != at] + list(kinds)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.drop("text").schema.fields]
    return df.mapInArrow(work, ", ".join([*fields, *[f"`{n}` {k}" for n, k in kinds.items()]]))


def fingerprint(hashes: np.ndarray) -> int:
    """The SimHash of a set of shingle hashes, as a signed long: a bit is 1 if set in over half of them."""
    counts = np.zeros(simhash.BITS, np.int64)
    for at in range(0, len(hashes), _RUN):
        counts += np.unpackbits(hashes[at:at + _RUN].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.int64)[0])


def _signed(text: str | None) -> tuple[bytes, list[int], int]:
    hashes = shingles(text)
    return xxhash.xxh3_128_digest(hashes.tobytes(), SEED), bands(hashes), fingerprint(hashes)


def _set(text: str | None) -> tuple[list[int]]:
    return (shingles(text).view(np.int64).tolist(),)


def _alike(left: Column, right: Column) -> Column:
    """Jaccard of 0.8 or more, in whole numbers."""
    a, b = F.size(left), F.size(right)
    within = (5 * a >= 4 * b) & (5 * b >= 4 * a)
    return within & let(F.size(F.array_intersect(left, right)), lambda both: 5 * both >= 4 * (a + b - both))


def forest(sets: list[np.ndarray], label: np.ndarray, tiles: np.ndarray) -> list[tuple[int, int]]:
    """Links that join the labels of all similar members; between two tiles, of members of different tiles only."""
    sizes = np.array([len(s) for s in sets])
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    number = np.unique(np.concatenate(sets), return_inverse=True)[1]
    crossing = tiles.min() != tiles.max()
    label, found = label.copy(), []
    held = np.zeros(number.max() + 1, bool)
    for i in np.flatnonzero(tiles == 0) if crossing else range(len(sets)):
        may = (label != label[i]) & (tiles == 1 if crossing else True)
        if not may.any():
            continue
        mine = number[starts[i]:starts[i] + sizes[i]]
        held[mine] = True
        both = np.add.reduceat(held[number], starts, dtype=np.int64)
        held[mine] = False
        hits = np.flatnonzero(may & (5 * both >= 4 * (sizes[i] + sizes - both)))
        joined, first = np.unique(label[hits], return_index=True)
        found += [(int(i), int(j)) for j in hits[first]]
        label[np.isin(label, joined)] = label[i]
    return found


def _compare_sorted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (key, part), whole groups at a time, as links."""

    def links(rows: list[tuple]) -> pa.RecordBatch:
        label = np.unique([r[1] for r in rows], return_inverse=True)[1]
        found = forest([r[3] for r in rows], label, np.array([r[2] for r in rows]))
        ends = [pa.array([rows[pair[k]][0] for pair in found], pa.binary()) for k in (0, 1)]
        return pa.RecordBatch.from_arrays(ends, names=["src", "dst"])

    group, rows = None, []
    for batch in batches:
        keys, parts, nodes, labels, tiles = (batch.column(i).to_pylist() for i in range(5))
        for i in range(batch.num_rows):
            if group != (keys[i], parts[i]):
                if rows:
                    yield links(rows)
                group, rows = (keys[i], parts[i]), []
            rows.append((nodes[i], labels[i].hex(), tiles[i], batch.column(5)[i].values.to_numpy()))
    if rows:
        yield links(rows)


def _dealt(members: DataFrame, tile: int) -> DataFrame:
    """Members of buckets with their group: the bucket, or beyond `tile` each pair of its tiles."""
    sized = members.join(members.groupBy("key").agg(F.count(F.lit(1)).alias("n")), "key")
    tiles = F.when(F.col("n") <= tile, F.lit(1)).otherwise(F.ceil(F.col("n") / (tile // 2))).cast("int")
    sized = sized.withColumn("tiles", tiles).withColumn("mine", F.pmod(F.xxhash64("node", F.lit(1)), F.col("tiles")).cast("int"))
    sized = sized.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    return sized.select(
        "key", (F.least("mine", "other") * F.col("tiles") + F.greatest("mine", "other")).alias("part"), "node", "component",
        (F.col("mine") > F.col("other")).cast("int").alias("tile"))


def simhash_pairs(nodes: DataFrame) -> DataFrame:
    """(node, centre): each member of a group of fingerprints within the radius, with the group's first. `nodes` has distinct `node` and its `fp`."""
    prints = land(nodes.groupBy("fp").agg(F.min("node").alias("low")), "fingerprints")
    grouped = components(land(simhash.links(prints.select("fp")), "links")).withColumnRenamed("id", "fp")
    named = prints.join(grouped, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    first = named.groupBy("component").agg(F.min("low").alias("centre"))
    centres = named.join(first, "component").select("fp", "centre")
    return nodes.select("node", "fp").join(centres, "fp").filter("node != centre").select("node", "centre")


def groups(prints: DataFrame, texts: DataFrame, tile: int = TILE) -> DataFrame:
    """(node, component) of every node with a link. `prints` is a written table of k1, k2, node, bands and fp; `texts` has k1, k2, text."""
    nodes = prints.select("node", "bands", "fp").dropDuplicates(["node"])
    alike = land(simhash_pairs(nodes), "simhash-pairs")
    entries = nodes.select("node", F.explode("bands").alias("key"))
    crowds = entries.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    shared = land(entries.join(crowds, "key"), "buckets")
    company = shared.groupBy("node").agg(F.sum("n").alias("company"))
    one = prints.select("node", "k1", "k2").groupBy("node").agg(F.min(F.struct("k1", "k2")).alias("k"))
    wanted = company.select("node").unionByName(alike.select("node")).unionByName(alike.select(F.col("centre").alias("node"))).distinct()
    named = wanted.join(one, "node").select("node", "k.k1", "k.k2")
    found = texts.select("k1", "k2", "text").join(named, ["k1", "k2"]).dropDuplicates(["k1", "k2"])
    sets = land(_mapped(found.select("node", "text"), _set, {"hashes": "array<long>"}), "sets")
    central = shared.join(company, "node").groupBy("key").agg(F.max_by("node", F.struct("company", "node")).alias("centre"))
    pairs = shared.join(central, "key").filter("node != centre").select("node", "centre").unionByName(alike).distinct()
    both = pairs.join(sets, "node").join(sets.select(F.col("node").alias("centre"), F.col("hashes").alias("others")), "centre")
    first = land(both.filter(_alike(F.col("hashes"), F.col("others"))).select(F.col("node").alias("src"), F.col("centre").alias("dst")), "links")
    labels = land(components(first).withColumnRenamed("id", "node"), "labels")
    labelled = shared.select("key", "node").join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    labelled = land(labelled, "labelled")
    mixed = labelled.groupBy("key").agg(F.min("component").alias("a"), F.max("component").alias("b")).filter("a != b").select("key")
    rest = land(
        _dealt(labelled.join(mixed, "key", "left_semi"), tile).join(sets, "node")
        .repartition("key", "part").sortWithinPartitions("key", "part").select("key", "part", "node", "component", "tile", "hashes")
        .mapInArrow(_compare_sorted, "src binary, dst binary"), "links")
    return components(first.unionByName(rest)).withColumnRenamed("id", "node")


def drop_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", tile: int = TILE) -> DataFrame:
    """The documents, one of each group: the smallest doc_id (nulls last), one row of it. All columns stay.

    A group is what links of Jaccard 0.8 or more join. Null and blank texts are equal to one another.
    Of repeated rows one stays; an empty table gives none.
    """
    columns = docs.columns
    one, two = row_key(docs)
    keyed = packed(docs).select(ROW, one.alias("k1"), two.alias("k2"))
    narrow = keyed.select(field(doc_id).alias("doc_id"), field(text).alias("text"), "k1", "k2")
    prints = land(_mapped(narrow, _signed, {"node": "binary", "bands": "array<long>", "fp": "long"}), "signatures")
    grouped = prints.drop("bands", "fp").join(groups(prints, narrow, tile), "node", "left").withColumn("component", F.coalesce("component", "node"))
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "k1", "k2")
    kept = grouped.groupBy("component").agg(F.min_by(F.struct("k1", "k2"), order).alias("k")).select("k.k1", "k.k2")
    once = keyed.join(kept, ["k1", "k2"], "left_semi").dropDuplicates(["k1", "k2"])
    return unpacked(once, columns)
