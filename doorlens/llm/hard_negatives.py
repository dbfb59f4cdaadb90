"""Hard negatives over lists that the anchors of a cluster share.

Rows are dealt into cells by the nearest of a few directions (fitted on a bounded sample), cells into
blocks of bounded size, and the anchors of a cell into groups. For an anchor group and a block the
block's rows are sorted once, by an upper bound of their score with any member: a row at angle t from
the group's middle direction is at least t - r away from every member when r is the group's reach, so
its score is at most |anchor| |row| cos(t - r). Every member walks this one list from the top and stops
as soon as the next bound is below the worst of what it still wants; the stop is certified, no row
behind it can matter. Each group walks each block, so results are exact, and what a group has found
in one block shortens its walk in the next that the same task holds.

Positives come first, one list of same-label rows an anchor. Their scores open one window of scores
each, and a second walk fills these with rows of other labels.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doorlens.operators.ordering import top_per_key
from doorlens.session import land

POSITIVES = 5
NEGATIVES = 5
#: A negative scores between these percentages of its positive.
LOW_PERCENT, HIGH_PERCENT = 80, 100
SCALE = 256
#: Scaled components beyond this are cut to it, so that a score of up to 2,048 components fits a long.
LIMIT = 1 << 26
#: Anchors the directions are fitted on, and how many directions.
SAMPLE, CELLS = 2048, 32
#: Rows of a block, anchors of a group (on average).
BLOCK, MEMBERS = 4096, 512
#: Rows of the list a walk takes at a time.
_STEP = 512
_GROUPS_HELD = 128


def vectors(rows: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label") -> DataFrame:
    """(key, vec_id, label, q): components times 256, rounded down, as whole numbers; `key` identifies the row.

    Rows with a null id, label or vector or a null or non-finite component are left out; repeated rows are one row.
    """
    values = F.transform(F.col(f"`{embedding}`"), lambda x: x.cast("double"))
    fit = F.forall("x", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    scaled = F.transform("x", lambda x: F.floor(F.least(F.greatest(x * SCALE, F.lit(-float(LIMIT))), F.lit(float(LIMIT)))).cast("int"))
    given = rows.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), F.col(f"`{label}`").cast("long").alias("label"), values.alias("x"))
    whole = given.filter("vec_id is not null and label is not null and x is not null").filter(fit).select("vec_id", "label", scaled.alias("q")).distinct()
    return whole.select(F.xxhash64("vec_id", "label", "q").alias("key"), "vec_id", "label", "q")


def _matrix(column: pa.ListArray, width: int | None = None) -> np.ndarray:
    """Lists of whole numbers as rows; shorter ones are filled up with zeros."""
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    width = int(lengths.max(initial=0)) if width is None else width
    if (lengths == width).all():
        return flat.reshape(len(lengths), width)
    out = np.zeros((len(lengths), width), flat.dtype)
    row = np.repeat(np.arange(len(lengths)), lengths)
    place = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    inside = place < width
    out[row[inside], place[inside]] = flat[inside]
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(norm > 0, norm, 1)


def fit_directions(sample: list[list[int]], cells: int = CELLS, rounds: int = 8) -> np.ndarray:
    """Unit vectors by spherical k-means on the sample; fewer if it has fewer different directions."""
    if not sample:
        return np.zeros((1, 0))
    width = max(map(len, sample))
    x = np.unique(_unit(np.array([[*r, *[0] * (width - len(r))] for r in sample], float)), axis=0)
    chosen = [x[0]]
    nearest = x @ chosen[0]
    while len(chosen) < min(cells, len(x)):
        chosen.append(x[int(np.argmin(nearest))])
        nearest = np.maximum(nearest, x @ chosen[-1])
    centres = np.array(chosen)
    for _ in range(rounds):
        home = np.argmax(x @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, home, x)
        centres = np.where(np.linalg.norm(sums, axis=1, keepdims=True) > 0, _unit(sums), centres)
    return centres


def _celled(rows: DataFrame, centres: np.ndarray) -> DataFrame:
    """Adds `cell`, the nearest direction, to rows (key, vec_id, label, q)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(3), centres.shape[1]).astype(float)
            cell = np.argmax(x @ centres.T, axis=1) if batch.num_rows else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int64))], names=[*batch.schema.names, "cell"])

    return rows.mapInArrow(work, "key long, vec_id long, label long, q array<int>, cell long")


PACKED = "pack long, width int, keys binary, ids binary, labels binary, q binary, windows binary"


def _pack(key: tuple, table: pa.Table) -> pa.Table:
    table = table.combine_chunks()
    q = _matrix(table.column("q").combine_chunks())
    q = q.astype(np.int16 if np.abs(q).max(initial=0) < 1 << 15 else np.int32)
    packed = [np.ascontiguousarray(table.column(c).to_numpy().astype(np.int64)).tobytes() for c in ("key", "vec_id", "label")]
    windows = b""
    if "windows" in table.column_names:
        lists = table.column("windows").to_pylist()
        width = max(map(len, lists), default=0)
        # A window no score lies in fills up the rows.
        windows = np.array([[*[(w["low"], w["high"]) for w in each], *[(1, 0)] * (width - len(each))] for each in lists], np.int64).tobytes()
    row = [key[0].as_py(), q.shape[1], *packed, q.tobytes(), windows]
    kinds = [pa.int64(), pa.int32(), *[pa.binary()] * 5]
    return pa.Table.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], names=["pack", "width", "keys", "ids", "labels", "q", "windows"])


def packed_rows(celled: DataFrame, size: int) -> DataFrame:
    """Rows with their `pack`: cells cut by hash into as many packs as their rows need at `size` rows each."""
    counts = celled.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / size).alias("packs"))
    # One row per direction.
    return celled.join(F.broadcast(counts), "cell").withColumn("pack", F.col("cell") * (1 << 32) + F.pmod("key", F.col("packs"))).drop("cell", "packs")


class Walk:
    """What the members of a group want and have found: for each member and window of scores its best rows."""

    def __init__(self, members: np.ndarray, lows: np.ndarray, highs: np.ndarray, want: int):
        self.members, self.lows, self.highs, self.want = members, lows, highs, want
        n, self.windows = lows.shape
        self.owner, self.score, self.id, self.key = (np.zeros(0, np.int64) for _ in range(4))
        # Scores below the floor are of no use; a window that holds nothing has none.
        self.floor = np.where(lows <= highs, lows.astype(float), np.inf)
        size = np.linalg.norm(members.astype(float), axis=1)
        self.size = size
        middle = _unit(members.astype(float)).sum(0)
        length = np.linalg.norm(middle)
        self.middle = middle / length if length > 0 else None
        if self.middle is None:
            self.reach = np.pi
        else:
            cos = np.where(size > 0, members @ self.middle / np.where(size > 0, size, 1), 1.0)
            self.reach = float(np.arccos(np.clip(cos, -1, 1)).max(initial=0.0)) + 1e-7

    def bounds(self, rows: np.ndarray) -> np.ndarray:
        """For each row the most it can score with a member of length one."""
        size = np.linalg.norm(rows.astype(float), axis=1)
        if self.middle is None:
            return size
        cos = np.where(size > 0, rows @ self.middle / np.where(size > 0, size, 1), 1.0)
        return size * np.cos(np.maximum(np.arccos(np.clip(cos, -1, 1)) - self.reach, 0.0))

    def take(self, rows: np.ndarray, ids: np.ndarray, keys: np.ndarray, allowed) -> tuple[np.ndarray, ...]:
        """Walks `rows`; returns (owner, score, id, key) of those that are now among the best. owner: member * windows + window.

        `allowed(members, rows)` says which pairs may count.
        """
        bound = self.bounds(rows)
        order = np.argsort(-bound, kind="stable")
        most = float(np.abs(self.members).max(initial=0)) * float(np.abs(rows).max(initial=0)) * max(1, rows.shape[1])
        kind = float if most < 2 ** 52 else np.int64
        left = self.members.astype(kind)
        before = len(self.owner)
        mark = np.zeros(before, bool)
        for lo in range(0, len(order), _STEP):
            slack = bound[order[lo]] * 1e-9
            active = np.flatnonzero(self.size * (bound[order[lo]] + slack) + 1e-6 >= self.floor.min(1))
            if not len(active):
                break
            part = order[lo:lo + _STEP]
            scores = (left[active] @ rows[part].astype(kind).T)
            scores = np.rint(scores).astype(np.int64) if kind is float else scores
            may = allowed(active, part)
            new = []
            for w in range(self.windows):
                a, p = np.nonzero(may & (scores >= self.floor[active, w][:, None]) & (scores <= self.highs[active, w][:, None]))
                new.append((active[a] * self.windows + w, scores[a, p], ids[part[p]], keys[part[p]]))
            fresh = [np.concatenate(x) for x in zip(*new)]
            if len(fresh[0]):
                mark = self._keep(fresh, mark)
        return tuple(x[mark] for x in (self.owner, self.score, self.id, self.key))

    def _keep(self, fresh: list[np.ndarray], mark: np.ndarray) -> np.ndarray:
        owner, score, id_, key = (np.concatenate(x) for x in zip((self.owner, self.score, self.id, self.key), fresh))
        mark = np.concatenate([mark, np.ones(len(fresh[0]), bool)])
        order = np.lexsort((key, id_, -score, owner))
        owner, score, id_, key, mark = owner[order], score[order], id_[order], key[order], mark[order]
        starts = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
        place = np.arange(len(owner)) - np.repeat(starts, np.diff(np.append(starts, len(owner))))
        keep = place < self.want
        last = place == self.want - 1
        flat = self.floor.reshape(-1)
        flat[owner[last]] = np.maximum(flat[owner[last]], score[last])
        self.owner, self.score, self.id, self.key = owner[keep], score[keep], id_[keep], key[keep]
        return mark[keep]


def _unpacked(values: dict, prefix: str):
    ids, keys, labels = (np.frombuffer(values[prefix + c], np.int64) for c in ("ids", "keys", "labels"))
    shape = len(ids), values[prefix + "width"]
    kind = np.int16 if len(values[prefix + "q"]) == 2 * math.prod(shape) else np.int32
    return ids, keys, labels, np.frombuffer(values[prefix + "q"], kind).reshape(shape).astype(np.int64)


def _walked(same_label: bool, want: int):
    """Joined rows of a group (g_) and a block (b_) to the rows found: anchor key, its window, score, id and key."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple] = {}
        for batch in batches:
            for at in range(batch.num_rows):
                row = {n: batch.column(i)[at].as_py() for i, n in enumerate(batch.schema.names)}
                group = row["g_pack"]
                if group not in held:
                    if len(held) >= _GROUPS_HELD:
                        held.clear()
                    _, keys, labels, q = _unpacked(row, "g_")
                    if row["g_windows"]:
                        windows = np.frombuffer(row["g_windows"], np.int64).reshape(len(keys), -1, 2)
                    else:
                        windows = np.broadcast_to(np.array([-(1 << 62), 1 << 62]), (len(keys), 1, 2))
                    held[group] = keys, labels, q, windows, Walk(q, windows[:, :, 0], windows[:, :, 1], want)
                keys, labels, q, windows, walk = held[group]
                b_ids, b_keys, b_labels, rows = _unpacked(row, "b_")
                width = min(q.shape[1], rows.shape[1])
                rows = np.pad(rows[:, :q.shape[1]], ((0, 0), (0, q.shape[1] - width)))

                def allowed(members: np.ndarray, part: np.ndarray) -> np.ndarray:
                    if same_label:
                        return (labels[members][:, None] == b_labels[part]) & (keys[members][:, None] != b_keys[part])
                    return labels[members][:, None] != b_labels[part]

                owner, score, ids, found = walk.take(rows, b_ids, b_keys, allowed)
                if len(owner):
                    member, window = owner // walk.windows, owner % walk.windows
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(x) for x in (keys[member], *windows[member, window].T, score, ids, found)],
                        names=["anchor", "low", "high", "score", "id", "key"])

    return work


def grid(parts: int, rows: int, anchors: int, blocks: int) -> tuple[int, int]:
    """Into how many stripes the blocks and into how many bands the groups are dealt, so that stripes times bands make up to `parts` tasks.

    Groups go to every stripe and blocks to every band; at this ratio both send as much.
    """
    bands = max(1, round(math.sqrt(parts * anchors / max(1, rows))))
    return max(1, min(blocks, parts // bands)), bands


def _best(groups: DataFrame, blocks: DataFrame, stripes: int, bands: int, same_label: bool, want: int) -> DataFrame:
    """(anchor, low, high, score, id, key, place): the best rows per anchor and window over all blocks."""

    def dealt(packs: DataFrame, prefix: str, own: str, n_own: int, other: str, n_other: int) -> DataFrame:
        named = packs.select(*[F.col(c).alias(prefix + c) for c in packs.columns], F.pmod(F.xxhash64("pack"), F.lit(n_own)).cast("int").alias(own))
        return named.withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(n_other - 1))))

    left = dealt(groups, "g_", "band", bands, "stripe", stripes)
    # A pack is one row of up to some MB and estimates know nothing of it, so neither side may go through the driver by its estimate.
    right = dealt(blocks, "b_", "stripe", stripes, "band", bands).hint("merge")
    found = left.join(right, ["band", "stripe"]).mapInArrow(_walked(same_label, want), "anchor long, low long, high long, score long, id long, key long")
    return top_per_key(found, ["anchor", "low", "high"], [F.col("score").desc(), F.col("id"), F.col("key")], want, "key", "place")


def mine(
    rows: DataFrame, is_anchor: Column, n_positives: int = POSITIVES, n_negatives: int = NEGATIVES,
    low: int = LOW_PERCENT, high: int = HIGH_PERCENT, block: int = BLOCK, members: int = MEMBERS, cells: int = CELLS,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for the anchors among `rows`.

    `rows` are those of `vectors`, written. An anchor's positives are its `n_positives` best other rows of its label, its
    negatives for one of them the `n_negatives` best rows of other labels with low % to high % of the positive's score. A score
    is the inner product; missing components of a shorter vector count as zero. Ties go to the smaller id. A positive
    without negatives, or with a negative score, gives no row; two anchors of one id are two anchors; an empty table gives none.
    """
    anchors = rows.filter(is_anchor)
    sample = anchors.orderBy(F.xxhash64("key"), "key").limit(SAMPLE).select("q").collect()
    centres = fit_directions([r.q for r in sample], cells)
    blocks = land(packed_rows(_celled(rows, centres), block).groupBy("pack").applyInArrow(_pack, PACKED), "blocks")
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    grouped = land(packed_rows(_celled(anchors, centres), members), "anchors")
    stripes, bands = grid(parts, rows.count(), grouped.count(), blocks.count())
    groups = grouped.groupBy("pack").applyInArrow(_pack, PACKED)
    positives = land(_best(groups, blocks, stripes, bands, True, n_positives), "positives")
    # At most `n_positives` windows an anchor; equal scores share one.
    exact = F.col("score").cast("decimal(20,0)")
    positives = positives.withColumns({"low": F.ceil(exact * low / 100).cast("long"), "high": F.floor(exact * high / 100).cast("long")})
    asked = positives.filter("low <= high").groupBy("anchor").agg(F.array_sort(F.collect_set(F.struct("low", "high"))).alias("windows"))
    asking = grouped.join(asked.withColumnRenamed("anchor", "key"), "key").select(*grouped.columns, "windows")
    negatives = _best(asking.groupBy("pack").applyInArrow(_pack, PACKED), blocks, stripes, bands, False, n_negatives)
    pairs = positives.select("anchor", "low", "high", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    names = anchors.select(F.col("key").alias("anchor"), F.col("vec_id").alias("anchor_id"))
    return pairs.join(negatives, ["anchor", "low", "high"]).join(names, "anchor").select(
        "anchor_id", "positive_id", F.col("place").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score",
        F.col("score").alias("negative_score"))
