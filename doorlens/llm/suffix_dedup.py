"""Repeated byte strings by a depth-limited radix sort of suffixes.

A suffix matters only through its first `length` bytes, its window. Windows that are equal also
agree on the k-gram with the smallest hash inside them and on its place, their anchor; so the sort
deals suffixes out by anchor first, and one anchor stands for the run of windows that share it.
Anchors met once leave at once, and with them most of the text. Runs that are equal byte for byte
are settled by one digest of the whole run, those of one text where the text is read. The runs left, the borders of what repeats, go through
the radix sort proper: windows are grouped by 40-byte digits, from the most significant on, and a
window that stands alone after a digit leaves. Windows still together after `length` bytes are
exactly the repeated ones. An anchor with very many different runs is not gathered: its windows are
rows, and a combining aggregate groups them.

Copies of a whole text are one text: they are removed as a whole, and their text is sorted once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doorlens.llm.common import key_pair
from doorlens.session import land

LENGTH = 200
#: Bytes of one digit of the radix sort.
DIGIT = 40
#: Most different runs of one anchor that one task sorts; windows of larger groups are grouped as rows.
GROUP = 8192
#: Bytes worked on at once; positions inside fit the low bits of a minimiser key.
_SEGMENT_BITS = 20
_SEGMENT = 1 << _SEGMENT_BITS
#: Windows sorted at once.
_WINDOWS = 1 << 20
_ODD = 0x9E3779B97F4A7C15


def _mixed(x: np.ndarray) -> np.ndarray:
    """Every bit of x spread over 64 bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def gram_size(length: int) -> int:
    """The anchor's bytes: longer ones repeat less by chance, shorter ones make fewer anchors."""
    return max(1, length * 8 // 25)


class _Rolling:
    """Hashes of all k-grams of a segment, from one prefix sum."""

    def __init__(self, size: int):
        def powers(base: int) -> np.ndarray:
            out = np.full(size + 1, base, np.uint64)
            out[0] = 1
            return np.multiply.accumulate(out)

        self.table = _mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(_ODD))
        self.up, self.down = powers(_ODD), powers(pow(_ODD, -1, 1 << 64))

    def grams(self, data: np.ndarray, k: int) -> np.ndarray:
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.table[data] * self.up[:len(data)], out=sums[1:])
        return _mixed((sums[k:] - sums[:-k]) * self.down[:len(data) - k + 1])


def _least_in_window(keys: np.ndarray, w: int) -> np.ndarray:
    """The smallest of every `w` consecutive keys: running minima of blocks of w from both ends."""
    n = len(keys) - w + 1
    blocks = np.full(-(-len(keys) // w) * w, np.iinfo(np.uint64).max, np.uint64)
    blocks[:len(keys)] = keys
    blocks = blocks.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[w - 1:w - 1 + n])


def segment_anchors(rolling: _Rolling, data: np.ndarray, ends: np.ndarray, length: int):
    """(hash, position, first window, last window) of each anchor; texts end at `ends` (ascending) in `data`."""
    k = gram_size(length)
    if len(data) < length:
        return None
    starts = np.concatenate([[0], ends[:-1]])
    long = ends - starts >= length
    edge = np.zeros(len(data) + 1, np.int32)
    np.add.at(edge, starts[long], 1)
    np.add.at(edge, ends[long] - length + 1, -1)
    windows = np.flatnonzero(np.cumsum(edge[:len(data) - length + 1]))
    if not len(windows):
        return None
    grams = rolling.grams(data, k)
    low = np.uint64(_SEGMENT - 1)
    keys = (grams & ~low) | np.arange(len(grams), dtype=np.uint64)
    at = (_least_in_window(keys, length - k + 1)[windows] & low).astype(np.int64)
    fresh = np.ones(len(windows), bool)
    fresh[1:] = (at[1:] != at[:-1]) | (windows[1:] != windows[:-1] + 1)
    first = np.flatnonzero(fresh)
    last = np.concatenate([first[1:], [len(windows)]]) - 1
    return grams[at[first]], at[first], windows[first], windows[last]


def _texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts one after another, and where each begins (and the last ends)."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


def _segments(offsets: np.ndarray, length: int) -> Iterator[tuple[int, int, int, int]]:
    """(first text, end text, first byte, end byte): whole texts up to a segment, or overlapping parts of one longer text."""
    i, n = 0, len(offsets) - 1
    while i < n:
        if offsets[i + 1] - offsets[i] > _SEGMENT:
            step = _SEGMENT - length + 1
            for a in range(int(offsets[i]), int(offsets[i + 1]) - length + 1, step):
                yield i, i + 1, a, min(a + _SEGMENT, int(offsets[i + 1]))
            i += 1
            continue
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + _SEGMENT, "right")) - 1)
        yield i, j, int(offsets[i]), int(offsets[j])
        i = j


def _anchors(length: int):
    """Rows (t1, t2, text) to rows of anchors; a text met again by the same task is left out.

    Runs that one text holds more than once are settled at once: one of them goes on as an anchor marked `twice`, and
    their bytes come out as spans, rows without h.
    """
    names = ["h", "c", "t1", "t2", "first", "back", "more", "twice"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling, seen = _Rolling(_SEGMENT), set()
        digest = xxhash.xxh3_64_intdigest
        for batch in batches:
            pairs = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
            new = [i for i, p in enumerate(pairs) if p not in seen and not seen.add(p)]
            if not new:
                continue
            batch = batch.take(pa.array(new))
            t1, t2 = (batch.column(i).to_numpy() for i in (0, 1))
            data, offsets = _texts(batch.column(2))
            for i, j, a, b in _segments(offsets, length):
                part = data[a:b]
                found = segment_anchors(rolling, part, np.minimum(offsets[i + 1:j + 1], b) - a, length)
                if found is None:
                    continue
                grams, at, first, last = found
                owner = np.searchsorted(offsets[i:j + 1], at + a, "right") - 1 + i
                view = memoryview(part)
                runs = np.fromiter((digest(view[x:y]) for x, y in zip(first.tolist(), (last + length).tolist())), np.uint64, len(at))
                lead, twice = repeats(_mixed(_mixed(runs + grams * np.uint64(_ODD)) + owner.astype(np.uint64) * np.uint64(_ODD)))
                shift = a - offsets[owner]
                yield pa.RecordBatch.from_arrays([pa.array(x[lead]) for x in (
                    grams.view(np.int64), runs.view(np.int64), t1[owner], t2[owner], first + shift, (at - first).astype(np.int16),
                    (last - first).astype(np.int16), twice)], names=names)
                if not twice.any():
                    continue
                own, lo, hi = owner[twice], (first + shift)[twice], (last + shift)[twice]
                fresh = np.ones(len(own), bool)
                fresh[1:] = (own[1:] != own[:-1]) | (lo[1:] > hi[:-1] + length)
                begin = np.flatnonzero(fresh)
                end = np.append(begin[1:], len(own)) - 1
                none = [None] * len(begin)
                yield pa.RecordBatch.from_arrays([
                    pa.array(none, pa.int64()), pa.array(hi[end] + length), pa.array(t1[own[begin]]), pa.array(t2[own[begin]]), pa.array(lo[begin]),
                    pa.array(none, pa.int16()), pa.array(none, pa.int16()), pa.array(none, pa.bool_())], names=names)

    return work


def repeats(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first of its value, value met more than once) for each place."""
    order = np.argsort(values, kind="stable")
    same = np.zeros(len(values) + 1, bool)
    same[1:-1] = values[order[1:]] == values[order[:-1]]
    lead, twice = np.empty(len(values), bool), np.empty(len(values), bool)
    lead[order], twice[order] = ~same[:-1], same[:-1] | same[1:]
    return lead, twice


def digit_values(data: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit value for the `width` bytes from each position on (those that fit)."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.uint64)
    word = np.zeros(len(data), np.uint64)
    for i in range(8):
        word |= padded[i:i + len(data)] << np.uint64(8 * i)
    n = len(data) - width + 1
    value = np.zeros(n, np.uint64)
    for at in range(0, width, 8):
        step = min(at, max(0, width - 8))
        part = word[step:step + n]
        if width < 8:
            part = part & np.uint64((1 << 8 * width) - 1)
        value = _mixed(value * np.uint64(_ODD) + part)
    return value


def radix_groups(data: np.ndarray, at: np.ndarray, group: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Which suffixes of `data` (from `at`) share their first `length` bytes with another of their group.

    One pass per digit, the most significant first; after each, suffixes that stand alone leave. Returns the
    indices of those that stay and the group each ended in.
    """
    width = min(DIGIT, length)
    values = digit_values(data, width)
    alive = np.arange(len(at))
    group = _mixed(group.astype(np.uint64))
    for depth in range(0, length, width):
        group = _mixed(group * np.uint64(_ODD) + values[at[alive] + min(depth, length - width)])
        order = np.argsort(group)
        same = group[order[1:]] == group[order[:-1]]
        together = np.zeros(len(order), bool)
        together[1:] |= same
        together[:-1] |= same
        keep = order[together]
        alive, group = alive[keep], group[keep]
        if not len(alive):
            break
    return alive, group


def _unfolded(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, place in the row) for rows of the given lengths."""
    row = np.repeat(np.arange(len(lengths)), lengths)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(lengths) - lengths, lengths)


def _windows_of(batch: pa.RecordBatch, length: int):
    """The windows of the runs of a batch: bytes, run, place in it, and byte position."""
    data, offsets = _texts(batch.column("bytes"))
    row, place = _unfolded(np.diff(offsets) - length + 1)
    return data, row, place, offsets[row] + place


def _sorted_runs(length: int):
    """Runs sorted by anchor to the repeated spans of undecided ones, whole anchors at a time."""

    def spans(runs: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        h, back = runs.column("h").to_numpy(), runs.column("back").to_numpy().astype(np.int64)
        data, row, place, at = _windows_of(runs, length)
        anchor = np.concatenate([[0], np.cumsum(h[1:] != h[:-1])])
        # Equal windows have their anchor at the same place.
        kept, _ = radix_groups(data, at, anchor[row] * 65536 + back[row] - place, length)
        open_ = ~runs.column("decided").to_numpy(zero_copy_only=False)
        kept = np.sort(kept[open_[row[kept]]])
        if not len(kept):
            return
        r, p = row[kept], place[kept]
        fresh = np.ones(len(kept), bool)
        fresh[1:] = (r[1:] != r[:-1]) | (p[1:] != p[:-1] + 1)
        begin = np.flatnonzero(fresh)
        end = np.concatenate([begin[1:], [len(kept)]]) - 1
        first = runs.column("first").to_numpy()
        yield pa.RecordBatch.from_arrays([
            pa.array(runs.column("t1").to_numpy()[r[begin]]), pa.array(runs.column("t2").to_numpy()[r[begin]]),
            pa.array(first[r[begin]] + p[begin]), pa.array(first[r[end]] + p[end] + length),
        ], names=["t1", "t2", "a", "b"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0

        def joined() -> pa.RecordBatch:
            return pa.Table.from_batches(held).combine_chunks().to_batches()[0]

        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                held.append(batch.slice(lo, 1024))
                size += held[-1].num_rows
                if size * length < _WINDOWS:
                    continue
                whole = joined()
                h = whole.column("h").to_numpy()
                other = np.flatnonzero(h != h[-1])
                if len(other):
                    yield from spans(whole.slice(0, other[-1] + 1))
                    held = [whole.slice(other[-1] + 1)]
                    size = held[0].num_rows
        if size:
            yield from spans(joined())

    return work


def _window_rows(length: int):
    """Runs to one row per window: its anchor, a digest of its bytes and place, its text and position."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = min(DIGIT, length)
        for whole in batches:
            for lo in range(0, whole.num_rows, 4096):
                batch = whole.slice(lo, 4096)
                data, row, place, at = _windows_of(batch, length)
                values = digit_values(data, width)
                value = _mixed((batch.column("back").to_numpy().astype(np.int64)[row] - place).astype(np.uint64))
                for depth in range(0, length, width):
                    value = _mixed(value * np.uint64(_ODD) + values[at + min(depth, length - width)])
                yield pa.RecordBatch.from_arrays([
                    pa.array(batch.column("h").to_numpy()[row]), pa.array(value.view(np.int64)), pa.array(batch.column("t1").to_numpy()[row]),
                    pa.array(batch.column("t2").to_numpy()[row]), pa.array(batch.column("first").to_numpy()[row] + place),
                ], names=["h", "value", "t1", "t2", "p"])

    return work


def _run_bytes(length: int):
    """Texts with the runs asked of them to those runs' bytes."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["h", "t1", "t2", "first", "back", "decided", "bytes"]
        for batch in batches:
            texts = batch.column(batch.schema.names.index("text")).cast(pa.binary())
            t1, t2 = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            wanted = batch.column(batch.schema.names.index("runs")).to_pylist()
            rows, held = [], 0
            for i, runs in enumerate(wanted):
                if not runs:
                    continue
                text = texts[i].as_py()
                for r in runs:
                    piece = text[r["first"]:r["first"] + r["more"] + length]
                    rows.append((r["h"], t1[i], t2[i], r["first"], r["back"], r["decided"], piece))
                    held += len(piece)
                if held > 8 * _SEGMENT:
                    yield _batch(rows, names)
                    rows, held = [], 0
            if rows:
                yield _batch(rows, names)

    return work


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    types = {"h": pa.int64(), "t1": pa.int64(), "t2": pa.int64(), "first": pa.int64(), "back": pa.int16(), "decided": pa.bool_(),
             "bytes": pa.binary(), "n_removed": pa.int64(), "n_spans": pa.int64(), "kept_sha256": pa.string(), "kept": pa.binary(),
             "spans": pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))}
    return pa.RecordBatch.from_arrays([pa.array(c, types[n]) for n, c in zip(names, zip(*rows))], names=names)


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans in order, those that overlap or touch as one."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts with their spans to what is taken out and the bytes that stay."""
    names = ["t1", "t2", "n_removed", "n_spans", "kept_sha256", "kept", "spans"]
    for batch in batches:
        texts = batch.column(batch.schema.names.index("text")).cast(pa.binary())
        t1, t2 = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        rows, held = [], 0
        for i, spans in enumerate(batch.column(batch.schema.names.index("spans")).to_pylist()):
            runs = merged([(s["a"], s["b"]) for s in spans])
            text, at, pieces = texts[i].as_py(), 0, []
            for a, b in runs:
                pieces.append(text[at:a])
                at = b
            kept = b"".join([*pieces, text[at:]])
            rows.append((t1[i], t2[i], sum(b - a for a, b in runs), len(runs), hashlib.sha256(kept).hexdigest(), kept,
                         [{"a": a, "b": b} for a, b in runs]))
            held += len(kept)
            if held > 8 * _SEGMENT:
                yield _batch(rows, names)
                rows, held = [], 0
        if rows:
            yield _batch(rows, names)


def _keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    value = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    one, two = key_pair(value)
    return docs.select(F.col(f"`{doc_id}`").alias("doc_id"), one.alias("t1"), two.alias("t2"), value.alias("text"))


def repeated_spans(keyed: DataFrame, length: int = LENGTH, group: int = GROUP) -> tuple[DataFrame, DataFrame]:
    """((t1, t2, a, b) byte spans of repeated windows, the written texts that can hold any).

    `keyed` has `t1`, `t2` (which identify the text) and `text`. Spans of one text may overlap.
    """
    narrow = keyed.filter(F.octet_length("text") >= length).select("t1", "t2", "text")
    found = land(narrow.mapInArrow(_anchors(length), "h long, c long, t1 long, t2 long, first long, back short, more short, twice boolean"), "anchors")
    # All groupings combine before the shuffle: an anchor may be in a third of all texts.
    tagged = found.filter("h is not null").withColumn("tag", F.xxhash64("t1", "t2", F.col("first") + F.col("back")))
    met = tagged.groupBy("h").agg(F.min("tag").alias("low"), F.max("tag").alias("high")).filter("low != high").select("h")
    shared = land(tagged.join(met, "h"), "shared")
    runs = shared.groupBy("h", "c").agg(
        ((F.min("tag") != F.max("tag")) | F.max("twice")).alias("decided"), F.min(F.struct("t1", "t2", "first", "back", "more")).alias("one"))
    runs = land(runs.select("h", "c", "decided", "one.*"), "runs")
    sizes = runs.groupBy("h").agg(F.count(F.lit(1)).alias("runs")).filter("runs > 1")
    asked = runs.join(sizes, "h").select("t1", "t2", F.struct((F.col("runs") > group).alias("hot"), "h", "first", "back", "more", "decided").alias("run"))
    inside = found.filter("h is null").select("t1", "t2", F.col("first").alias("a"), F.col("c").alias("b"))
    whole = shared.join(runs.filter("decided").select("h", "c"), ["h", "c"]).select(
        "t1", "t2", F.col("first").alias("a"), (F.col("first") + F.col("more") + length).alias("b")).unionByName(inside)
    # Only the text's own runs are gathered with it: fewer than it has bytes.
    none = F.lit(None).cast(asked.schema["run"].dataType)
    lists = asked.unionByName(shared.select("t1", "t2", none.alias("run"))).unionByName(inside.select("t1", "t2", none.alias("run")))
    lists = lists.groupBy("t1", "t2").agg(F.collect_list("run").alias("runs"))
    texts = land(narrow.groupBy("t1", "t2").agg(F.any_value("text").alias("text")).join(lists, ["t1", "t2"]), "texts")
    schema = "h long, t1 long, t2 long, first long, back short, decided boolean, bytes binary"

    def cut(is_hot: bool) -> DataFrame:
        chosen = F.filter("runs", (lambda r: r.hot) if is_hot else (lambda r: ~r.hot))
        return texts.select("t1", "t2", "text", chosen.alias("runs")).filter(F.size("runs") > 0).mapInArrow(_run_bytes(length), schema)

    borders = cut(False).repartition("h").sortWithinPartitions("h").mapInArrow(_sorted_runs(length), "t1 long, t2 long, a long, b long")
    rows = cut(True).mapInArrow(_window_rows(length), "h long, value long, t1 long, t2 long, p long")
    place = F.xxhash64("t1", "t2", "p")
    twice = rows.groupBy("h", "value").agg(F.min(place).alias("low"), F.max(place).alias("high")).filter("low != high").select("h", "value")
    crowded = rows.join(twice, ["h", "value"]).select("t1", "t2", F.col("p").alias("a"), (F.col("p") + length).alias("b"))
    return whole.unionByName(borders).unionByName(crowded), texts


def _outcomes(keyed: DataFrame, length: int, group: int) -> DataFrame:
    spans, texts = repeated_spans(keyed, length, group)
    per_text = spans.groupBy("t1", "t2").agg(F.collect_list(F.struct("a", "b")).alias("spans"))
    return texts.select("t1", "t2", "text").join(per_text, ["t1", "t2"]).mapInArrow(
        _removed, "t1 long, t2 long, n_removed long, n_spans long, kept_sha256 string, kept binary, spans array<struct<a:long,b:long>>")


def _with_outcomes(rows: DataFrame, outcomes: DataFrame, length: int) -> DataFrame:
    """Adds the outcome of its text to each row; a text of several rows is removed whole once it has `length` bytes."""
    copies = rows.groupBy("t1", "t2").agg(F.count(F.lit(1)).alias("copies"))
    each = copies.join(outcomes, ["t1", "t2"], "left")
    return rows.join(each, ["t1", "t2"]).withColumn("all_gone", (F.col("copies") > 1) & (F.col("n_bytes") >= length))


def _if_any(gone: Column, partly: Column, untouched: Column) -> Column:
    return F.when(F.col("all_gone"), gone).when(F.col("n_removed").isNotNull(), partly).otherwise(untouched)


def removal_report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, group: int = GROUP) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    A byte is removed if a string of `length` bytes that covers it starts anywhere else too, in the same text or
    another; matches never run across texts and are judged on the input. A null text is empty; texts shorter than
    `length` lose nothing; a repeated row is another text and so a copy; a null doc_id is kept; an empty table gives
    no row.
    """
    keyed = _keyed(docs, doc_id, text)
    outcomes = _outcomes(keyed, length, group).drop("kept", "spans")
    rows = keyed.select("doc_id", "t1", "t2", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("whole"))
    none = hashlib.sha256(b"").hexdigest()
    return _with_outcomes(rows, outcomes, length).select(
        "doc_id", "n_bytes", _if_any(F.col("n_bytes"), F.col("n_removed"), F.lit(0).cast("long")).alias("n_removed"),
        _if_any(F.lit(1).cast("long"), F.col("n_spans"), F.lit(0).cast("long")).alias("n_spans"),
        _if_any(F.lit(none), F.col("kept_sha256"), F.col("whole")).alias("kept_sha256"),
    )


def removed_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, group: int = GROUP) -> DataFrame:
    """(doc_id, kept bytes, removed spans [a, b) in bytes) of every document that loses some; rules as in `removal_report`.

    The kept bytes may break inside a character; decode them as the caller sees fit.
    """
    keyed = _keyed(docs, doc_id, text)
    outcomes = _outcomes(keyed, length, group)
    rows = keyed.select("doc_id", "t1", "t2", F.octet_length("text").cast("long").alias("n_bytes"))
    everything = F.array(F.struct(F.lit(0).cast("long").alias("a"), F.col("n_bytes").alias("b")))
    return _with_outcomes(rows, outcomes, length).filter(F.col("all_gone") | F.col("n_removed").isNotNull()).select(
        "doc_id", F.when(F.col("all_gone"), F.lit("").cast("binary")).otherwise(F.col("kept")).alias("kept"),
        F.when(F.col("all_gone"), everything).otherwise(F.col("spans")).alias("spans"),
    )
