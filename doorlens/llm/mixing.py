"""Mixing sources to target weights by drawing fixed-length blocks.

Each source's documents, in a seeded order, form one stream of words that is cut into blocks. A
source's target says how many words the mix takes from it: whole passes over its blocks and part of
one more. The pass's slots run through a seeded permutation of the block numbers (a Feistel
network, so no order is ever stored), and the last slot is cut so that the words come out even. How
many of its slots go to each output shard is one multinomial draw per source, given its total.
Slots then meet blocks by (source, block number).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from doorlens.llm.common import ROW, WHITE, field, key_pair, packed, row_key, source_key, unpacked, word_count
from doorlens.operators.ordering import count_below
from doorlens.session import land

WEIGHTS = (5, 2, 1)
MOST_REPEATS = 3
BLOCK_WORDS = 128
SHARDS = 8
SEED = 7
#: Leading hash bits that cut a source's stream into runs, so that no window holds a whole source.
_RUN_BITS = 12
#: Slots written out by one row of a plan.
_SLOT_RUN = 1 << 14
_WORD = re.compile(f"[^{WHITE}]+")


def _mix(values: np.ndarray, key: np.ndarray, step: int) -> np.ndarray:
    x = values * np.uint64(0x9E3779B97F4A7C15) + key + np.uint64(step * 0xD1B54A32D192ED03 & (1 << 64) - 1)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def permute(index: np.ndarray, size: np.ndarray, key: np.ndarray, inverse: bool = False, steps: int = 4) -> np.ndarray:
    """A seeded permutation of range(size) at `index`, all arrays of one length: a Feistel walk that stays inside."""
    size, key = size.astype(np.uint64), key.astype(np.uint64)
    half = np.ceil(np.log2(np.maximum(size, np.uint64(2)).astype(np.float64) + 1) / 2).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    out = index.astype(np.uint64)
    todo = np.arange(len(out))
    order = range(steps)[::-1] if inverse else range(steps)
    while len(todo):
        h, m, k = half[todo], mask[todo], key[todo]
        left, right = out[todo] >> h, out[todo] & m
        for step in order:
            if inverse:
                left, right = right ^ (_mix(left, k, step) & m), left
            else:
                left, right = right, left ^ (_mix(right, k, step) & m)
        out[todo] = left << h | right
        todo = todo[out[todo] >= size[todo]]
    return out.astype(np.int64)


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_REPEATS) -> DataFrame:
    """(source, source_size, target): shares of all words by weight, none above `most` times its source's size.

    Sources at their limit are those with the smallest limit per weight, so one pass in that order
    finds where sharing the excess again and again ends.
    """
    each = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy("source")  # one row per source
    picks = F.array(*[F.lit(float(w)) for w in weights])
    each = each.withColumn("weight", F.element_at(picks, (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int")))
    limit = F.col("source_size") * F.lit(float(most))
    ratio = Window.orderBy("ratio", "source")
    every = Window.orderBy("ratio", "source").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    each = each.withColumn("ratio", limit / F.col("weight"))
    before = ratio.rowsBetween(Window.unboundedPreceding, -1)
    each = (
        each.withColumn("left", F.sum("source_size").over(every) - F.coalesce(F.sum(limit).over(before), F.lit(0.0)))
        .withColumn("open", F.sum("weight").over(ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
        .withColumn("level", F.when(F.col("left") <= F.col("ratio") * F.col("open"), F.col("left") / F.col("open")))
        .withColumn("level", F.first("level", ignorenulls=True).over(every))
    )
    return each.select("source", "source_size", F.least(limit, F.col("level") * F.col("weight")).alias("target"))


def _plan(shares: DataFrame, block_words: int, shards: int, seed: int) -> DataFrame:
    """Per source and shard the slots it fills: first, count; with what turns a slot into a block and its words."""

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples(index=False):
                size, want = int(row.source_size), int(row.target + 0.5)
                if not size or not want:
                    continue
                blocks = -(-size // block_words)
                passes, rest = divmod(want, size)
                key = np.array([row.key], np.int64).view(np.uint64)
                odd = int(permute(np.array([blocks - 1]), np.array([blocks]), key, inverse=True)[0])
                lacks = blocks * block_words - size
                slots = -(-rest // block_words)
                if slots > odd:
                    slots = -(-(rest + lacks) // block_words)
                total = passes * blocks + slots
                before = (slots - 1) * block_words - (lacks if slots - 1 > odd else 0)
                draw = np.random.default_rng([seed, int(key[0])]).multinomial(total, np.full(shards, 1 / shards))
                first = np.concatenate([[0], np.cumsum(draw)])[:-1]
                yield pd.DataFrame({
                    "source": row.source, "key": row.key, "blocks": blocks, "total": total,
                    "last_words": rest - before if rest else 0, "shard": np.arange(shards, dtype=np.int32), "first": first, "slots": draw,
                })

    keyed = shares.withColumn("key", F.xxhash64(F.lit(seed), "source"))
    return keyed.mapInPandas(work, "source string, key long, blocks long, total long, last_words long, shard int, first long, slots long")


def slots(shares: DataFrame, block_words: int = BLOCK_WORDS, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """(source, shard, slot, pass, block, most_words): every slot of every shard with the block it takes.

    most_words is below the block length only in a source's last slot.
    """
    runs = _plan(shares, block_words, shards, seed).filter("slots > 0")
    runs = runs.withColumn("run", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("slots") - 1, F.lit(_SLOT_RUN).cast("long"))))
    runs = runs.withColumn("end", F.least(F.col("run") + _SLOT_RUN, F.col("first") + F.col("slots")) - 1)
    # Few rows now, many once written out: the planner must neither merge these tasks nor broadcast the result.
    parts = int(shares.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    runs = runs.repartition(parts, "source", "shard", "run")
    each = runs.select("source", "key", "blocks", "total", "last_words", "shard", F.explode(F.sequence("run", "end")).alias("slot"))

    @F.pandas_udf("long")
    def block_at(slot: pd.Series, blocks: pd.Series, key: pd.Series) -> pd.Series:
        n = blocks.to_numpy()
        return pd.Series(permute(slot.to_numpy() % n, n, key.to_numpy().view(np.uint64)))

    words = F.when((F.col("slot") == F.col("total") - 1) & (F.col("last_words") > 0), F.col("last_words")).otherwise(F.lit(block_words))
    return each.select(
        "source", "shard", "slot", F.expr("slot div blocks").alias("pass"), block_at("slot", "blocks", "key").alias("block"),
        words.cast("long").alias("most_words"),
    )


def _streams(keyed: DataFrame, seed: int) -> DataFrame:
    """Adds `start`: where a document's words begin in its source's seeded stream. Needs source, size, k1, k2."""
    order = F.struct(F.xxhash64(F.lit(seed), "k1", "k2").alias("h"), "k1", "k2")
    placed = keyed.withColumn("place", order).withColumn("run", F.shiftrightunsigned(F.col("place.h"), 64 - _RUN_BITS))
    return count_below(placed, ["source"], ["run", "place"], "size", "start").drop("place", "run")


def _pieces(streams: DataFrame, block_words: int) -> DataFrame:
    """(source, block, start, size, lo, hi): each document's share of each block it reaches, as words of the block."""
    blocks = F.sequence(F.expr(f"start div {block_words}"), F.expr(f"(start + size - 1) div {block_words}"))
    part = streams.filter("size > 0").withColumn("block", F.explode(blocks))
    base = F.col("block") * block_words
    return part.withColumn("lo", F.greatest(F.col("start") - base, F.lit(0))).withColumn(
        "hi", F.least(F.col("start") + F.col("size") - base, F.lit(block_words)))


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = WEIGHTS,
        most: int = MOST_REPEATS, block_words: int = BLOCK_WORDS, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken (words the mix takes of it, repeats counted).

    Sources take the weights in order of their code points, null last, and share all words; a
    target stops at `most` times its source's size. A null or blank text has size 0 and gives
    nothing; repeated rows are separate documents; documents without any word at all leave every
    target 0; an empty table gives no rows. Reruns over the same rows agree.
    """
    one, two = key_pair(F.col(doc_id), F.col(text))
    keyed = docs.select(F.col(doc_id).alias("doc_id"), source_key(F.col(source)).alias("source"), word_count(F.col(text)).alias("size"),
                        one.alias("k1"), two.alias("k2"))
    keyed = land(keyed, "sizes")
    shares = land(targets(keyed, weights, most), "targets")
    streams = _streams(keyed, seed).select("doc_id", "source", "size", "start")
    taken = _taken(_pieces(streams, block_words), slots(shares, block_words, shards, seed), ["source", "start", "doc_id", "size"])
    summed = taken.groupBy("source", "start", "doc_id", "size").agg(F.sum("words").alias("taken"))
    empty = keyed.filter("size = 0").select("source", "doc_id", "size", F.lit(0).cast("long").alias("taken"))
    return summed.select("source", "doc_id", "size", "taken").unionByName(empty).join(shares, "source").select(
        "doc_id", "size", "source_size", "target", "taken")


def _taken(pieces: DataFrame, drawn: DataFrame, keys: list[str]) -> DataFrame:
    """Per piece the words all its block's slots take of it."""
    drawn = drawn.groupBy("source", "block", "most_words").agg(F.count(F.lit(1)).alias("times"))
    words = F.greatest(F.least("hi", F.col("most_words")) - F.col("lo"), F.lit(0)) * F.col("times")
    return pieces.join(drawn.hint("merge"), ["source", "block"], "left").select(*keys, F.coalesce(words, F.lit(0)).alias("words"))


def mixed_blocks(docs: DataFrame, text: str = "text", source: str = "source", weights: tuple[int, ...] = WEIGHTS,
                 most: int = MOST_REPEATS, block_words: int = BLOCK_WORDS, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """The mix itself: (shard, slot, source, n_words, words), one row per slot, its words joined over document borders."""
    keyed = _keyed(docs, text, source).withColumn("text", field(text)).drop(ROW)
    shares = land(targets(keyed.drop("text"), weights, most), "targets")
    streams = _streams(keyed, seed)
    parts = _pieces(streams, block_words)
    cut = F.slice(F.split(F.btrim("text", F.lit(WHITE)), "[ \\t-\\r]+"), (F.col("lo") + F.col("block") * block_words - F.col("start") + 1).cast("int"),
                  (F.col("hi") - F.col("lo")).cast("int"))
    blocks = parts.select("source", "block", "lo", cut.alias("words")).groupBy("source", "block").agg(
        F.sort_array(F.collect_list(F.struct("lo", "words"))).alias("parts"))  # at most block_words parts
    drawn = slots(shares, block_words, shards, seed)
    joined = drawn.hint("merge").join(blocks, ["source", "block"])
    words = F.slice(F.flatten(F.col("parts.words")), F.lit(1), F.col("most_words").cast("int"))
    return joined.select("shard", "slot", F.expr("if(left(source, 1) = '0', substring(source, 2), null)").alias("source"), words.alias("words")).select(
        "shard", "slot", "source", F.size("words").alias("n_words"), "words")


def _keyed(docs: DataFrame, text: str, source: str) -> DataFrame:
    one, two = row_key(docs)
    return packed(docs).select(ROW, source_key(field(source)).alias("source"), word_count(field(text)).alias("size"), one.alias("k1"), two.alias("k2"))


def mix_documents(docs: DataFrame, text: str = "text", source: str = "source", weights: tuple[int, ...] = WEIGHTS,
                  most: int = MOST_REPEATS, block_words: int = BLOCK_WORDS, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """The mix as documents: each document once per pass that takes of it, with the words the pass takes.

    A pass that takes all of a document leaves its text as it is; otherwise the taken runs of
    words, as written, are joined by a line break. All columns stay; `n_chars`, if there, follows
    the text. A document of which nothing is taken, or without a word, goes; so does a null text.
    Repeated rows are documents of their own; null sources are one source; an empty table gives none.
    """
    columns = docs.columns
    keyed = _keyed(docs, text, source)
    shares = land(targets(keyed.select("source", "size"), weights, most), "targets")
    narrow = keyed.select("source", "size", "k1", "k2")
    parts = _pieces(_streams(narrow, seed), block_words)
    hit = parts.join(slots(shares, block_words, shards, seed).hint("merge"), ["source", "block"])
    lo = F.col("block") * block_words - F.col("start")
    hit = hit.select("k1", "k2", "start", "size", "pass", (lo + F.col("lo")).alias("a"), (lo + F.least("hi", "most_words")).alias("b")).filter("b > a")
    ranges = hit.groupBy("k1", "k2", "start", "size", "pass").agg(
        F.sum(F.col("b") - F.col("a")).alias("n"), F.sort_array(F.collect_list(F.struct("a", "b"))).alias("ranges"))
    ranges = ranges.select("k1", "k2", F.when(F.col("n") < F.col("size"), F.col("ranges")).alias("ranges"), "start", "pass")
    # Equal rows differ in `start` alone: one of them stands for all, once per start and pass.
    rows = keyed.dropDuplicates(["k1", "k2"]).join(ranges, ["k1", "k2"]).select(ROW, "ranges")
    rows = rows.select(ROW, F.when(F.col("ranges").isNull(), field(text)).otherwise(_cut(field(text), F.col("ranges"))).alias("cut"))
    replaced: dict[str, Column] = {text: F.col("cut")}
    if "n_chars" in columns:
        replaced["n_chars"] = F.char_length("cut").cast(docs.schema["n_chars"].dataType)
    return unpacked(rows, columns, **replaced)


def cut_words(text: str, ranges: list[tuple[int, int]]) -> str:
    """The runs of words [a, b) of `text` as written, adjoining runs as one, others on lines of their own."""
    spans = [m.span() for m in _WORD.finditer(text)]
    merged: list[list[int]] = []
    for a, b in ranges:
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(b, merged[-1][1])
        else:
            merged.append([a, b])
    return "\n".join(text[spans[a][0]:spans[b - 1][1]] for a, b in merged)


def _cut(text: Column, ranges: Column) -> Column:
    @F.arrow_udf("string")
    def cut(texts: pa.Array, spans: pa.Array) -> pa.Array:
        return pa.array(
            [t.as_py() if s.as_py() is None else cut_words(t.as_py(), [(x["a"], x["b"]) for x in s.as_py()]) for t, s in zip(texts, spans)],
            pa.string())

    return cut(text, ranges)
