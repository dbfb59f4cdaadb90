"""Benchmark decontamination: passages of test items in documents, up to an edit budget.

Words are the symbols. An item of m words may differ by a budget of edits (words put in, left out
or exchanged), a fifth of its words as the library's similarity floor is 0.8. Cut into budget + 1
pieces, every occurrence within the budget holds one piece unchanged. All pieces are looked for at once in each
whole document; each hit names a window in which the item must lie, overlapping windows are merged,
and Myers' bit-parallel distance over the window decides.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from doorlens.llm.common import ROW, field, packed, row_key, unpacked

_WORD = re.compile(r"\w+")
#: Share of an item's words that may be edited.
BUDGET = 0.2
#: Bytes of item text held by a task at once; a larger test set is read block by block.
BLOCK_BYTES = 4 << 20


def normal_words(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


@dataclass
class Item:
    item_id: object
    words: list[str]
    budget: int


def pieces(words: list[str], budget: int) -> list[tuple[int, list[str]]]:
    """`words` in budget + 1 runs of nearly equal length, each with its offset."""
    n, k = len(words), budget + 1
    return [(i * n // k, words[i * n // k:(i + 1) * n // k]) for i in range(k)]


def nearest(pattern: list[str], text: list[str]) -> tuple[int, int]:
    """(smallest edit distance of `pattern` to a run of `text`, end of the first such run), by Myers' bit vectors."""
    m = len(pattern)
    full, top = (1 << m) - 1, 1 << (m - 1)
    equal: dict[str, int] = defaultdict(int)
    for i, word in enumerate(pattern):
        equal[word] |= 1 << i
    up, down, score = full, 0, m
    best, end = m, 0
    for at, word in enumerate(text, 1):
        eq = equal.get(word, 0)
        diagonal = (((eq & up) + up) ^ up) | eq | down
        right_up = down | (full & ~(diagonal | up))
        right_down = up & diagonal
        if right_up & top:
            score += 1
        elif right_down & top:
            score -= 1
        right_up = right_up << 1 & full
        up = (right_down << 1 & full) | (full & ~(diagonal | right_up))
        down = right_up & diagonal
        if score < best:
            best, end = score, at
    return best, end


def span_of(pattern: list[str], text: list[str]) -> tuple[int, int, int]:
    """(distance, start, end) of the first nearest run, its start found backwards from its end."""
    distance, end = nearest(pattern, text)
    _, back = nearest(pattern[::-1], text[:end][::-1])
    return distance, end - back, end


class Matcher:
    """All items of one block, ready to be looked for in documents."""

    def __init__(self, items: list[tuple[object, str | None]], budget: float):
        self.items: list[Item] = []
        where: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for item_id, text in items:
            words = normal_words(text)
            if not words:
                continue
            item = Item(item_id, words, int(budget * len(words)))
            for offset, piece in pieces(words, item.budget):
                where[f" {' '.join(piece)} "].append((len(self.items), offset))
            self.items.append(item)
        self.automaton = ahocorasick.Automaton()
        for piece, places in where.items():
            self.automaton.add_word(piece, (len(piece), places))
        if where:
            self.automaton.make_automaton()
        self.empty = not where

    def hits(self, text: str | None) -> Iterator[tuple[object, int, int, int, int, int]]:
        """(item_id, distance, budget, item words, first word, end word) per item found in `text`: its nearest run."""
        words = normal_words(text)
        if self.empty or not words:
            return
        line = f" {' '.join(words)} "
        windows: dict[int, list[tuple[int, int]]] = defaultdict(list)
        starts: list[int] | None = None
        for last, (length, places) in self.automaton.iter(line):
            if starts is None:
                starts, at = [], 1
                for word in words:
                    starts.append(at)
                    at += len(word) + 1
            first = bisect_right(starts, last - length + 2) - 1
            for number, offset in places:
                item = self.items[number]
                begin = first - offset - item.budget
                windows[number].append((max(0, begin), min(len(words), begin + len(item.words) + 2 * item.budget)))
        for number, spans in windows.items():
            item, best = self.items[number], None
            for begin, end in _merged(spans):
                distance, start, stop = span_of(item.words, words[begin:end])
                if distance <= item.budget and (best is None or distance < best[0]):
                    best = (distance, begin + start, begin + stop)
            if best:
                yield item.item_id, best[0], item.budget, len(item.words), best[1], best[2]


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping spans as one, so each word of a document is verified once per item."""
    out: list[tuple[int, int]] = []
    for begin, end in sorted(set(spans)):
        if out and begin < out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], end))
        else:
            out.append((begin, end))
    return out


def item_blocks(items: DataFrame, block_bytes: int = BLOCK_BYTES) -> Iterator[list[tuple[object, str | None]]]:
    """The test items in blocks of at most `block_bytes` of text (one item may exceed it)."""
    block, held = [], 0
    for item_id, text in items.toLocalIterator():
        size = len((text or "").encode("utf-8", "surrogatepass"))
        if block and held + size > block_bytes:
            yield block
            block, held = [], 0
        block.append((item_id, text))
        held += size
    yield block


def find_items(docs: DataFrame, items: DataFrame, keys: list[str], text: str, item_id: str = "item_id",
               item_text: str = "text", budget: float = BUDGET, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(keys..., item_id, distance, ...) of every item in every whole document.

    The test set is a stated query set: its blocks, bounded in bytes, are sent to the tasks one
    after the other, and each is held against all documents.
    """
    context = docs.sparkSession.sparkContext
    narrow = docs.select(*keys, F.col(text).alias("_text"))
    types = [f"`{k}` {narrow.schema[k].dataType.simpleString()}" for k in keys]
    item_type = items.schema[item_id].dataType.simpleString()
    schema = ", ".join([*types, f"item_id {item_type}, distance int, budget int, item_words int, start_word long, end_word long"])
    id_type = to_arrow_type(items.schema[item_id].dataType)
    found = None
    for block in item_blocks(items.select(item_id, item_text), block_bytes):
        sent = context.broadcast(block)

        def work(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(sent.value, budget)
            for batch in batches:
                at = batch.num_columns - 1
                rows, out = [], []
                for i in range(batch.num_rows):
                    for hit in matcher.hits(batch.column(at)[i].as_py()):
                        rows.append(i)
                        out.append(hit)
                taken = batch.take(pa.array(rows, pa.int32()))
                ids, *numbers = list(zip(*out)) or [()] * 6
                kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64())
                columns = [*taken.columns[:at], pa.array(ids, id_type), *[pa.array(n, t) for n, t in zip(numbers, kinds)]]
                if out:
                    names = [*batch.schema.names[:at], "item_id", "distance", "budget", "item_words", "start_word", "end_word"]
                    yield pa.RecordBatch.from_arrays(columns, names=names)

        part = narrow.mapInArrow(work, schema)
        found = part if found is None else found.unionByName(part)
    return found


def contamination(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text",
                  budget: float = BUDGET) -> DataFrame:
    """One row per document and test item found in it: doc_id, item_id, distance (word edits), budget, item_words,
    and start_word and end_word of the first nearest run among the document's normalised words.

    Documents that hold no item have no row. Words are runs of letters, digits and underscores, in
    lower case. A null or wordless text or item matches nothing; repeated rows give repeated
    rows; null ids are kept; an empty table on either side gives no rows. An item of under five
    words has no budget and must occur as it stands.
    """
    return find_items(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), items, ["doc_id"], "text", budget=budget)


def drop_contaminated(docs: DataFrame, items: DataFrame, text: str = "text", budget: float = BUDGET) -> DataFrame:
    """The documents that hold no test item; all columns stay. Handles the same cases as `contamination`."""
    columns = docs.columns
    one, two = row_key(docs)
    keyed = packed(docs).select(ROW, one.alias("k1"), two.alias("k2"))
    narrow = keyed.select("k1", "k2", field(text).alias("text"))
    bad = find_items(narrow, items, ["k1", "k2"], "text", budget=budget).select("k1", "k2").distinct()
    return unpacked(keyed.join(bad, ["k1", "k2"], "left_anti"), columns)

