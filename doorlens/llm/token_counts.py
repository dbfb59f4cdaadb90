"""Token counts per section: one encoding of the whole document, attributed by byte offsets.

A document is encoded once, as a whole, so counts are those of training and not of separately encoded
pieces. The tokens' byte lengths add up to spans; sections are spans too; each token is matched to the sections it
overlaps by a sorted search over section starts. A token inside one section is that section's. One
that crosses a border goes to the section holding most of its bytes, the earlier one on a tie.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

def ranks_of(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


class Counter:
    """A tokenizer that knows how many bytes each of its tokens stands for."""

    def __init__(self, path: str, pattern: str):
        import tiktoken

        ranks = ranks_of(path)
        self.encoding = tiktoken.Encoding("counts", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.lengths = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, rank in ranks.items():
            self.lengths[rank] = len(token)

    def spans(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Begin and end byte of every token of the whole text."""
        ids = np.asarray(self.encoding.encode_ordinary(text), np.int64)
        ends = np.cumsum(self.lengths[ids])
        return ends - self.lengths[ids], ends


def line_sections(data: bytes) -> np.ndarray:
    """Where the sections of a text begin: its lines, each with the line break that ends it."""
    raw = np.frombuffer(data, np.uint8)
    starts = np.flatnonzero(raw == 10) + 1
    return np.concatenate([[0], starts[starts < len(raw)]]).astype(np.int64)


def attribute(begins: np.ndarray, ends: np.ndarray, starts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(tokens per section, of them crossing): `starts` cut [0, size) into sections."""
    counts, crossing = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
    first = np.searchsorted(starts, begins, "right") - 1
    last = np.searchsorted(starts, ends - 1, "right") - 1
    section = first.copy()
    stops = np.append(starts[1:], size)
    for i in np.flatnonzero(first != last):
        inside = np.arange(first[i], last[i] + 1)
        held = np.minimum(stops[inside], ends[i]) - np.maximum(starts[inside], begins[i])
        section[i] = inside[int(np.argmax(held))]
        crossing[section[i]] += 1
    np.add.at(counts, section, 1)
    return counts, crossing


def section_tokens(docs: DataFrame, tokenizer: str, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per section of every document: doc_id, section (from 0), start_byte, n_bytes, n_tokens, crossing_tokens, doc_tokens.

    Sections are lines. The sections' tokens add up to doc_tokens, the tokens of the whole text.
    A null or empty text has one empty section without a token; repeated rows give repeated sections; null
    doc_ids are kept; an empty table gives no rows.
    """
    narrow = docs.select(docs[doc_id].alias("doc_id"), docs[text].alias("text"))
    kind = narrow.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "section", "start_byte", "n_bytes", "n_tokens", "crossing_tokens", "doc_tokens"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(tokenizer, pattern)
        for batch in batches:
            rows, parts = [], []
            for i in range(batch.num_rows):
                whole = batch.column(1)[i].as_py() or ""
                data = whole.encode("utf-8", "surrogatepass")
                starts = line_sections(data)
                begins, ends = counter.spans(whole)
                counts, crossing = attribute(begins, ends, starts, len(data))
                rows.append(np.full(len(starts), i))
                sizes = np.diff(np.append(starts, len(data)))
                parts.append((np.arange(len(starts)), starts, sizes, counts, crossing, np.full(len(starts), len(begins))))
            if rows:
                ids = batch.column(0).take(pa.array(np.concatenate(rows)))
                columns = [np.concatenate(c) for c in zip(*parts)]
                yield pa.RecordBatch.from_arrays([ids, *[pa.array(c, pa.int64()) for c in columns]], names=names)

    return narrow.mapInArrow(work, f"doc_id {kind}, " + ", ".join(f"{n} long" for n in names[1:]))
