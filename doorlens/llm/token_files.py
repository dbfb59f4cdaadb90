"""Token ids as bit-plane files: encode, lay out in document order, compress plane by plane, read back.

The ids of all documents in ascending doc_id order, each document closed by an end id, form one
stream. It is cut into parts (ranges of doc_id) and each part into chunks of a fixed number of ids.
A chunk's ids are transposed into bit planes, bit 0 of all ids first, as many planes as its largest
id needs, and each plane is compressed on its own with zstandard.

Layout, under one folder:
  chunks/     part, chunk, n_ids, planes (the compressed planes one after another), ends (where each ends), and the chunk's index: the
              documents it holds a piece of, with the number of ids in the piece
  parts/      part, first: ids in all parts before it
Both are Parquet, so Spark's own commit protocol makes a lost executor harmless.
"""

from __future__ import annotations

import os
import re
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import pairwise
from unicodedata import combining, is_normalized

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from doorlens.llm.common import WHITE
from doorlens.operators.ordering import count_below
from doorlens.session import ensure_checkpoint_dir

END_ID = 1
CHUNK_IDS = 1 << 14
LEVEL = 3
#: Words remembered by an encoder; beyond it they are forgotten, not wrong.
_MEMORY = 800_000
#: Of each byte: 1 an ASCII letter, 2 an ASCII sign but the apostrophe, which may belong to what follows, 3 ASCII white space.
_KIND = np.array([1 if 97 <= c <= 122 else 2 if 33 <= c <= 126 and not chr(c).isalnum() and c != 39 else 3 if chr(c) in WHITE else 0 for c in range(256)], np.uint8)
#: Words of one piece encoded as one text.
_TOGETHER = 2000
#: Bytes of text encoded together, a text at least.
_BYTES = 1 << 22


#: An ASCII capital and a mark that combines: only its small letter may compose with it, after which case no longer matters.
_CAPITAL_MARK = re.compile("[A-Z][" + "".join(chr(c) for c in range(0x300, 0x1F000) if combining(chr(c))) + "]")


def _composes(text: str) -> bool:
    """Whether the tokenizer's normal form and small letters depend on their order in this text."""
    try:
        text.encode("latin-1")  # no mark is that low
    except UnicodeEncodeError:
        return not is_normalized("NFC", text) or _CAPITAL_MARK.search(text) is not None
    return False


def _words(texts: list[str]) -> tuple[pa.LargeBinaryArray, np.ndarray]:
    """The texts' words in order and, for each text and the end, how many come before it.

    Texts are cut where the tokenizer cuts whatever stands around: at ASCII white space, and before a sign that follows a letter.
    """
    data = [text.encode("utf-8", "surrogatepass") for text in texts]
    raw = np.frombuffer(b"\n".join([*data, b""]).lower(), np.uint8)
    kind = _KIND[raw]
    inside = kind != 3
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | (kind[:-1] == 1) & (kind[1:] == 2)
    kept = raw[inside]
    bounds = np.append(np.flatnonzero(begins[inside]), len(kept)).astype(np.int64)
    words = pa.Array.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(bounds), pa.py_buffer(kept)])
    return words, np.searchsorted(np.flatnonzero(begins), np.cumsum([0, *[len(d) + 1 for d in data]]))


def _one_piece(word: str) -> bool:
    """Letters alone, normal and lower-case already: one piece to the tokenizer, whatever it is."""
    return word.isalpha() and word.isascii() or (word.isalpha() and word.lower() == word and is_normalized("NFC", word))


class Encoder:
    """Whole texts to ids, for a tokenizer that lower-cases and never joins white-space separated words or a letter and a sign.

    Words repeat, so each is encoded once while it is remembered. A text that may hold a special token, or marks that
    still compose, is encoded as a whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has the cores
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.known: dict[bytes, bytes] = {}
        vocabulary = self.tokenizer.get_vocab()
        #: Which ids end a piece.
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True

    def _learn(self, new: list[bytes]) -> None:
        """Remembers the ids of words. Words of one piece go many to a text, told apart by the ids that end a piece."""
        texts = {w: w.decode("utf-8", "surrogatepass") for w in new}
        plain = [w for w, t in texts.items() if _one_piece(t)]
        for lo in range(0, len(plain), _TOGETHER):
            part = plain[lo:lo + _TOGETHER]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(texts[w] for w in part)], add_special_tokens=False)[0].ids, np.uint32)
            cuts = (np.flatnonzero(self.ends[ids]) + 1) * ids.itemsize
            if len(cuts) == len(part):
                data = ids.tobytes()
                self.known.update(zip(part, (data[a:b] for a, b in zip([0, *cuts[:-1].tolist()], cuts.tolist()))))
        rest = [w for w in new if w not in self.known]
        found = self.tokenizer.encode_batch_fast([texts[w] for w in rest], add_special_tokens=False)
        self.known.update(zip(rest, (np.array(x.ids, np.uint32).tobytes() for x in found)))

    def encode_all(self, texts: list[str]) -> Iterator[np.ndarray]:
        """The ids of each text. Words not yet known are encoded in one go for all texts; each distinct word is looked up once."""
        whole = [any(s in text for s in self.special) or _composes(text) for text in texts]
        words, before = _words(["" if w else text for w, text in zip(whole, texts)])
        words = words.dictionary_encode()
        distinct = words.dictionary.to_numpy(zero_copy_only=False).tolist()
        if len(self.known) > _MEMORY:
            self.known.clear()
        found = list(map(self.known.get, distinct))
        if None in found:
            self._learn([w for w, ids in zip(distinct, found) if ids is None])
            found = [self.known[w] if ids is None else ids for w, ids in zip(distinct, found)]
        _, ends, data = pa.array(found, pa.large_binary()).take(words.indices).buffers()
        at = np.frombuffer(ends, np.int64)[before] // 4
        ids = np.frombuffer(data, np.uint32) if data else np.empty(0, np.uint32)
        for w, text, lo, hi in zip(whole, texts, at[:-1].tolist(), at[1:].tolist()):
            yield np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32) if w else ids[lo:hi]

    def encode(self, text: str) -> np.ndarray:
        return next(self.encode_all([text]))


@lru_cache(maxsize=1)
def encoder_at(path: str) -> Encoder:
    """The worker process's encoder, with what it remembers from earlier tasks."""
    return Encoder(path)


def pack(ids: np.ndarray, compressor: zstandard.ZstdCompressor) -> tuple[bytes, list[int]]:
    """The ids' bit planes, compressed one after another, and where each ends."""
    width = max(1, int(ids.max()).bit_length()) if len(ids) else 1
    planes = [compressor.compress(np.packbits((ids >> np.uint32(b) & np.uint32(1)).astype(bool), bitorder="little").tobytes()) for b in range(width)]
    return b"".join(planes), np.cumsum([len(p) for p in planes]).tolist()


def unpack(planes: bytes, ends: list[int], n_ids: int) -> np.ndarray:
    ids = np.zeros(n_ids, np.uint32)
    reader = zstandard.ZstdDecompressor()
    for bit, (begin, end) in enumerate(zip([0, *ends], ends)):
        plane = np.frombuffer(reader.decompress(planes[begin:end]), np.uint8)
        ids |= np.unpackbits(plane, count=n_ids, bitorder="little").astype(np.uint32) << np.uint32(bit)
    return ids


def _encoded(encoder: Encoder, batch: pa.RecordBatch) -> Iterator[tuple[int, object, np.ndarray]]:
    """part, doc_id and ids of each row, encoded in runs of about `_BYTES`."""
    run = np.cumsum(pc.binary_length(batch.column(2)).to_numpy(zero_copy_only=False), dtype=np.int64) // _BYTES
    for lo, hi in pairwise([0, *(np.flatnonzero(np.diff(run)) + 1).tolist(), batch.num_rows]):
        part, key, text = (c.slice(lo, hi - lo).to_pylist() for c in batch.columns)
        yield from zip(part, key, encoder.encode_all(text))


CHUNKS = "part int, chunk long, n_ids int, planes binary, ends array<int>, docs array<struct<doc_id: {id}, n: int, last: boolean>>"


def write_ids(docs: DataFrame, folder: str, tokenizer: str, doc_id: str = "doc_id", text: str = "text",
              end_id: int = END_ID, chunk_ids: int = CHUNK_IDS, level: int = LEVEL) -> None:
    """Writes all documents' ids under `folder`. A null text is an empty one: its end id alone.

    Documents go by doc_id (null first), those of one doc_id by text; repeated rows are repeated
    documents; an empty table writes empty tables.
    """
    narrow = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    ordered = narrow.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    ordered = ordered.select(F.spark_partition_id().alias("part"), "doc_id", "text")
    kind = narrow.schema["doc_id"].dataType
    arrow = pa.schema([("part", pa.int32()), ("chunk", pa.int64()), ("n_ids", pa.int32()), ("planes", pa.binary()), ("ends", pa.list_(pa.int32())),
                       ("docs", pa.list_(pa.struct([("doc_id", to_arrow_type(kind)), ("n", pa.int32()), ("last", pa.bool_())])))])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, compressor = encoder_at(tokenizer), zstandard.ZstdCompressor(level=level)
        pending: list[np.ndarray] = []
        pieces: list[dict] = []
        held = chunk = 0
        part = None

        def flush() -> pa.RecordBatch:
            ids = np.concatenate(pending)
            planes, ends = pack(ids, compressor)
            return pa.RecordBatch.from_pylist(
                [{"part": part, "chunk": chunk, "n_ids": len(ids), "planes": planes, "ends": ends, "docs": pieces}], schema=arrow)

        for batch in batches:
            for part, key, found in _encoded(encoder, batch):  # noqa: B007 (flush reads part)
                ids, at = np.append(found, np.uint32(end_id)), 0
                while at < len(ids):
                    take = min(chunk_ids - held, len(ids) - at)
                    pending.append(ids[at:at + take])
                    pieces.append({"doc_id": key, "n": take, "last": at + take == len(ids)})
                    held, at = held + take, at + take
                    if held == chunk_ids:
                        yield flush()
                        pending, pieces, held, chunk = [], [], 0, chunk + 1
        if held:
            yield flush()

    ordered.mapInArrow(work, CHUNKS.format(id=kind.simpleString())).write.parquet(f"{folder}/chunks")
    sizes = docs.sparkSession.read.parquet(f"{folder}/chunks").groupBy("part").agg(F.sum("n_ids").cast("long").alias("n_ids"))
    count_below(sizes, [], ["part"], "n_ids", "first").select("part", "first").write.parquet(f"{folder}/parts")


def read_ids(spark, folder: str) -> DataFrame:
    """Per document, decoded from the files: doc_id, start, n_tokens, ids_crc32 (ids as little-endian unsigned 32-bit)."""
    chunks = spark.read.parquet(f"{folder}/chunks")
    parts = spark.read.parquet(f"{folder}/parts")
    kind = chunks.schema["docs"].dataType.elementType["doc_id"].dataType
    ordered = chunks.repartition("part").sortWithinPartitions("part", "chunk").select("part", "n_ids", "planes", "ends", "docs")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at, n, crc = None, 0, 0, 0
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if row["part"] != part:
                    part, at, n, crc = row["part"], 0, 0, 0
                data = unpack(row["planes"], row["ends"], row["n_ids"]).astype("<u4")
                offset = 0
                for piece in row["docs"]:
                    crc = zlib.crc32(data[offset:offset + piece["n"]].tobytes(), crc)
                    offset, n = offset + piece["n"], n + piece["n"]
                    if piece["last"]:
                        out.append((part, piece["doc_id"], at, n, crc))
                        at, n, crc = at + n, 0, 0
            if out:
                kinds = [pa.int32(), to_arrow_type(kind), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=["part", "doc_id", "at", "n_tokens", "ids_crc32"])

    read = ordered.mapInArrow(work, f"part int, doc_id {kind.simpleString()}, at long, n_tokens long, ids_crc32 long")
    return read.join(parts, "part").select("doc_id", (F.col("first") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def scratch_folder(spark, name: str) -> str:
    """A new folder that driver and executors share."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
