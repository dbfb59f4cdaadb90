"""Ids written as bit planes and read back; counts by section."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import zstandard
from tokenizers import Tokenizer

from doorlens.llm import token_counts, token_files
from tests.llm.fixtures import awkward_docs, frame

WORDS = public_tokenizers.path("word_bpe_49k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
HARD = ["<|endoftext|> a<|startoftext|>b", "e\u0301 \u0301x", "a\x1cb\x1f.\x85c\xa0d\u2003e", "it's  I'LL 42x7", "\u1100\u1161 \u0130\u0131 \u03a3\u03c2", "...!!!\x0b??", "\ufeffbom \u200bzero"]


def docs():
    return awkward_docs() + [(500 + i, t, "en", "a", 0, 1, "x", "y", "z") for i, t in enumerate(HARD)]


@pytest.mark.parametrize("chunk", [64, 1 << 14])
def test_files_equal_the_tokenizer(spark, tmp_path, chunk):
    token_files.write_ids(frame(spark, docs()), str(tmp_path / "ids"), WORDS, chunk_ids=chunk)
    got = token_files.read_ids(spark, str(tmp_path / "ids")).collect()
    tokenizer, at, want = Tokenizer.from_file(WORDS), 0, []
    for row in sorted(docs(), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = np.array([*tokenizer.encode(row[1] or "", add_special_tokens=False).ids, 1], "<u4")
        want.append((row[0], at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == [(a, i, n, c) for i, a, n, c in want]


def test_planes_round_trip():
    rng = np.random.default_rng(0)
    pack = zstandard.ZstdCompressor()
    for ids in ([0], [1], [2**32 - 1, 0, 7], rng.integers(0, 49408, 5000), [3] * 1000):
        ids = np.array(ids, np.uint32)
        planes, ends = token_files.pack(ids, pack)
        assert len(ends) == max(1, int(ids.max()).bit_length())
        assert (token_files.unpack(planes, ends, len(ids)) == ids).all()


def test_no_documents(spark, tmp_path):
    token_files.write_ids(frame(spark, []), str(tmp_path / "ids"), WORDS)
    assert token_files.read_ids(spark, str(tmp_path / "ids")).count() == 0


def test_section_counts_add_up(spark):
    rows = docs() + [(600, "a\n\n\nb  \n   c\n", "en", "a", 0, 1, "x", "y", "z")]
    got = token_counts.section_tokens(frame(spark, rows), RANKS, public_tokenizers.PATTERN).collect()
    encoding = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=token_counts.ranks_of(RANKS), special_tokens={})
    for row in rows:
        mine = sorted((r for r in got if r.doc_id == row[0]), key=lambda r: r.section)
        copies = sum(r[0] == row[0] for r in rows)
        tokens = len(encoding.encode_ordinary(row[1] or ""))
        if copies == 1:
            assert sum(r.n_tokens for r in mine) == tokens and {r.doc_tokens for r in mine} == {tokens}
            data = (row[1] or "").encode()
            assert sum(r.n_bytes for r in mine) == len(data)
            want = [0] * len(mine)
            pos = 0
            for t in encoding.encode_ordinary(row[1] or ""):
                end = pos + len(encoding.decode_single_token_bytes(t))
                held = [min(end, r.start_byte + r.n_bytes) - max(pos, r.start_byte) for r in mine]
                want[held.index(max(held))] += 1
                pos = end
            assert [r.n_tokens for r in mine] == want
    assert token_counts.section_tokens(frame(spark, []), RANKS, public_tokenizers.PATTERN).count() == 0


def test_crossing_rule():
    counts, crossing = token_counts.attribute(np.array([0, 2, 5, 8]), np.array([2, 5, 8, 9]), np.array([0, 3, 7]), 9)
    assert counts.tolist() == [1, 2, 1] and crossing.tolist() == [0, 2, 0]
    counts, _ = token_counts.attribute(np.array([0]), np.array([4]), np.array([0, 2]), 4)
    assert counts.tolist() == [1, 0]


def test_random_texts_equal_whole_encoding():
    rng, encoder, tokenizer = random.Random(4), token_files.Encoder(WORDS), Tokenizer.from_file(WORDS)
    signs = [chr(c) for c in (32, 9, 10, 11, 12, 13, 28, 31, 39, 45, 48, 65, 72, 73, 74, 97, 133, 160, 0x300, 0x301, 0x307, 0x308, 0x30a, 0x30c, 0x323, 0x331, 0x94d, 0x3a3, 0x4e00, 0xac00, 0x1100, 0x1161, 0x2003, 0x1f600)]
    for _ in range(2000):
        text = "".join(rng.choices(signs, k=rng.randrange(0, 12)))
        assert encoder.encode(text).tolist() == tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


@pytest.mark.parametrize("text", ["J\u030c", "H\u0331", "T\u0308", "W\u030a", "Y\u030a", "I\u0307\u094d", "H\u0323\u0331 x", "a J\u030c. b"])
def test_capitals_whose_mark_composes_with_the_small_letter(text):
    encoder, tokenizer = token_files.Encoder(WORDS), Tokenizer.from_file(WORDS)
    assert encoder.encode(text).tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_every_letter_with_a_mark():
    encoder, tokenizer = token_files.Encoder(WORDS), Tokenizer.from_file(WORDS)
    letters = [chr(c) for c in [*range(65, 91), *range(97, 123)]]
    texts = [f"{a}{chr(m)}" for a in letters for m in range(0x300, 0x345)]
    want = tokenizer.encode_batch(texts, add_special_tokens=False)
    assert [x.tolist() for x in encoder.encode_all(texts)] == [w.ids for w in want]


def test_texts_together_equal_each_alone():
    rng, encoder, tokenizer = random.Random(5), token_files.Encoder(WORDS), Tokenizer.from_file(WORDS)
    signs = [*" \t\n\x0b\x0c\r", *"aAbz'.#-_4", "\xe9", "́", "œ", "一", "<|endoftext|>"]
    texts = ["", " ", "a", ".", *["".join(rng.choices(signs, k=rng.randrange(0, 9))) for _ in range(500)], ""]
    want = [tokenizer.encode(text, add_special_tokens=False).ids for text in texts]
    assert [x.tolist() for x in encoder.encode_all(texts)] == want
    assert [x.tolist() for x in encoder.encode_all(["", "\n"])] == [[], []] and list(encoder.encode_all([])) == []


def test_a_word_is_looked_up_once_for_all_texts():
    class Counting(dict):
        asked = 0

        def __getitem__(self, word):
            Counting.asked += 1
            return super().__getitem__(word)

        def get(self, word, default=None):
            Counting.asked += 1
            return super().get(word, default)

    encoder = token_files.Encoder(WORDS)
    encoder.known = Counting()
    texts = ["one two, " * 300] * 20
    first = [x.tolist() for x in encoder.encode_all(texts)]
    Counting.asked = 0
    assert [x.tolist() for x in encoder.encode_all(texts)] == first and Counting.asked <= 3
