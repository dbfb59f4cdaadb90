"""The pipeline's near-duplicate stage goes through SimHash fingerprints."""

import random

import numpy as np

import corpus_pipeline
from doorlens.llm import minhash, simhash
from tests.llm.fixtures import frame, prose
from tests.llm.test_minhash import edited


def test_stage_links_fingerprints(spark, monkeypatch):
    asked, links = [], simhash.links
    monkeypatch.setattr(simhash, "links", lambda prints, *more: asked.append(prints.count()) or links(prints, *more))
    rng = random.Random(3)
    base = [prose(rng, 400) for _ in range(5)]
    rows = [(i, t, "en", "a", 0) for i, t in enumerate(base)] + [(10 + i, edited(t, rng, 1), "en", "a", 0) for i, t in enumerate(base)]
    docs = frame(spark, rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()) == list(range(5))
    assert len(asked) == 1 and 5 < asked[0] <= 10


def test_pairs_of_near_fingerprints(spark):
    rng = random.Random(4)
    centres = [rng.getrandbits(64) for _ in range(8)]
    prints = [(bytes([i, j]), c ^ (0 if j == 0 else 15 << (4 * j))) for i, c in enumerate(centres) for j in range(4)]
    rows = [(node, int(np.uint64(fp).view(np.int64))) for node, fp in prints]
    got = {(bytes(r.node), bytes(r.centre)) for r in minhash.simhash_pairs(spark.createDataFrame(rows, "node binary, fp long")).collect()}
    assert got == {(bytes([i, j]), bytes([i, 0])) for i in range(8) for j in range(1, 4)}


def test_fingerprint_of_a_set():
    rng = random.Random(5)
    for n in (1, 2, 60, 5000):
        hashes = [rng.getrandbits(64) for _ in range(n)]
        want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > n)
        assert int(np.int64(minhash.fingerprint(np.array(hashes, np.uint64))).view(np.uint64)) == want
