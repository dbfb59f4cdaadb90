"""The pipeline's rows against the stages' plain readings."""

import collections
import os
import random

import pytest

import corpus_pipeline
from doorlens.llm import decontaminate, quality
from tests.llm.fixtures import frame, prose, split_words
from tests.llm.test_decontaminate import plain_nearest
from tests.llm.test_minhash import edited, plain_groups_first
from tests.llm.test_mixing import plain_targets
from tests.llm.test_quality import verdicts

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    rng = random.Random(9)
    items = [(i, prose(rng, 30)) for i in range(5)]
    rows = [(i, prose(rng, rng.randrange(40, 160)), "en", rng.choice(["a", "a", "b", "c", None]), 0) for i in range(120)]
    rows += [(200 + i, rows[i][1] + (" end" if i % 2 else ""), "en", rows[i][3], 0) for i in range(20)]
    # One or two of 130 words changed is a Jaccard of 0.93 or 0.86, twenty changed far below 0.8.
    rows += [(250 + i, edited(prose(random.Random(70 + i // 4), 130), rng, (0, 1, 2, 20)[i % 4]), "en", "a", 0) for i in range(32)]
    rows += [(300 + i, prose(rng, 60) + " " + items[i % 5][1] + " " + prose(rng, 60), "en", "b", 0) for i in range(10)]
    rows += [(400 + i, "menu of this site and more\n" + prose(rng, 70), "en", "d", 0) for i in range(30)]
    rows += [(None, None, None, None, None), (500, "", "en", "a", 0), rows[3], rows[3], (None, prose(rng, 80), "en", "a", 0)]
    return rows, items


def expected(rows, items):
    """(doc_id, text, source) after the first three stages."""
    judged = verdicts(rows, quality.Limits())
    kept = [(r[0], text, r[3]) for r, (ok, text) in zip(rows, judged) if ok]
    out = []
    for row in plain_groups_first(kept):
        words = decontaminate.normal_words(row[1])
        near = [plain_nearest(decontaminate.normal_words(t), words) <= int(0.2 * len(decontaminate.normal_words(t))) for _, t in items]
        if not any(near):
            out.append(row)
    return out


def test_rows(spark, tmp_path):
    rows, items = corpus()
    frame(spark, rows, DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    frame(spark, items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    want = expected(rows, items)
    assert 145 < len(want) < 172
    sizes, taken = collections.Counter(), collections.Counter()
    for _, text, source in want:
        sizes[source] += len(split_words(text))
    whole = {(i, s): t for i, t, s in want}
    for r in got:
        taken[r.source] += len(split_words(r.text))
        assert (r.doc_id, r.source) in whole and r.n_chars == len(r.text)
        assert r.text == whole[r.doc_id, r.source] or all(line in whole[r.doc_id, r.source] for line in r.text.split("\n"))
    target = plain_targets(dict(sizes))
    assert all(abs(taken[s] - target[s]) <= 1 for s in sizes)
    counts = collections.Counter(r.shard for r in got)
    assert set(counts) == set(range(8)) and max(counts.values()) - min(counts.values()) <= 1
    for shard in counts:
        assert sorted(r.slot for r in got if r.shard == shard) == list(range(counts[shard]))


@pytest.mark.parametrize("stage", [f for _, f in corpus_pipeline.STAGES])
def test_stages_take_empty_tables_and_extra_columns(spark, tmp_path, stage):
    frame(spark, [(1, "some words of an item")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    extra = DOCS + ", shard string, k1 string, fp long, component string, _row string"
    empty = stage(spark, frame(spark, [], extra), str(tmp_path))
    assert empty.count() == 0 and set(DOCS.replace(",", "").split()[::2]) <= set(empty.columns)
    rows = [(i, prose(random.Random(i), 70), "en", "a", 0, "s", "k", 1, "c", "r") for i in range(3)] + [(None,) * 10]
    out = stage(spark, frame(spark, rows, extra), str(tmp_path))
    assert {"k1", "fp", "component", "_row"} <= set(out.columns) and out.count() >= 3


@pytest.mark.parametrize("stage", [f for _, f in corpus_pipeline.STAGES])
def test_stages_tell_rows_apart_by_maps(spark, tmp_path, stage):
    """Two rows that differ in a map alone are two rows: where both stay, both maps stay."""
    frame(spark, [(1, "some words of an item")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    text = prose(random.Random(1), 70)
    rows = [(1, text, "en", "a", 0, {"a": 1}, [{"x": "y"}]), (1, text, "en", "a", 0, {"a": 2}, None)]
    out = stage(spark, frame(spark, rows, DOCS + ", m map<string,int>, n array<map<string,string>>"), str(tmp_path)).collect()
    assert {r.m["a"] for r in out} == ({1, 2} if stage is not corpus_pipeline.near_dedup else {out[0].m["a"]})


def test_registered():
    import __spark_entry__

    names = __spark_entry__.queries()
    for n in range(1, 14):
        assert sum(name.startswith(f"op{n}_") for name in names) == 1
    assert "pipeline" in names and "pipeline" not in __spark_entry__.oracle_sql()
    assert os.path.basename(corpus_pipeline.__file__) == "corpus_pipeline.py"
