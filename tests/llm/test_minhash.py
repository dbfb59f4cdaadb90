"""Near duplicates by 5-word Jaccard against all pairs."""

import random

import pytest

import corpus_pipeline
from doorlens.llm import minhash
from tests.llm.fixtures import awkward_docs, frame, prose, split_words


def plain_kept(rows):
    """The smallest doc_id of each component under Jaccard >= 0.8, and how many pairs lie at 0.8 to 0.9."""
    sets, edge = [], 0
    for r in rows:
        words = split_words("".join(c.lower() if "A" <= c <= "Z" else c for c in r[1] or ""))
        sets.append({" ".join(words[i:i + 5]) for i in range(max(1, len(words) - 4))})
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 5 * both >= 4 * len(sets[i] | sets[j]):
                edge += 10 * both < 9 * len(sets[i] | sets[j])
                a, b = label[i], label[j]
                label = [b if x == a else x for x in label]
    best = {}
    for r, x in zip(rows, label):
        best[x] = min(best.get(x, (True, 0)), (r[0] is None, r[0] or 0))
    return sorted(i for _, i in best.values()), edge


def plain_groups_first(rows):
    """One row of each group of (doc_id, text, ...) rows: the smallest doc_id, nulls last."""
    sets = []
    for r in rows:
        words = split_words("".join(c.lower() if "A" <= c <= "Z" else c for c in r[1] or ""))
        sets.append({" ".join(words[i:i + 5]) for i in range(max(1, len(words) - 4))})
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                a, b = label[i], label[j]
                label = [b if x == a else x for x in label]
    best = {}
    for r, x in zip(rows, label):
        if x not in best or (r[0] is None, r[0] or 0) < (best[x][0] is None, best[x][0] or 0):
            best[x] = r
    return list(best.values())


def edited(text, rng, n):
    words = text.split(" ")
    for at in rng.sample(range(len(words)), n):
        words[at] = f"e{rng.randrange(10 ** 6)}"
    return " ".join(words)


def near_rows(rng):
    """Texts of 100 words with up to three words changed, and a crowd around one of them."""
    rows = [(i, prose(rng, 100), "en", "a", 0, 1, "x", "y", "z") for i in range(1000, 1030)]
    near = [edited(r[1], rng, 1 + k % 3) for r in rows for k in range(3)] + [edited(rows[0][1], rng, rng.randrange(1, 5)) for _ in range(40)]
    return rows + [(2000 + i, t, "en", "a", 0, 1, "x", "y", "z") for i, t in enumerate(near)]


@pytest.mark.parametrize("tile", [4, 512])
def test_groups_equal_all_pairs(spark, tile):
    rows = near_rows(random.Random(tile)) + awkward_docs()
    want, edge = plain_kept(rows)
    got = minhash.drop_near_duplicates(frame(spark, rows), tile=tile)
    assert got.columns == frame(spark, rows).columns
    assert edge > 50 and sorted(r.doc_id or 0 for r in got.collect()) == want


def test_stage_links_at_point_eight(spark):
    """The pipeline's stage: one word in 100 changed is Jaccard 0.90, two words 0.81."""
    rng = random.Random(1)
    base = [prose(rng, 100) for _ in range(20)]
    rows = [(i, t, "en", "a", 0) for i, t in enumerate(base)]
    for i, t in enumerate(base):
        words = t.split(" ")
        words[50] = "changed"
        rows.append((100 + i, " ".join(words), "en", "a", 0))
        words[20] = "again"
        rows.append((200 + i, " ".join(words), "en", "a", 0))
    docs = frame(spark, rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()) == list(range(20))


def test_empty_table(spark):
    assert minhash.drop_near_duplicates(frame(spark, [])).count() == 0
