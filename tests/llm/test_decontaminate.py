"""Pigeonhole edit matching against the full edit distance table."""

import random

from doorlens.llm import decontaminate
from tests.llm.fixtures import awkward_docs, frame, prose


def plain_nearest(pattern, text):
    """Smallest edit distance of `pattern` to any run of `text`."""
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        last, row[0] = row[0], i
        for j, t in enumerate(text, 1):
            last, row[j] = row[j], min(last + (p != t), row[j] + 1, row[j - 1] + 1)
    return min(row)


def test_myers_equals_the_table():
    rng = random.Random(0)
    for _ in range(300):
        pattern = rng.choices("abcd", k=rng.randrange(1, 90))
        text = rng.choices("abcd", k=rng.randrange(0, 120))
        distance, start, end = decontaminate.span_of(pattern, text)
        assert distance == plain_nearest(pattern, text)
        assert plain_nearest(pattern, text[start:end]) == distance and 0 <= start <= end <= len(text)


def edited(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        at, kind = rng.randrange(len(words)), rng.randrange(3)
        words[at:at + 1] = [["zz"], [], [words[at], "zz"]][kind]
    return words


def test_hits_equal_brute_force(spark):
    rng = random.Random(5)
    items = [(i, prose(rng, n, 200)) for i, n in enumerate([1, 3, 5, 9, 20, 40, 41, 80])] + [(None, prose(rng, 30)), (98, None), (99, " ,. "), (97, "Same"), (97, "Same")]
    rows = awkward_docs()
    for i in range(60):
        item = rng.choice(items[2:9])[1].split()
        words = prose(rng, 50, 200).split() + edited(rng, item, rng.randrange(0, len(item) // 4 + 2)) + prose(rng, 50, 200).split()
        rows.append((1000 + i, rng.choice([" ", "\n", "  "]).join(words).upper(), "en", "a", 0, 1, "x", "y", "z"))
    got = decontaminate.contamination(frame(spark, rows), frame(spark, items, "item_id long, text string")).collect()
    want = []
    for row in rows:
        words = decontaminate.normal_words(row[1])
        for item_id, text in items:
            pattern = decontaminate.normal_words(text)
            if pattern and len(words) < 5000:
                distance = plain_nearest(pattern, words)
                if distance <= int(0.2 * len(pattern)):
                    want.append((row[0], item_id, distance))
    order = lambda t: tuple((x is None, x or 0) for x in t)
    assert sorted(((r.doc_id, r.item_id, r.distance) for r in got if r.doc_id != 11), key=order) == sorted(want, key=order)
    assert len(want) > 30
    kept = decontaminate.drop_contaminated(frame(spark, rows), frame(spark, items, "item_id long, text string"))
    assert kept.columns == frame(spark, rows).columns
    bad = {r.doc_id for r in got}
    assert sorted(r.doc_id or -1 for r in kept.collect()) == sorted(r[0] or -1 for r in rows if r[0] not in bad)


def test_many_blocks_give_the_same(spark):
    rng = random.Random(6)
    items = frame(spark, [(i, prose(rng, 20)) for i in range(12)], "item_id long, text string")
    rows = [(i, prose(rng, 30) + " " + r.text + " " + prose(rng, 30)) for i, r in enumerate(items.collect())]
    docs = frame(spark, rows, "doc_id long, text string")
    one = decontaminate.find_items(docs, items, ["doc_id"], "text").collect()
    many = decontaminate.find_items(docs, items, ["doc_id"], "text", block_bytes=100).collect()
    assert sorted(map(tuple, one)) == sorted(map(tuple, many)) and len(one) == 12


def test_empty_tables(spark):
    items = frame(spark, [], "item_id long, text string")
    assert decontaminate.contamination(frame(spark, awkward_docs()), items).count() == 0
    assert decontaminate.contamination(frame(spark, []), items).count() == 0
    assert decontaminate.drop_contaminated(frame(spark, awkward_docs()), items).count() == len(awkward_docs())
