"""Suggested addresses against comparing every key with every other by the standard library's matching blocks."""

import difflib
import random

from pyspark.sql import functions as F

from doorlens.operators import suggest

KEYS = "t int, address_key string"


def best(word, known, floor):
    scored = [(difflib.SequenceMatcher(None, k, word).ratio(), k) for k in known]
    return max([s for s in scored if s[0] >= floor - 1e-12], default=None)


def texts(rnd, n):
    streets = ["OAK ST", "ELM AVE", "MAIN ST", "FAWN HILL RD", "E CEDAR TER", "AB", "A", "ABAB", "AXBXCXDX", "AYBYCYDY", "NORTH PINE ST"]
    out = []
    for _ in range(n):
        kind = rnd.random()
        if kind < 0.6:
            text = f"{rnd.randrange(1, 120)} {rnd.choice(streets)}"
        elif kind < 0.8:
            text = "".join(rnd.choice("AB ") for _ in range(rnd.randrange(1, 16))).strip()
        else:
            text = rnd.choice(streets)
        letters = list(text)
        for _ in range(rnd.randrange(3)):
            if letters:
                letters[rnd.randrange(len(letters))] = rnd.choice("ABCXYZ1 ")
        out.append("".join(letters).strip())
    return out


def test_likeness_is_that_of_matching_blocks(spark):
    rnd = random.Random(5)
    pairs = [(a, b) for a, b in zip(texts(rnd, 600), texts(rnd, 600))] + [("", ""), ("", "A"), ("ÄÖ x", "ÖÄ x"), ("A" * 60, "A" * 59)]
    rows = spark.createDataFrame(pairs, "a string, b string").select("a", "b", suggest.block_likeness(F.col("a"), F.col("b")).alias("got")).collect()
    for row in rows:
        assert abs(row.got - difflib.SequenceMatcher(None, row.a, row.b).ratio()) < 1e-12, row
    empty = spark.createDataFrame([(None, "A"), ("A", None)], "a string, b string")
    assert [r[0] for r in empty.select(suggest.block_likeness(F.col("a"), F.col("b"))).collect()] == [None, None]


def check(spark, asked, known, floor):
    a = spark.createDataFrame(asked, "t int, address_key string, extra int") if asked else spark.createDataFrame([], "t int, address_key string, extra int")
    k = spark.createDataFrame(known, "t int, known_key string") if known else spark.createDataFrame([], "t int, known_key string")
    got = {(r.t, r.address_key): (r.likeness, r.suggested_key) for r in suggest.suggestions(a, k, floor, by=("t",)).collect()}
    want = {}
    for t, word, _ in asked:
        if word:
            there = best(word, {x for s, x in known if s == t and x}, floor)
            if there:
                want[(t, word)] = there
    assert set(got) == set(want)
    for key, (likeness, name) in want.items():
        assert abs(got[key][0] - likeness) < 1e-12 and got[key][1] == name, key


def test_equals_full_comparison(spark):
    rnd = random.Random(11)
    asked = [(rnd.randrange(2), w, 1) for w in texts(rnd, 250)]
    known = [(rnd.randrange(2), w) for w in texts(rnd, 250)]
    for floor in (0.6, 0.85):
        check(spark, asked, known, floor)


def test_low_floor_nulls_and_empty_tables(spark):
    check(spark, [(0, "AB", 1), (0, "XYZ", 2), (0, "", 3), (0, None, 4), (0, "AB", 5)], [(0, "BA"), (0, "CAB"), (0, None), (0, ""), (1, "AB")], 0.4)
    check(spark, [], [(0, "AB")], 0.6)
    check(spark, [(0, "AB", 1)], [], 0.6)


def test_candidates_are_far_fewer_than_pairs(spark):
    streets = [f"{a}{b} ST" for a in ("OAK", "ELM", "PINE", "MAPLE", "CEDAR", "FAWN", "LAKE", "HILL") for b in ("WOOD", "RIDGE", "BROOK", "FIELD", "SIDE", "VIEW", "DALE", "MONT")]
    known = [(0, f"{n} {s}") for s in streets for n in range(100, 120)]
    asked = [(0, s.replace("O", "OO", 1) if "O" in s else s + "X", 1) for _, s in known[::7]]
    a = spark.createDataFrame(asked, "t int, address_key string, extra int")
    k = spark.createDataFrame(known, "t int, known_key string")
    parts = suggest.candidates(a, k, by=("t",))
    assert parts["first"].count() <= len(asked)
    assert parts["first"].count() + parts["second"].count() < 0.15 * len(asked) * len(known)
    check(spark, asked[:40], known, 0.6)
