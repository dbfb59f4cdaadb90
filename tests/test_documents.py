"""Documents of unknown shape against a plain recursive walk."""

import json
import random
import re

import pytest

from doorlens.operators import documents, report


def walk(node, path, out):
    if isinstance(node, dict):
        for key, value in node.items():
            here = f"{path}.{key}" if path else key
            out.append((here, key))
            walk(value, here, out)
    elif isinstance(node, list):
        for value in node:
            walk(value, path + "[]", out)
    return out


def cleaned(node):
    if isinstance(node, dict):
        return {k: cleaned(v) for k, v in node.items() if k.lower() not in documents.PRIVATE_KEYS}
    return [cleaned(v) for v in node] if isinstance(node, list) else node


def made(rng, depth=0):
    kind = rng.randrange(7) if depth < 5 else 6
    if kind < 3:
        keys = rng.sample(["a", "b c", 'q"uote', "Owner", "taxpayer_id", "details", "list", "MAILING", "x.y", "agents", "é"], rng.randrange(5))
        return {k: made(rng, depth + 1) for k in keys}
    if kind < 5:
        return [made(rng, depth + 1) for _ in range(rng.randrange(4))]
    return rng.choice([None, True, False, 0, -3, 12345678901, 1.5, "", "text", 'with "quotes" and \\', "owner", "é\n"])


def corpus():
    rng = random.Random(5)
    docs = [made(rng) for _ in range(120)] + [{"details": {"list": [{"taxpayer_id": 1}, {"taxpayer_id": 2, "x": [[{"Permit_Agent": {"a": 1}}]]}]}}, {}, [], 3, "owner"]
    return [(i, json.dumps(d, ensure_ascii=bool(i % 2)), "kept") for i, d in enumerate(docs)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "k long, body string, key string").repartition(3)


def test_paths_equal_a_recursive_walk(spark):
    rows = corpus()
    got = documents.key_paths(frame(spark, [*rows, (900, "no json {", "x"), (901, None, "x")]), "body", ["k"]).collect()
    want = [(i, p, k) for i, text, _ in rows for p, k in walk(json.loads(text), "", [])]
    assert sorted(map(tuple, got)) == sorted(want)


def test_identity_paths(spark):
    rows = corpus()
    got = {r.path: r.rows for r in documents.identity_paths(frame(spark, rows), "body", ["k"]).collect()}
    want = {}
    for _, text, _ in rows:
        for path in {p for p, k in walk(json.loads(text), "", []) if re.search(documents.IDENTITY_PATTERN, k)}:
            want[path] = want.get(path, 0) + 1
    assert got == want and got["details.list[].taxpayer_id"] >= 1


def test_private_keys_go_at_any_depth(spark):
    rows = corpus()
    got = documents.without_keys(frame(spark, [*rows, (900, "no json {", "x")]), "body", ["k"]).collect()
    assert {r.k: json.loads(r.body) for r in got if r.body is not None} == {i: cleaned(json.loads(text)) for i, text, _ in rows}
    assert {r.k for r in got} == {i for i, *_ in rows} | {900} and all(r.key in ("kept", "x") for r in got)
    assert documents.without_keys(frame(spark, []), "body", ["k"]).count() == 0


def test_an_identity_stops_the_publish(spark):
    pages = spark.createDataFrame([(1, '{"a": [{"Mailing City": 1}]}'), (2, '{"b": 2}')], "k long, body string")
    clean = spark.createDataFrame([("p", 1)], "pams_pin string, score int")
    found = report.identity_findings({"pages": pages, "doors": clean}, {"pages": ("body", ["k"])})
    assert [tuple(r) for r in found.collect()] == [("pages", "body:a[].Mailing City", 1)]
    with pytest.raises(ValueError, match=r"pages.body:a\[\].Mailing City"):
        report.require_no_identity(found)
    report.require_no_identity(report.identity_findings({"doors": clean}))
