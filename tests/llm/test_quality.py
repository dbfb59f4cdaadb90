"""Quality rules against a plain reading."""

import collections
import random
import re

import duckdb
import pytest

from doorlens.llm import quality, queries
from tests.llm.fixtures import awkward_docs, frame, prose, split_words


def expected_base(text):
    text = text or ""
    words = split_words(text)
    lines = [line for line in text.split("\n") if split_words(line)]
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    counts = collections.Counter(windows)
    covered = {i + j for i, w in enumerate(windows) if counts[w] > 1 for j in range(3)}
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), failed)


def normal(line):
    return re.sub(r"[ \t-\r]+", " ", line.lower()).strip(" ")


def verdicts(rows, limits):
    """(kept, text without its frequent lines) per row."""
    holders, documents = collections.defaultdict(set), collections.defaultdict(set)
    for row in rows:
        documents[row[3]].add(row[1])
        for line in map(normal, (row[1] or "").split("\n")):
            if line:
                holders[row[3], line].add(row[1])
    above = {k for k, v in holders.items() if len(v) > limits.min_documents and len(v) > limits.share * len(documents[k[0]])}
    out = []
    for row in rows:
        lines = (row[1] or "").split("\n")
        gone = [line for line in lines if (row[3], normal(line)) in above]
        n, failed = expected_base(row[1])[0], expected_base(row[1])[-1]
        left = n - sum(len(split_words(line)) for line in gone)
        kept = not failed and left >= limits.min_words_left and left >= limits.min_part_left * n
        out.append((kept, "\n".join(line for line in lines if (row[3], normal(line)) not in above)))
    return out


def site_docs():
    rng = random.Random(3)
    rows = awkward_docs()
    for i in range(40):
        body = prose(rng, 30 if i % 3 == 0 else 90)
        head = "Home  About\tCONTACT us here now and more words to fill the line of the host"
        foot = "all Rights reserved by the owner of this site and of many other sites as well " + "x " * 9
        text = f"{head}\n{body}\n{foot}" if i % 3 == 0 else f"{head.upper()}\n{body}"
        rows.append((100 + i, text, "en", "site", len(text), 1, "x", "y", "z"))
    return rows + [rows[-1]] * 30 + [(900 + i, "copied line of one text\n" + rows[5][1], "en", "copies", 0, 1, "x", "y", "z") for i in range(30)]


def test_report_equals_plain_reading(spark):
    rows, limits = site_docs(), quality.Limits()
    got = quality.quality_report(frame(spark, rows), limits=limits).collect()
    key = lambda t: tuple((x is None, x or 0) for x in t)
    want = sorted(((r[0], *expected_base(r[1]), v[0]) for r, v in zip(rows, verdicts(rows, limits))), key=key)
    assert sorted((tuple(r)[:8] for r in got), key=key) == want
    assert sum(not r.kept and not r.base_failed for r in got) == 44  # the site's depleted pages, one of them 31 times, and nothing else


def test_rules_take_effect(spark):
    rows, limits = site_docs(), quality.Limits()
    df = frame(spark, rows)
    got = quality.apply_quality_rules(df, limits=limits)
    assert got.columns == df.columns
    want = [(r[0], text, *r[2:4]) for r, (kept, text) in zip(rows, verdicts(rows, limits)) if kept]
    order = lambda t: (t[0] is None, t[0] or 0, t[1])
    found = got.collect()
    assert sorted((tuple(r)[:4] for r in found), key=order) == sorted(want, key=order)
    assert all(r.n_chars == len(r.text) for r in found)


@pytest.mark.parametrize("work", [quality.quality_report, quality.apply_quality_rules])
def test_empty_table(spark, work):
    assert work(frame(spark, [])).count() == 0


def test_no_python_in_the_plan(spark):
    plan = quality.quality_report(frame(spark, awkward_docs()))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_long_lines_are_furniture_too(spark):
    """A notice of 40 words in every document of a host goes, as a short one does."""
    rng = random.Random(5)
    notice = " ".join(f"n{i}" for i in range(40))
    rows = [(i, f"{prose(rng, 90)}\n{notice}", "en", "site", 0, 1, "x", "y", "z") for i in range(20)]
    df = frame(spark, rows)
    assert {(r.gone_lines, r.gone_words, r.kept) for r in quality.quality_report(df).collect()} == {(1, 40, True)}
    assert sorted(r.text for r in quality.apply_quality_rules(df).collect()) == sorted(r[1].split("\n")[0] for r in rows)


def test_sql_equals_the_query(spark, tmp_path):
    """Lines of any length, in both engines."""
    rng = random.Random(6)
    notice = " ".join(f"n{i}" for i in range(40))
    rows = [(i, f"{prose(rng, 90 if i % 2 else 45)}\n{notice}", "en", "site", 0, 1, "x", "y", "z") for i in range(30)] + site_docs()[:40]
    frame(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    duckdb.execute(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = queries.op1_quality_rules(spark, str(tmp_path))
    want = duckdb.sql(queries.OP1_SQL)
    assert got.columns == want.columns
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want.fetchall(), key=str)
    assert sum(r[8] == 1 and r[9] == 40 for r in want.fetchall()) >= 30
