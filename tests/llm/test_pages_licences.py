"""The two trained models: exact inference, held-out accuracy, and the awkward cases."""

import itertools
import random

import numpy as np
import pytest

from doorlens.llm import html_text, licences
from tests.llm.fixtures import awkward_docs, frame, prose


@pytest.fixture(scope="module")
def pages_model():
    return html_text.train(html_text.labelled_pages())


def text_of(model, html):
    page = html_text.parse(html)
    return html_text.main_text(page, html_text.marginals(*model.potentials([page]))[:, html_text.CONTENT] > 0.5)


def test_marginals_are_exact():
    rng = np.random.default_rng(0)
    for parent in ([-1], [-1, 0, 0, 1, 1, 2], [-1, 0, 1, 2, 3], [-1, 0, 0, 0, 0], [-1, 0, -1, 2, 2]):
        n = len(parent)
        depth = np.zeros(n, np.int64)
        for i, p in enumerate(parent):
            depth[i] = depth[p] + 1 if p >= 0 else 0
        node, edge = rng.normal(size=(n, 3)), rng.normal(size=(n, 3, 3))
        want = np.zeros((n, 3))
        for y in itertools.product(range(3), repeat=n):
            score = sum(node[i, y[i]] for i in range(n)) + sum(edge[i, y[p], y[i]] for i, p in enumerate(parent) if p >= 0)
            for i in range(n):
                want[i, y[i]] += np.exp(score)
        got = html_text.marginals(node, edge, np.array(parent), depth)
        assert np.allclose(got, want / want.sum(1, keepdims=True))


def test_held_out_pages(pages_model):
    codes = {"outer": 0, "content": 1, "other": 2}
    right = total = 0
    for html in html_text.labelled_pages(200, seed=99):
        page = html_text.parse(html)
        content = html_text.marginals(*pages_model.potentials([page]))[:, 1] > 0.5
        label = [0] * len(page.parent)
        for i in range(1, len(label)):
            label[i] = codes.get(page.label[i], label[page.parent[i]])
            if page.text[i] is not None:
                total, right = total + 1, right + ((label[i] == 1) == content[i])
    assert right / total > 0.97


PAGE = """<!DOCTYPE html><html><head><title>T &amp; U</title><style>p{}</style><script>var a = "</p><p>x";</script></head><body>
<nav><ul><li><a href="/">Home</a><li><a href="/b">B</a></ul></nav><!-- <p>gone</p> --><div class="cookie-notice">We use cookies <button>OK</button></div>
<article><h1>T &amp; U</h1><p><b>One   &lt;two&gt;
three<br><p>four &#233;&nbsp;five</p><div class="ad">Buy this</div><ul><li>six<li>seven</ul></article>
<section class="comments"><h3>2 comments</h3><div class="comment"><p>I think that this is a long comment, longer than the article itself.</p></div></section>
<aside><p>Related: many other good things to read for hours and hours</p></aside><form><label>Mail</label><input></form><footer>&copy; all</footer></body></html>"""


def test_page(pages_model):
    assert text_of(pages_model, PAGE) == "T & U\nOne <two> three\nfour é five\nsix\nseven"


@pytest.mark.parametrize("html", ["", " ", "<", "<p", "</p></div>", "<!-- x", "<p><!-- x</p>", "<script>", "<script>var a = 1", "&", "<br/><br/>", "<nav>a</nav>"])
def test_broken_pages_have_no_text(pages_model, html):
    assert text_of(pages_model, html) in ("", "<", "&", "<p")


@pytest.mark.parametrize("html", [
    "<!-- x --!>", "<!-->", "<!--->", "<!-- a -- > b <p>no</p> -->", "<style><!-- .a {} </style>", "<script>var a = '<!--';</script>", "<i title='<!-- x'></i>",
    "<template><!-- x --></template>", "<!-- </article> --!>",
])
def test_comments_end_where_html_ends_them(pages_model, html):
    body = "<p>one two three</p>" * 3
    lines = "one two three\n" * 5 + "one two three"
    assert text_of(pages_model, f"<html><body><article>{body}{html}{body}</article></body></html>") == lines


def test_an_unclosed_comment_takes_the_rest(pages_model):
    assert text_of(pages_model, "<article><p>one two three</p><p>four five<!-- six</p><p>seven</p></article>") == "one two three\nfour five"


def test_raw_elements_inside_one_another(pages_model):
    assert text_of(pages_model, "<article><p>a</p><template><script>x</script>y</template><p>b</p></article>") == "a\nb"


def test_deep_and_long_pages(pages_model):
    assert len(html_text.parse("<div>" * 50000 + "<p>x" + "</i>" * 50000 + "<p>y" * 2000).parent) == 54003
    assert text_of(pages_model, "<article>" + "<div>" * 3000 + "<p>deep</p>") in ("deep", "")
    assert text_of(pages_model, "<article><p>" + "word " * 200000 + "</p></article>").count("word") == 200000


def test_pages_query(spark):
    rows = [(1, "u", PAGE, 1), (1, "u", PAGE, 1), (None, None, None, 1), (2, "v", "", 1)]
    got = html_text.extract(frame(spark, rows, "page_id long, url string, html string, text long")).collect()
    text = "T & U\nOne <two> three\nfour é five\nsix\nseven"
    order = lambda t: tuple((x is None, x or 0) for x in t)
    assert sorted(map(tuple, got), key=order) == sorted([(1, "u", text, len(text))] * 2 + [(None, None, "", 0), (2, "v", "", 0)], key=order)
    assert html_text.extract(frame(spark, [], "page_id long, url string, html string")).count() == 0


@pytest.fixture(scope="module")
def licence_model():
    rng = random.Random(0)
    return licences.train([prose(rng, 30) for _ in range(200)])


def test_licence_families(licence_model):
    for family, texts in licences.TEMPLATES.items():
        for text in texts:
            for shown in (f"{text}.", f"The files here are {text}, as of today.", text.upper()):
                found = licence_model.finding(licences.paragraph_words(shown))
                assert found and found[0] == family and found[3] == 1.0, (shown, found)


def test_sentences_without_licence(licence_model):
    rng = random.Random(1)
    for text in [*licences.OTHER, "", "license", "MIT", "the general public was free to use the software under version 2", *[prose(rng, 40) for _ in range(50)]]:
        assert licence_model.finding(licences.paragraph_words(text)) is None if text else True


WRAPPED = {
    "gpl": """# This program is free software: you can redistribute it and/or modify
# it under the terms of the GNU General Public License as published by
# the Free Software Foundation, either version 3 of the License, or
# (at your option) any later version.""",
    "lgpl": """ * This library is free software; you can redistribute it and/or
 * modify it under the terms of the GNU Lesser General Public
 * License as published by the Free Software Foundation; either
 * version 2.1 of the License, or (at your option) any later version.""",
    "agpl": """// it under the terms of the GNU Affero General Public License as
// published by the Free Software Foundation, either version 3 of the
// License, or (at your option) any later version.""",
    "bsd": """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions
are met:""",
    "mit": """; Permission is hereby granted, free of charge, to any person obtaining
; a copy of this software and associated documentation files (the
; "Software"), to deal in the Software without restriction""",
    "isc": """-- Permission to use, copy, modify, and/or distribute this software for any
-- purpose with or without fee is hereby granted, provided that the above
-- copyright notice appears""",
    "zlib": """Permission is granted to anyone to use this software for any purpose,
including commercial applications, and to alter it""",
    "unlicense": """This is free and unencumbered software
released into the public domain.""",
}
FIRST = {"gpl": 1, "lgpl": 1}


@pytest.mark.parametrize("family", WRAPPED)
def test_wrapped_notices_are_found_on_their_first_line(licence_model, family):
    rng = random.Random(4)
    for before in ("", prose(rng, 12) + "\n", prose(rng, 150) + "\n\n"):
        for after in ("", "\n" + prose(rng, 150), "\n\n" + prose(rng, 9)):
            got = licences.findings(licence_model, before + WRAPPED[family] + after)
            assert [(line, f) for line, f, *_ in got] == [(before.count("\n") + FIRST.get(family, 0), family)], (got, before[:20])


def test_short_forms(licence_model):
    for text, family in (("GPL version 2 only", "gpl"), ("BSD-2-Clause licensed", "bsd"), ("made available under the terms of the Eclipse Public License", "epl")):
        assert [f for _, f, *_ in licences.findings(licence_model, f"x\n{text}\ny")] == [family]


def test_unknown_is_calibrated(licence_model):
    """Held-out notices in settings never seen: probabilities are about as often right as they say."""
    made = [(f"Note that the text was {t} and more", f) for f, ts in licences.TEMPLATES.items() for t in ts]
    p = licence_model.probabilities([licences.paragraph_words(t) for t, _ in made])
    right = np.array([licence_model.families[i] == f for i, (_, f) in zip(p.argmax(1), made)])
    assert right.mean() > 0.9 and abs(right.mean() - p.max(1).mean()) < 0.15


def test_scan_finds_planted_lines(spark):
    rng = random.Random(3)
    rows, want = awkward_docs(), set()
    for i, (family, texts) in enumerate(sorted(licences.TEMPLATES.items())):
        lines = [prose(rng, 20), f"{texts[0]}.", prose(rng, 20)]
        rows.append((700 + i, "\n".join(lines), "en", "a", 0, 1, "x", "y", "z"))
        want.add((700 + i, 1, family))
    got = licences.scan(frame(spark, rows)).collect()
    assert {(r.doc_id, r.paragraph, r.family) for r in got} == want
    assert licences.scan(frame(spark, [])).count() == 0
