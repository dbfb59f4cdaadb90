"""Small tables with every awkward case, and plain readings of them."""

from __future__ import annotations

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, fp long, _row string, k1 string, slot string"


def prose(rng: random.Random, n: int, vocabulary: int = 300) -> str:
    return " ".join(f"w{rng.randrange(vocabulary)}" + rng.choice(["", "", "", ".", ","]) for _ in range(n))


def awkward_docs(seed: int = 1) -> list[tuple]:
    """Nulls in any column, empty, blank and very long texts, ties, repeated rows, near and exact copies, names that clash."""
    rng = random.Random(seed)
    base = prose(rng, 120)
    near = base.replace(" w1", " W1", 1)
    rows = [
        (None, None, None, None, None), (1, None, "en", "a", 0), (2, "", "en", "a", 0), (3, " \t\n\r\x0b ", "en", None, 5), (None, base, "en", "b", 1),
        (4, base, "en", "b", 1), (5, near, "en", "c", 1), (6, base + " tail", "de", None, 1), (7, "one", "en", "b", 3), (8, "a b c a b c a b c", "en", "b", 17),
        (9, "\n".join([prose(rng, 60)] * 3), "fr", "c", 9), (10, "é ü   ß x ퟿ 😀", "fr", "é", 9), (11, prose(rng, 30000), "en", "a", 1),
        (12, "#" * 40 + " $ % & | < > *", "en", "a", 1), (13, base, "en", "b", 1), (13, base, "en", "b", 1), (13, base, "en", "b", 1),
    ]
    rows += [(20 + i, prose(rng, rng.randrange(1, 200)), "en", rng.choice("abc"), 0) for i in range(60)]
    return [(*r, 1, "x", "y", "z") for r in rows]


def frame(spark, rows, schema=DOCS):
    return spark.createDataFrame(rows, schema)


def split_words(text: str | None) -> list[str]:
    return WORD.findall(text or "")
