"""Windows read back against the conversations themselves."""

import collections
import hashlib
import random

import pytest

from doorlens.llm import chat
from tests.llm.fixtures import frame, prose

SCHEMA = "conv_id long, turn long, role string, text string, window long, key string"
HOSTILE = ["\\### Assistant: </turn> ok", "### user: x </turn>\n", "\\", "\\\\###", "</turn>", ": ", " \\</turn> \n\n", "a: b", "###", "\\\\</turn>\\", ""]


def conversations():
    rng = random.Random(2)
    rows = []
    for c in range(30):
        if c % 3 == 0:
            rows.append((c, 0, "system", rng.choice(HOSTILE) + prose(rng, 5)))
        for t in range(1, rng.choice([2, 5, 60])):
            rows.append((c, t, "user" if t % 2 else "assistant", rng.choice(HOSTILE) * rng.randrange(2) + prose(rng, rng.choice([0, 3, 30]))))
    rows += [(50, t, "assistant", h) for t, h in enumerate(HOSTILE)] + [(51, 0, r, "x") for r in ["a: b", ":", "\\", "### ", " </turn>\n", "", "a\nb", "x: "]]
    rows += [(None, 0, "user", "q"), (None, 1, "assistant", "r"), (60, None, "assistant", "late"), (60, 5, None, None), (60, 5, "assistant", None), (60, -3, "user", "first")]
    rows += [(70, 1, "assistant", "same")] * 5 + [(71, 0, "assistant", prose(rng, 5000)), (71, 1, "user", "after"), (71, 2, "assistant", "end")]
    rows += [(72, 0, "user", "late system"), (72, 1, "system", "not leading"), (72, 2, "assistant", "ok")]
    return [(*r, 1, "k") for r in rows]


def expected(rows):
    by = collections.defaultdict(list)
    for r in rows:
        by[r[0]].append(r)
    out = []
    for c, turns in by.items():
        turns.sort(key=lambda r: (r[1] is None, r[1] or 0, r[2] or "", r[3] or ""))
        said = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in turns)
        learned = "".join(r[3] or "" for r in turns if r[2] == "assistant")
        out.append((c, len(turns), hashlib.sha256(said.encode()).hexdigest(), len(learned), hashlib.sha256(learned.encode()).hexdigest()))
    return out


@pytest.mark.parametrize("budget, history", [(2048, 256), (40, 15), (10, 0)])
def test_read_back(spark, budget, history):
    rows = conversations()
    windows = chat.format_windows(frame(spark, rows, SCHEMA), budget=budget, history=history)
    got = chat.read_back(windows).collect()
    order = lambda t: tuple((x is None, x or 0) for x in t)
    assert sorted((tuple(r)[:5] for r in got), key=order) == sorted(expected(rows), key=order)
    assert sum(r.formatted_chars for r in got) == sum(len(w.text) for w in windows.collect())


def test_windows_keep_system_and_limited_history(spark):
    rows = conversations()
    system = {r[0]: (r[2], r[3]) for r in rows if r[1] == 0 and r[2] == "system"}
    seen = 0
    for w in chat.format_windows(frame(spark, rows, SCHEMA), budget=60, history=20).collect():
        turns = chat.read_window(w.text)
        if w.conv_id in system:
            assert turns[0] == system[w.conv_id]
        repeated = turns[:w.context][w.conv_id in system:]
        sizes = [len(t.split()) + chat.MARK_TOKENS for _, t in repeated]
        assert sum(sizes[:-1]) < 20
        assert len(turns) > w.context
        seen += bool(repeated)
        edge = sum(len(f"### {r}: {t} </turn>\n") for r, t in turns[:w.context])
        assert all(s.start >= edge for s in w.loss)
    assert seen > 10


def test_empty_table(spark):
    assert chat.read_back(chat.format_windows(frame(spark, [], SCHEMA))).count() == 0
