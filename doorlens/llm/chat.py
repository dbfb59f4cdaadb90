"""Chat formatting: conversations as training windows under a token budget, with a loss mask.

Prefix sums of the turns' tokens place every turn on the conversation's token line; the line is cut
at multiples of the window's stride and a turn belongs to the window its first token falls in. A
window also repeats the leading system turn and those turns of the window before that start within
the last `history` tokens of it. Assistant turns carry loss only in the window they belong to.

Template: `### Role: text </turn>` and a line break. Inside roles and texts a backslash stands before every
control string and every backslash, so reading back gives the turns as they were.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doorlens.llm.common import word_count
from doorlens.operators.ordering import count_below

BUDGET = 2048
HISTORY = 256
#: Tokens of the marks around a turn.
MARK_TOKENS = 4
OPEN, COLON, CLOSE = "### ", ": ", " </turn>\n"
#: What an escape stands before: the escape itself, the marks, and in a role also its end.
IN_TEXT, IN_ROLE = r"(\\|###|</turn>)", r"(\\|###|</turn>|: )"
_ESCAPED = re.compile(r"\\(\\|###|</turn>|: )")
#: A turn's head. An escaped text never holds the closing mark, as "</turn>" there follows a backslash.
_HEAD = re.compile(r"### ((?:[^\\:]|\\\\|\\###|\\</turn>|\\: |:(?! ))*): ")
#: Turns that one run of a conversation's prefix sum covers.
_RUN = 4096


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def _escaped(text: Column, control: str) -> Column:
    return F.regexp_replace(text, control, r"\\$1")


def turns_in_order(conversations: DataFrame, conv_id: str, turn: str, role: str, text: str) -> DataFrame:
    """conv_id, role, text (null: empty), tokens, place: the order of turns within their conversation.

    Turns go by number, null last; rows of one number by role and text. Equal rows are
    told apart by nothing and keep their count.
    """
    role_text, body = F.coalesce(F.col(role), F.lit("")), F.coalesce(F.col(text), F.lit(""))
    place = F.struct(F.col(turn).isNull().alias("late"), F.col(turn).alias("turn"), role_text.alias("role"), body.alias("text"))
    return conversations.select(
        F.col(conv_id).alias("conv_id"), role_text.alias("role"), body.alias("text"),
        (word_count(body) + MARK_TOKENS).alias("tokens"), place.alias("place"),
        F.coalesce(F.floor(F.col(turn) / _RUN).cast("long"), F.lit((1 << 62))).alias("run"),
    )


def format_windows(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
                   budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """(conv_id, window, text, context, loss): the windows of every conversation.

    `text` is the formatted window, `context` says how many of its first turns only repeat earlier
    ones, `loss` has (start, end) code point spans of the assistant texts, as escaped, that are
    learned here. A window holds up to `budget` tokens (words and marks) besides the system turn and
    what its last turn runs over; no turn is cut, dropped or learned twice. Null texts and roles are
    empty, null conv_ids one conversation, repeated rows repeated turns; an empty table gives none.
    """
    stride = budget - history
    turns = turns_in_order(conversations, conv_id, turn, role, text)
    # A null conversation must survive equality joins: keys are structs of a flag and the value.
    keyed = turns.withColumn("key", F.struct(F.col("conv_id").isNull().alias("none"), F.coalesce("conv_id", F.lit(0).cast(turns.schema["conv_id"].dataType)).alias("id")))
    placed = count_below(keyed, ["key"], ["run", "place"], "tokens", "begin").drop("run", "place", "tokens")
    own = F.expr(f"begin div {stride}")
    repeated = F.expr(f"(begin + {history}) div {stride}")
    homes = F.when(repeated > own, F.array(F.struct(own.alias("window"), F.lit(True).alias("own")), F.struct(repeated.alias("window"), F.lit(False).alias("own"))))
    homes = homes.otherwise(F.array(F.struct(own.alias("window"), F.lit(True).alias("own"))))
    system = placed.filter((F.col("begin") == 0) & (F.col("role") == "system")).select("key", F.struct("begin", "role", "text").alias("system"))
    members = placed.select("key", "begin", "role", "text", F.explode(homes).alias("home"))
    windows = members.groupBy("key", F.col("home.window").alias("window")).agg(
        F.sort_array(F.collect_list(F.struct("begin", "role", "text", F.col("home.own").alias("own")))).alias("turns"),
    ).filter(F.exists("turns", lambda t: t["own"]))
    joined = windows.join(system, "key", "left")
    missing = F.col("system").isNotNull() & (F.get(F.col("turns"), F.lit(0))["begin"] > 0)
    head = F.struct(F.col("system.begin").alias("begin"), F.col("system.role").alias("role"), F.col("system.text").alias("text"), F.lit(False).alias("own"))
    whole = joined.select("key", "window", F.when(missing, F.concat(F.array(head), F.col("turns"))).otherwise(F.col("turns")).alias("turns"))
    pieces = F.transform("turns", lambda t: F.struct(
        F.concat(F.lit(OPEN), _escaped(t["role"], IN_ROLE), F.lit(COLON)).alias("head"), _escaped(t["text"], IN_TEXT).alias("body"),
        (t["own"] & (t["role"] == "assistant")).alias("learn")))
    cut = whole.select("key", "window", F.size(F.filter("turns", lambda t: ~t["own"])).alias("context"), pieces.alias("pieces"))
    spans = F.aggregate("pieces", F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans")), lambda s, p: F.struct(
        (s["at"] + F.char_length(p["head"]) + F.char_length(p["body"]) + len(CLOSE)).alias("at"),
        F.when(p["learn"], F.array_append(s["spans"], F.struct(
            (s["at"] + F.char_length(p["head"])).alias("start"),
            (s["at"] + F.char_length(p["head"]) + F.char_length(p["body"])).alias("end")))).otherwise(s["spans"]).alias("spans")))
    formatted = F.array_join(F.transform("pieces", lambda p: F.concat(p["head"], p["body"], F.lit(CLOSE))), "")
    return cut.select(F.expr("if(key.none, null, key.id)").alias("conv_id"), "window", formatted.alias("text"), "context", spans["spans"].alias("loss"))


def read_window(text: str) -> list[tuple[str, str]]:
    """The (role, text) turns of one formatted window."""
    out, at = [], 0
    while at < len(text):
        head = _HEAD.match(text, at)
        end = text.find(CLOSE, head.end()) if head else -1
        if end < 0:
            raise ValueError(f"no turn at {at}")
        out.append((unescape(head[1]), unescape(text[head.end():end])))
        at = end + len(CLOSE)
    return out


def read_back(windows: DataFrame) -> DataFrame:
    """Per conversation what its windows hold, read from their text and mask alone.

    conv_id, n_turns, turns_sha256 (role, line break, text, line break per turn), loss_chars,
    loss_sha256, formatted_chars. The windows of a conversation stream through one task in
    order; no more than one is held.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        current, started = None, False
        n = chars = formatted = 0
        turns, loss = hashlib.sha256(), hashlib.sha256()

        def row(kind):
            values = [current, n, turns.hexdigest(), chars, loss.hexdigest(), formatted]
            kinds = [kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], names=names)

        kind = pa.int64()
        for batch in batches:
            kind = batch.schema.field(0).type
            for conv_id, text, context, spans in zip(*[batch.column(i) for i in range(4)]):
                key = conv_id.as_py()
                if not started or key != current:
                    if started:
                        yield row(kind)
                    current, started = key, True
                    n = chars = formatted = 0
                    turns, loss = hashlib.sha256(), hashlib.sha256()
                text = text.as_py()
                formatted += len(text)
                for role, body in read_window(text)[context.as_py():]:
                    turns.update(f"{role}\n{body}\n".encode("utf-8", "surrogatepass"))
                    n += 1
                for span in spans.as_py():
                    learned = unescape(text[span["start"]:span["end"]])
                    chars += len(learned)
                    loss.update(learned.encode("utf-8", "surrogatepass"))
        if started:
            yield row(kind)

    kind = windows.schema["conv_id"].dataType.simpleString()
    ordered = windows.repartition("conv_id").sortWithinPartitions("conv_id", "window").select("conv_id", "text", "context", "loss")
    return ordered.mapInArrow(work, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
