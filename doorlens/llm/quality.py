"""Quality rules, on DataFrame functions alone: text measures, and line frequency across documents.

A line that stands in many different documents of one host is that host's furniture, however long
it is. Lines are normalised and hashed, the distinct documents holding each are counted per host,
lines above the host's limit are taken out, and a document of which too little is left is rejected.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doorlens.llm.common import ROW, WHITE, WHITE_RUN, field, key_pair, let, packed, source_key, unpacked, words

SYMBOLS = "[#*$%&|<>]"


@dataclass(frozen=True)
class Limits:
    """A line is furniture above max(min_documents, share of its host's documents)."""

    min_documents: int = 10
    share: float = 0.002
    #: A document is depleted with fewer words left, or a smaller part of its words.
    min_words_left: int = 25
    min_part_left: float = 0.5


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def _normal(line: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(line), WHITE_RUN, " "), F.lit(" "))


def _repeated(w: Column) -> Column:
    """Words inside 3-word windows that occur twice or more, the first occurrence included."""

    def count(hashes: Column) -> Column:
        twice = let(F.sort_array(hashes), lambda s: F.exists(
            F.transform(s, lambda x, k: x == F.get(s, k + 1)), lambda x: F.coalesce(x, F.lit(False))))
        placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def covered(s: Column) -> Column:
            same = F.filter(s, lambda x, k: (F.coalesce(x["h"] == F.get(s, k - 1)["h"], F.lit(False)))
                            | (F.coalesce(x["h"] == F.get(s, k + 1)["h"], F.lit(False))))
            return let(
                F.sort_array(F.transform(same, lambda x: x["i"])),
                lambda p: F.aggregate(
                    F.transform(p, lambda at, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - at, F.lit(3)))),
                    F.lit(0), lambda total, x: total + x),
            )

        return F.when(~twice, F.lit(0)).otherwise(let(placed, covered))

    windows = F.transform(w, lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)))
    return F.when(F.size(w) < 4, F.lit(0)).otherwise(let(F.slice(windows, F.lit(1), F.size(w) - 2), count))


def measures(text: Column) -> Column:
    """A struct of n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of a whole text."""
    written = F.coalesce(text, F.lit(""))
    with_word = F.filter(_lines(text), lambda line: F.btrim(line, F.lit(WHITE)) != "")
    return let(words(text), lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"),
        F.char_length(F.array_join(w, "")).cast("long").alias("word_chars"),
        (F.char_length(written) - F.char_length(F.regexp_replace(written, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        let(with_word, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        _repeated(w).cast("long").alias("n_repeat_words"),
    ))


def base_failed(measure: Column) -> Column:
    return (measure["n_words"] < 50) | (100 * measure["n_repeat_words"] > 50 * measure["n_words"])


def _identity(text: Column, host: Column) -> list[Column]:
    one, two = key_pair(text)
    return [source_key(host).alias("host"), one.alias("k1"), two.alias("k2")]


def frequent_lines(docs: DataFrame, text: str, host: str, limits: Limits) -> tuple[DataFrame, DataFrame]:
    """Every line of every document, and the (host, line) above their host's limit.

    A document is its text: exact copies on one host count once.
    """
    identity = docs.select(*_identity(F.col(text), F.col(host)), F.col(text).alias("text"))
    line = identity.select("host", "k1", "k2", F.explode(_lines(F.col("text"))).alias("line"))
    line = line.select("host", "k1", "k2", _normal(F.col("line")).alias("line")).filter("line != ''")
    line = line.select(
        "host", "k1", "k2", F.xxhash64("line").alias("line"),
        (F.char_length("line") - F.char_length(F.replace("line", F.lit(" "), F.lit(""))) + 1).alias("n"),
    )
    size = identity.groupBy("host").agg(F.count_distinct("k1").alias("documents"))
    held = line.groupBy("host", "line").agg(F.count_distinct("k1").alias("holders")).filter(
        F.col("holders") > limits.min_documents)
    above = held.join(size, "host").filter(F.col("holders") > limits.share * F.col("documents")).select("host", "line")
    return line, above


def line_verdicts(docs: DataFrame, text: str, host: str, limits: Limits) -> DataFrame:
    """Per distinct (host, text) that holds a frequent line: words and lines to go, and those lines' hashes."""
    line, above = frequent_lines(docs, text, host, limits)
    # Copies of one text would repeat its lines: each (text, line) is counted once, times how often the text holds it.
    hit = line.join(above, ["host", "line"])
    copies = docs.select(*_identity(F.col(text), F.col(host))).groupBy("host", "k1", "k2").agg(F.count(F.lit(1)).alias("copies"))
    per = hit.groupBy("host", "k1", "k2", "line").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("times"))
    per = per.groupBy("host", "k1", "k2").agg(
        F.sum("n").alias("n"), F.sum("times").alias("times"), F.collect_list("line").alias("gone"))
    return per.join(copies, ["host", "k1", "k2"]).select(
        "host", "k1", "k2", "gone", (F.col("n") / F.col("copies")).cast("long").alias("gone_words"),
        (F.col("times") / F.col("copies")).cast("long").alias("gone_lines"))


def _depleted(n_words: Column, gone_words: Column, limits: Limits) -> Column:
    left = n_words - F.coalesce(gone_words, F.lit(0))
    return (left < limits.min_words_left) | (left < limits.min_part_left * n_words)


def quality_report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source",
                   limits: Limits = Limits()) -> DataFrame:
    """One row per document: measures, base_failed, kept, gone_lines, gone_words.

    A null or blank text has no words, so base_failed holds; null hosts are one host of their own;
    a repeated row comes out as often as it came in and counts once towards a line's documents;
    an empty table gives no rows. The measures cover the whole text however long it is.
    """
    measured = docs.select(F.col(doc_id).alias("doc_id"), *_identity(F.col(text), F.col(host)), measures(F.col(text)).alias("m"))
    gone = line_verdicts(docs, text, host, limits).drop("gone")
    failed = base_failed(F.col("m"))
    return measured.join(gone, ["host", "k1", "k2"], "left").select(
        "doc_id", "m.*", failed.alias("base_failed"),
        (~failed & ~_depleted(F.col("m.n_words"), F.col("gone_words"), limits)).alias("kept"),
        F.coalesce("gone_lines", F.lit(0)).alias("gone_lines"), F.coalesce("gone_words", F.lit(0)).alias("gone_words"),
    )


def apply_quality_rules(docs: DataFrame, text: str = "text", host: str = "source", limits: Limits = Limits()) -> DataFrame:
    """The documents that pass, without their frequent lines; all columns stay.

    A text that loses no line is left as it is. Column `n_chars`, if there, follows the text.
    """
    columns = docs.columns
    # The running number keeps the filter above this projection: below it, the measures would be worked out twice.
    keyed = packed(docs).select(
        ROW, *_identity(field(text), field(host)), measures(field(text)).alias("m"), F.monotonically_increasing_id().alias("number"))
    keyed = keyed.filter(~base_failed(F.col("m")) & (F.col("number") >= 0)).select(ROW, "host", "k1", "k2", F.col("m.n_words").alias("n_words"))
    gone = line_verdicts(docs, text, host, limits)
    kept = keyed.join(gone, ["host", "k1", "k2"], "left").filter(~_depleted(F.col("n_words"), F.col("gone_words"), limits))
    stays = lambda line: ~F.array_contains(F.col("gone"), F.xxhash64(_normal(line)))
    cleaned = F.when(F.col("gone").isNull(), field(text)).otherwise(F.array_join(F.filter(_lines(field(text)), stays), "\n"))
    final = kept.select(ROW, cleaned.alias("cleaned"))
    replaced = {text: F.col("cleaned")}
    if "n_chars" in columns:
        replaced["n_chars"] = F.char_length("cleaned").cast(docs.schema["n_chars"].dataType)
    return unpacked(final, columns, **replaced)
