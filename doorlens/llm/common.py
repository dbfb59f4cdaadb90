"""Helpers shared by the operators: words, packed rows, bindings inside column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WHITE = " \t\n\x0b\x0c\r"
#: Runs of ASCII white space as a Java pattern; a word is what lies between.
WHITE_RUN = "[ \\t-\\r]+"
ROW = "_row"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body(value)` with `value` worked out once, however often `body` names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    """The words of a text in order; none for a null or blank text."""
    return let(
        F.btrim(F.coalesce(text, F.lit("")), F.lit(WHITE)),
        lambda t: F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, WHITE_RUN)),
    )


def word_count(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def packed(df: DataFrame) -> DataFrame:
    """The whole row as one struct column, so no helper column can clash with a caller's name."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(ROW))


def unpacked(df: DataFrame, columns: list[str], **replaced: Column) -> DataFrame:
    """The caller's columns again, some of them replaced."""
    return df.select(*[replaced.get(c, F.col(ROW).getField(c)).alias(c) for c in columns])


def field(name: str) -> Column:
    return F.col(ROW).getField(name)


def key_pair(*columns: Column) -> tuple[Column, Column]:
    """Two hashes that together identify equal values; where a null stands counts."""
    marked = [*columns, *[c.isNull() for c in columns]]
    return F.xxhash64(*marked), F.xxhash64(F.lit(1), *marked)


def row_key(df: DataFrame) -> tuple[Column, Column]:
    """`key_pair` of a whole packed row. Kinds that have no hash, maps and variants at any depth, count by their JSON."""
    plain = lambda kind: "map<" not in kind and "variant" not in kind
    json = lambda name: F.to_json(F.struct(field(name)), {"ignoreNullFields": "false"})
    return key_pair(*[field(f.name) if plain(f.dataType.simpleString()) else json(f.name) for f in df.schema.fields])


def source_key(source: Column) -> Column:
    """A key without nulls that sorts as the sources do: by code point, null last."""
    return F.coalesce(F.concat(F.lit("0"), source.cast("string")), F.lit("1"))
