"""Sets of landed files that may be incomplete: what was expected, what is there, what could be read.

A file that is absent or broken costs its own rows and one row of the ledger, never the others. An entry is a file, or a
folder of part files under the name a file would have (with or without a `key=` in front, as partitioned writes leave it).
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from doorlens.sources import readers

MISSING = "no such file"
UNREADABLE = "nothing readable in it"


def entry_name(path: Column) -> Column:
    """The entry a file path belongs to."""
    parts = F.split(path, "/")
    own, above = F.element_at(parts, -1), F.element_at(parts, -2)
    return F.regexp_replace(F.url_decode(F.when(own.startswith("part-"), above).otherwise(own)), "^[^=]+=", "")


def expected(spark: SparkSession, names: Sequence[tuple[str, str]]) -> DataFrame:
    """(name, key) of the entries a job asks for; a handful, as the caller lists them."""
    return spark.createDataFrame(list(names), "name string, key string")


def listed(spark: SparkSession, root: str) -> DataFrame:
    """(name, bytes) of every entry below `root`; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length")
    return files.withColumn("name", entry_name(F.col("path"))).groupBy("name").agg(F.sum("length").alias("bytes"))


def ledger(wanted: DataFrame, found: DataFrame, rows: DataFrame, faults: DataFrame | None = None) -> DataFrame:
    """(name, key, bytes, rows, reason) per expected entry; reason is null where it was read.

    `rows` holds (name, rows) of what was read, `faults` (name, reason) of what readers rejected as a whole.
    """
    joined = wanted.join(found, "name", "left").join(rows, "name", "left")
    joined = joined.join(faults.groupBy("name").agg(F.min("reason").alias("fault")), "name", "left") if faults is not None else joined.withColumn(
        "fault", F.lit(None).cast("string"))
    reason = F.when(F.col("bytes").isNull(), MISSING).when(F.col("fault").isNotNull(), F.col("fault")).when(F.coalesce("rows", F.lit(0)) == 0, UNREADABLE)
    return joined.select("name", "key", "bytes", F.coalesce("rows", F.lit(0)).alias("rows"), reason.alias("reason"))


def sales_entries(as_of: dt.date, window_days: int) -> list[tuple[str, str]]:
    """(name, year) of the yearly files a window touches."""
    return [(path.rsplit("/", 1)[1], str(year)) for year, path in readers.sales_paths("", as_of, window_days)]


def read_sales_files(spark: SparkSession, root: str, names: Sequence[tuple[str, str]], muns=None) -> tuple[DataFrame, DataFrame]:
    """(sales with the `entry` they came from, ledger) of yearly fixed-width files below `root`.

    The names reach the scan: files of other years are not opened. A file without a line of the right width is broken.
    """
    lines = (
        spark.read.schema("line string").option("encoding", "ISO-8859-1").option("sep", "\u0001").option("quote", "")
        .option("lineSep", "\n").option("recursiveFileLookup", "true").csv(root)
        .select("line", entry_name(F.col("_metadata.file_path")).alias("entry"))
    ).filter(F.col("entry").isin(*[name for name, _ in names]))
    sales = readers.distil_sales(lines)
    # Counted before the towns are chosen: a sound file may hold nothing of theirs.
    counts = lines.filter(F.octet_length(F.encode(F.rtrim("line", F.lit("\r\n")), "ISO-8859-1")) == readers.SALES_WIDTH).groupBy(
        F.col("entry").alias("name")).agg(F.count(F.lit(1)).alias("rows"))
    kept = sales if muns is None else sales.filter(F.col("mun").isin(*muns))
    return kept, ledger(expected(spark, names), listed(spark, root), counts)


def read_permit_pages(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(permits, (source, reason) of pages that are no JSON) of landed permit pages."""
    return readers.read_permits(spark, path, strict=False), readers.file_faults(spark, path)
