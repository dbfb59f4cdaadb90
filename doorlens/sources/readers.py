"""Readers of landed public-record files.

Every reader names its columns. A field that is not named has nowhere to land, which is
both the column pruning and the privacy rule: owner and mailing fields are never read.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from doorlens.functions import dates, geo, text

# The fields asked of the parcel service, and the sales file layout (start, end).
PARCEL_FIELDS = (
    "OBJECTID", "PAMS_PIN", "PCL_MUN", "PCLBLOCK", "PCLLOT", "PCLQCODE", "PROP_CLASS", "PROP_LOC", "ZIP5", "LAND_VAL",
    "IMPRVT_VAL", "NET_VALUE", "LAST_YR_TX", "BLDG_DESC", "CALC_ACRE", "DEED_BOOK", "DEED_PAGE", "DEED_DATE",
    "YR_CONSTR", "SALES_CODE", "SALE_PRICE", "DWELL",
)
SALES_WIDTH = 663
SALES_SLICES = {
    "county": (0, 2), "district": (2, 4), "nu_code": (34, 37), "reported_price": (37, 46), "verified_price": (46, 55),
    "prop_loc": (297, 322), "deed_book": (328, 333), "deed_page": (333, 338), "deed_date": (338, 344),
    "date_recorded": (344, 350), "block": (350, 355), "block_suffix": (355, 359), "lot": (359, 364),
    "lot_suffix": (364, 368), "qualifier": (619, 624), "prop_class": (626, 629), "year_built": (652, 656),
}
BOUNDARY_FIELDS = ("GEOID", "STATE", "COUNTY", "TRACT", "BLKGRP")
ACS_SENTINEL = -1_000_000.0
PRIVATE_KEYS = ("owner", "mailing", "mailing_address", "agent", "permit_agent")

_GEOMETRY = "struct<type:string,coordinates:string>"


def empty(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)


def optional_source(spark: SparkSession, df: DataFrame | None, schema: str, source: str, reason: str):
    """(rows, degradations): a source that is not there becomes an empty table and one reason."""
    degraded = "source string, reason string"
    if df is not None:
        return df, empty(spark, degraded)
    return empty(spark, schema), spark.createDataFrame([(source, reason)], degraded)


def required_source(df: DataFrame | None, source: str) -> DataFrame:
    if df is None:
        raise ValueError(f"{source} is mandatory")
    return df


def union_pages(pages: DataFrame, key: str = "OBJECTID", order: tuple[str, ...] = ("page", "ordinal")) -> DataFrame:
    """All pages as one table: of rows that repeat a key the first by `order` stays, rows without a key all stay."""
    at = F.struct(*[F.col(c) for c in order])
    rest = [c for c in pages.columns if c != key]
    # A row without a key is told apart by its place instead.
    marked = pages.withColumn("_place", F.when(F.col(key).isNull(), at))
    kept = marked.groupBy(key, "_place").agg(F.min_by(F.struct(*rest), at).alias("_row"))
    return kept.select(key, "_row.*").select(*pages.columns)


def multi_polygon(geometry):
    """GeoJSON polygon or multi-polygon coordinates (JSON text) as one nested array type."""
    many = "array<array<array<array<double>>>>"
    return F.when(geometry["type"] == "MultiPolygon", F.from_json(geometry["coordinates"], many)).when(
        geometry["type"] == "Polygon", F.array(F.from_json(geometry["coordinates"], "array<array<array<double>>>"))
    )


def read_json(spark: SparkSession, path: str, schema: str, strict: bool = True) -> DataFrame:
    """JSON files with their name as `page`. A file that is no JSON stops the job, or is left to `file_faults`."""
    reader = spark.read.schema(f"{schema}, _broken string").option("multiLine", True)
    if strict:
        reader = reader.option("mode", "FAILFAST")
    rows = reader.option("columnNameOfCorruptRecord", "_broken").json(path).withColumn("page", F.col("_metadata.file_path"))
    return rows.filter("_broken is null").drop("_broken")


def file_faults(spark: SparkSession, path: str) -> DataFrame:
    """(source, reason): one row per JSON file that cannot be read as such."""
    raw = spark.read.schema("_any string, _broken string").option("multiLine", True).option(
        "columnNameOfCorruptRecord", "_broken").json(path).withColumn("source", F.col("_metadata.file_name"))
    return raw.filter("_broken is not null and _any is null").select("source", F.lit("malformed file").alias("reason")).distinct()


def _features(spark: SparkSession, path: str, fields, strict: bool = True) -> DataFrame:
    properties = ",".join(f"`{name}`:string" for name in fields)
    schema = f"features array<struct<properties:struct<{properties}>,geometry:{_GEOMETRY}>>"
    return read_json(spark, path, schema, strict).select("page", F.posexplode("features").alias("ordinal", "f")).select(
        "page", "ordinal", "f.properties.*", F.col("f.geometry").alias("geometry")
    )


def distil_parcels(raw: DataFrame) -> DataFrame:
    """Service columns (text) to the parcel model: blank text, zero numbers, NULL deed date."""
    def word(name):
        return text.text_or_blank(F.col(name))

    def number(name):
        return text.number_or_zero(F.col(name))

    return raw.select(
        word("PAMS_PIN").alias("pams_pin"), word("PCL_MUN").alias("mun"), word("PROP_CLASS").alias("prop_class"),
        word("PROP_LOC").alias("prop_loc"), word("ZIP5").alias("zip5"), word("PCLBLOCK").alias("block"),
        word("PCLLOT").alias("lot"), dates.strip(word("PCLQCODE")).alias("qualifier"),
        text.blank_to_null(dates.strip(word("DEED_DATE"))).alias("deed_date"), number("SALE_PRICE").alias("sale_price"),
        word("SALES_CODE").alias("sales_code"), number("YR_CONSTR").cast("int").alias("yr_constr"),
        number("NET_VALUE").alias("net_value"), number("CALC_ACRE").alias("calc_acre"),
        *[F.col(c) for c in ("geometry",) if c in raw.columns],
    )


def read_parcels(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """All pages' parcels. A broken page stops the job; without `strict` it is left out and named by `file_faults`."""
    parcels = distil_parcels(union_pages(_features(spark, path, PARCEL_FIELDS, strict)))
    parcels = parcels.withColumn("polygon", multi_polygon(F.col("geometry"))).drop("geometry")
    centre = geo.area_centroid(F.col("polygon"))
    return parcels.withColumn("_c", centre).withColumn("lon", F.col("_c.lon")).withColumn("lat", F.col("_c.lat")).drop("_c")


def distil_permits(raw: DataFrame) -> DataFrame:
    """Permit feed columns (text) to the permit model. The contractor is never read."""
    kind = F.coalesce(
        text.blank_to_null(dates.strip(F.col("permittypedesc"))), dates.strip(text.text_or_blank(F.col("permittype")))
    )
    return raw.select(
        text.text_or_blank(F.col("recordid")).alias("record_id"), text.text_or_blank(F.col("block")).alias("block"),
        text.text_or_blank(F.col("lot")).alias("lot"), kind.alias("type"),
        dates.iso_date(dates.strip(F.col("permitdate"))).alias("permit_date"),
        text.number_or_zero(dates.strip(F.col("constcost"))).alias("cost"),
    )


def read_permits(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    schema = "recordid string, block string, lot string, permitdate string, permittypedesc string, permittype string, constcost string"
    return distil_permits(read_json(spark, path, schema, strict))


def distil_sales(lines: DataFrame, muns=None) -> DataFrame:
    """Fixed-width lines to sales. A line of another width is dropped before any slice is cut.

    `muns` keeps only those towns; each is the county and the district number together.
    """
    # One byte a character: slices then cost their own length, not a scan from the line's start.
    raw = F.encode(F.rtrim("line", F.lit("\r\n")), "ISO-8859-1")
    kept = lines.withColumn("line", raw).filter(F.length("line") == SALES_WIDTH)

    def cut(name):
        start, end = SALES_SLICES[name]
        piece = F.substring("line", start + 1, end - start)
        return dates.strip(F.decode(piece, "ISO-8859-1") if name == "prop_loc" else piece.cast("string"))

    mun = F.concat(cut("county"), cut("district"))
    if muns is not None:
        kept = kept.filter(mun.isin(*muns))

    def part(base, suffix):
        value, tail = cut(base), cut(suffix)
        bare = F.regexp_replace(value, "^0+(?=.)", "")
        return F.when(tail != "", F.concat_ws(".", bare, tail)).otherwise(bare)

    def price(name):
        digits = F.ltrim(cut(name), F.lit("0"))
        return F.when(digits.rlike(r"^\d+$"), digits.try_cast("double"))

    year = cut("year_built")
    extra = [c for c in lines.columns if c != "line"]
    return kept.select(
        *extra, mun.alias("mun"), part("block", "block_suffix").alias("block"), part("lot", "lot_suffix").alias("lot"),
        cut("qualifier").alias("qualifier"), cut("prop_loc").alias("prop_loc"), cut("deed_date").alias("deed_date"),
        cut("date_recorded").alias("date_recorded"),
        F.coalesce(price("verified_price"), price("reported_price"), F.lit(0.0)).alias("sale_price"),
        cut("nu_code").alias("nu_code"), cut("prop_class").alias("prop_class"),
        F.when(year.rlike(r"^\d+$"), year.try_cast("int")).otherwise(0).alias("year_built"),
    )


def sales_years(as_of: dt.date, window_days: int) -> list[int]:
    """The yearly files a window touches, newest first."""
    return sorted({as_of.year, (as_of - dt.timedelta(days=window_days)).year}, reverse=True)


def sales_paths(root: str, as_of: dt.date, window_days: int) -> list[tuple[int, str]]:
    """The current year's to-date file and the annual file of an earlier year."""
    return [
        (year, f"{root}/{year}{'-ytd' if year == as_of.year else ''}.txt") for year in sales_years(as_of, window_days)
    ]


def read_sales(spark: SparkSession, paths, muns=None) -> DataFrame:
    """Landed, unzipped yearly text files (latin-1), split by line."""
    lines = (
        spark.read.schema("line string").option("encoding", "ISO-8859-1").option("sep", "\u0001").option("quote", "")
        .option("lineSep", "\n").csv(list(paths))
    )
    return distil_sales(lines, muns)


def acs_estimate(cell):
    """One census cell as a number; blanks, words and the large negative sentinels are NULL."""
    value = dates.strip(cell).try_cast("double")
    return F.when(value > ACS_SENTINEL, value)


def dual_income(denominator, *parts):
    total = acs_estimate(parts[0])
    for part in parts[1:]:
        total = total + acs_estimate(part)
    base = acs_estimate(denominator)
    return F.when(base > 0, total / base)


def read_acs(spark: SparkSession, path: str) -> DataFrame:
    """The census table: first row names the columns, rows are zipped to it, the last duplicate wins."""
    table = spark.read.text(path, wholetext=True).select(
        F.from_json("value", T.ArrayType(T.ArrayType(T.StringType()))).alias("rows")
    )
    cells = table.select(F.col("rows")[0].alias("header"), F.posexplode("rows").alias("ordinal", "row"))
    named = cells.filter((F.col("ordinal") > 0) & (F.size("row") == F.size("header"))).select(
        "ordinal", F.map_from_arrays("header", "row").alias("m")
    )

    def cell(name):
        return F.try_element_at("m", F.lit(name))

    rows = named.select(
        F.concat(cell("state"), cell("county"), cell("tract"), cell("block group")).alias("geoid"), "ordinal",
        dual_income(cell("B23007_001E"), *[cell(f"B23007_{n}E") for n in ("004", "015", "026")]).alias("dual_income_pct"),
        acs_estimate(cell("B19013_001E")).alias("median_hh_income"),
    ).filter("geoid is not null")
    return rows.groupBy("geoid").agg(
        F.max_by(F.struct("dual_income_pct", "median_hh_income"), "ordinal").alias("r")
    ).select("geoid", "r.*")


def read_boundaries(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """Block-group polygons in service order; no id or no usable ring drops the feature."""
    rows = _features(spark, path, BOUNDARY_FIELDS, strict).filter("GEOID is not null and GEOID != ''")
    polygon = multi_polygon(F.col("geometry"))
    return rows.select(
        F.col("GEOID").alias("geoid"), F.struct("page", "ordinal").alias("ordinal"), polygon.alias("polygon")
    ).filter(F.exists(F.coalesce(F.flatten("polygon"), F.array()), lambda ring: F.size(ring) >= 4))


_PERMIT = "permit_number:string,control_number:string,work_type:string,work_description:string,status:string," \
          "issue_date:string,close_date:string,total_cost:string,detail_url:string,subcodes:string," \
          "certificates:string"
_PROPERTY = (
    "pams_pin:string,collection_status:string,location:struct<block:string,lot:string>,source_page:struct<url:string>,"
    "property_details:struct<last_sale_date:string,last_sale_price:string>,assessed_valuation:struct<total:string>,"
    f"construction:struct<permit_applications:array<struct<{_PERMIT}>>,inspections:array<string>,"
    "violations:array<string>>"
)


def read_portal_history(spark: SparkSession, path: str | None) -> DataFrame | None:
    """Portal property pages; None when no snapshot was collected, which means unknown for every door."""
    if path is None:
        return None
    pages = read_json(spark, path, f"properties array<struct<{_PROPERTY}>>")
    return pages.select(F.posexplode("properties").alias("ordinal", "p")).select("ordinal", "p.*")


def portal_applications(pages: DataFrame) -> DataFrame:
    """One row per permit application of a collected page, in page order."""
    extra = [c for c in ("territory_id",) if c in pages.columns]
    return pages.filter("collection_status = 'collected'").select(
        *extra, "pams_pin", F.posexplode("construction.permit_applications").alias("ordinal", "a")
    ).select(*extra, "pams_pin", "ordinal", "a.*")


def with_page_state(doors: DataFrame, pages: DataFrame | None) -> DataFrame:
    """Adds `sdl_page_available`: true for all without a snapshot, else whether the page was collected."""
    if pages is None:
        return doors.withColumn("sdl_page_available", F.lit(True))
    collected = pages.filter("collection_status = 'collected'").select("pams_pin").distinct().withColumn(
        "sdl_page_available", F.lit(True)
    )
    return doors.join(collected, "pams_pin", "left").withColumn(
        "sdl_page_available", F.coalesce("sdl_page_available", F.lit(False))
    )


def read_roof_permits(spark: SparkSession, path: str) -> DataFrame:
    record = f"{_PERMIT},detail_page:struct<comments:string,description:string>"
    pages = read_json(spark, path, f"properties array<struct<pams_pin:string,block:string,lot:string,permits:array<struct<{record}>>>>")
    rows = pages.select(F.explode("properties").alias("p")).select(
        "p.pams_pin", F.posexplode("p.permits").alias("ordinal", "r")
    )
    described = F.coalesce(
        text.blank_to_null(dates.strip(F.col("r.work_description"))),
        text.blank_to_null(dates.strip(F.col("r.detail_page.comments"))),
    )
    number = F.coalesce(text.blank_to_null(F.col("r.permit_number")), text.blank_to_null(F.col("r.control_number")))
    return rows.select(
        "pams_pin", "ordinal", number.alias("municipal_id"), described.alias("description"),
        F.col("r.work_type").alias("work_type"), text.portal_disposition(F.col("r.status")).alias("disposition"),
        dates.us_date(F.col("r.issue_date")).alias("issue_date"), F.col("r.detail_url").alias("detail_url"),
    ).filter("municipal_id is not null")


def label_reason():
    """Why a label row cannot count; NULL when it can."""
    return (
        F.when(F.col("actual").isNull() | F.col("predicted").isNull() | F.col("probe").isNull(), "flag is not a boolean")
        .when(F.col("probe") & F.col("actual"), "a probe row cannot be actual")
    )


def read_labels(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(labels, rejects). A row whose flags are no booleans, or whose probe is marked real, names its file."""
    raw = spark.read.option("multiLine", True).schema(
        "pams_pin string, image_ref string, signal string, actual string, predicted string, probe string, _broken string"
    ).option("columnNameOfCorruptRecord", "_broken").json(path).withColumn("file", F.col("_metadata.file_name"))

    def truth(name):
        return F.when(F.col(name) == "true", True).when(F.col(name) == "false", False)

    rows = raw.select(
        "pams_pin", "image_ref", "signal", truth("actual").alias("actual"), truth("predicted").alias("predicted"),
        F.when(F.col("probe").isNull(), False).otherwise(truth("probe")).alias("probe"), "file", "_broken",
    )
    checked = rows.withColumn("reason", F.when(F.col("_broken").isNotNull(), "malformed file").otherwise(label_reason()))
    return checked.filter("reason is null").drop("reason", "_broken", "file"), checked.filter("reason is not null").select(
        "file", "reason"
    )


def stale_versions(published: DataFrame, current: str = "v2") -> DataFrame:
    """The contract versions in a published table other than the current one."""
    return published.select("score_contract_version").distinct().filter(
        ~F.col("score_contract_version").eqNullSafe(current)
    )


def read_published(spark: SparkSession, doors_path: str, evidence_path: str, current: str = "v2"):
    """(doors, evidence): both must be there, and every row of the current contract version."""
    doors, evidence = spark.read.parquet(doors_path), spark.read.parquet(evidence_path)
    if not stale_versions(doors, current).isEmpty():
        raise ValueError(f"published rows of another score contract than {current}")
    return doors, evidence
