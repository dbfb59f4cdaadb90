"""Property histories: portal pages, permit matching by address, enrichment and integrity checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from doorlens.functions import dates, keys, text
from doorlens.operators.ordering import count_below
from doorlens.sources.readers import PRIVATE_KEYS

# Fixed values.
KEYWORD_EXPLICIT = "explicit_roof_work"
KEYWORD_ONLY = "portal_keyword_only"
REASON_AMBIGUOUS = "normalized address identifies multiple territory parcels"
REASON_UNKNOWN = "normalized address is not a territory situs address"
SUPPLEMENT = "roof_keyword_search_supplement"
PAGE_BLOCKS = ("source_page", "location", "property_details", "geoareas", "assessed_valuation", "map", "property_data")


def path_identity(url: Column) -> Column:
    """Block and lot out of a page address: exactly the two segments after the last `properties`."""
    path = F.try_parse_url(url, F.lit("PATH"))
    # A plus sign stands for itself in a path.
    parts = F.transform(
        F.filter(F.split(path, "/"), lambda p: p != ""), lambda p: F.try_url_decode(F.replace(p, F.lit("+"), F.lit("%2B")))
    )
    after = F.size(parts) - F.array_position(F.reverse(parts), "properties") + 1
    fits = (F.array_position(F.reverse(parts), "properties") > 0) & (after + 2 == F.size(parts))
    return F.when(
        fits, F.struct(F.get(parts, F.size(parts) - 2).alias("block"), F.get(parts, F.size(parts) - 1).alias("lot"))
    )


# --- permit lists by exact situs address ----------------------------------------------------


def _place(df: DataFrame, towns: DataFrame | None) -> tuple[DataFrame, list]:
    """`df` with its territory's town, state and zip, and the columns that hold them."""
    if towns is None:
        return df, []
    named = towns.select("territory_id", *[F.col(c).alias(f"_{c}") for c in ("town", "state", "zip")])
    return df.join(named, "territory_id", "left"), [F.col(f"_{c}") for c in ("town", "state", "zip")]


def _known_addresses(territory: DataFrame, address: str) -> DataFrame:
    """(territory_id, address_key, doors, pin): how many doors an address names, and the first of them."""
    written = territory.groupBy("territory_id", address).agg(F.count(F.lit(1)).alias("_doors"), F.min("pams_pin").alias("_pin"))
    return (
        written.withColumn("address_key", keys.portal_address_key(F.col(address))).filter("address_key != ''")
        .groupBy("territory_id", "address_key").agg(F.sum("_doors").alias("doors"), F.min("_pin").alias("pin"))
    )


def match_permits(records: DataFrame, territory: DataFrame, address: str = "address", towns: DataFrame | None = None) -> DataFrame:
    """Every record with `outcome` matched, ambiguous or unmatched, its pin and the reason.

    `towns` (territory_id, town, state, zip) says what ends a location line of each territory.
    Only an address that names one door attaches. The doors an ambiguous address could mean are
    in `ambiguous_candidates`, once per address rather than once per record.
    """
    known = _known_addresses(territory, address)
    placed, names = _place(records.select("territory_id", "location").distinct(), towns)
    # A location's key is worked out once, however many records name it.
    asked = placed.withColumn("address_key", keys.portal_address_key(F.col("location"), *names)).join(
        known, ["territory_id", "address_key"], "left").select(
        F.col("territory_id").alias("_territory"), F.col("location").alias("_location"), "address_key", "doors", "pin")
    same = F.col("territory_id").eqNullSafe(F.col("_territory")) & F.col("location").eqNullSafe(F.col("_location"))
    joined = records.join(asked, same, "left").drop("_territory", "_location")
    doors = F.coalesce(F.col("doors"), F.lit(0))
    relevant = F.when(F.col("has_detail"), F.when(
        text.roof_evidence(F.col("work_description"), F.col("comments")).isNotNull(), KEYWORD_EXPLICIT
    ).otherwise(KEYWORD_ONLY))
    return (
        joined.withColumn("outcome", F.when(doors == 1, "matched").when(doors > 1, "ambiguous").otherwise("unmatched"))
        .withColumn("pams_pin", F.when(doors == 1, F.col("pin")))
        .withColumn("match_reason", F.when(doors > 1, REASON_AMBIGUOUS).when(doors == 0, REASON_UNKNOWN))
        .withColumn("keyword_relevance", relevant).drop("doors", "pin")
    )


def match_summary(matched: DataFrame, territory: DataFrame, address: str = "address") -> DataFrame:
    """Counters per territory."""
    hit = F.col("outcome") == "matched"
    explicit = hit & F.coalesce(F.col("keyword_relevance") == KEYWORD_EXPLICIT, F.lit(False))
    records = matched.groupBy("territory_id").agg(
        F.count(F.lit(1)).alias("records_total"), F.count_if(hit).alias("records_matched"),
        F.count_if(F.col("outcome") == "unmatched").alias("records_unmatched"),
        F.count_if(F.col("outcome") == "ambiguous").alias("records_ambiguous"),
        F.count_if(hit & F.col("has_detail")).alias("details_collected"),
        F.count_if(explicit).alias("explicit_roof_records"),
    )
    per_door = matched.filter("pams_pin is not null").groupBy("territory_id", "pams_pin").agg(
        F.bool_or(F.coalesce(F.col("keyword_relevance") == KEYWORD_EXPLICIT, F.lit(False))).alias("explicit")
    )
    doors_hit = per_door.groupBy("territory_id").agg(
        F.count(F.lit(1)).alias("properties_with_matches"), F.count_if("explicit").alias("properties_with_explicit_roof")
    )
    doors = territory.groupBy("territory_id").agg(F.count(F.lit(1)).alias("properties_total"))
    shared = duplicate_addresses(territory, address).groupBy("territory_id").agg(
        F.count(F.lit(1)).alias("duplicate_address_keys")
    )
    out = doors.join(records, "territory_id", "left").join(doors_hit, "territory_id", "left").join(
        shared, "territory_id", "left"
    ).na.fill(0)
    return out.withColumn("keyword_only_records", F.col("records_matched") - F.col("explicit_roof_records"))


def duplicate_addresses(territory: DataFrame, address: str = "address") -> DataFrame:
    return _known_addresses(territory, address).filter("doors > 1").select("territory_id", "address_key", "doors")


def ambiguous_candidates(territory: DataFrame, address: str = "address") -> DataFrame:
    """(territory_id, address_key, pams_pin): the doors behind every address that several share."""
    keyed = territory.select(
        "territory_id", "pams_pin", keys.portal_address_key(F.col(address)).alias("address_key")
    ).filter("address_key != ''")
    shared = duplicate_addresses(territory, address).select("territory_id", "address_key")
    return keyed.join(shared, ["territory_id", "address_key"], "left_semi")


def newest_first(matched: DataFrame, issue: str = "issue_text", tie: str = "ordinal") -> DataFrame:
    """Position from 0 of each matched permit on its property: parseable days first, newest first, then raw text."""
    day = dates.us_date(F.col(issue))
    rows = matched.filter("pams_pin is not null").withColumns({
        "_dated": F.when(day.isNotNull(), 1).otherwise(0),
        "_when": F.when(day.isNotNull(), day.cast("string")).otherwise(dates.strip(F.col(issue))), "_one": F.lit(1),
    })
    placed = count_below(
        rows, ["territory_id", "pams_pin"], ["_dated", "_when", tie], "_one", "position", [True, True, False]
    )
    return placed.drop("_dated", "_when", "_one")


# --- portal pages ---------------------------------------------------------------------------


def integrity_violations(pages: DataFrame, territory: DataFrame) -> DataFrame:
    """(pams_pin, violation) for every page that cannot be trusted; an empty result means go on.

    `pages` holds pams_pin, block, lot and page_url; `territory` pams_pin, block and lot.
    """
    expected = territory.select("pams_pin", F.col("block").alias("t_block"), F.col("lot").alias("t_lot"),
                                F.lit(True).alias("known"))
    joined = pages.join(expected, "pams_pin", "left").withColumn("url_identity", path_identity(F.col("page_url")))
    has_url = F.coalesce("page_url", F.lit("")) != ""
    moved = ~(F.col("block").eqNullSafe(F.col("t_block")) & F.col("lot").eqNullSafe(F.col("t_lot")))
    elsewhere = F.col("url_identity").isNotNull() & ~(
        F.col("url_identity.block").eqNullSafe(F.col("t_block")) & F.col("url_identity.lot").eqNullSafe(F.col("t_lot"))
    )
    blank = F.coalesce("pams_pin", F.lit("")) == ""
    verdict = (
        F.when(blank, "empty pin").when(F.col("known").isNull(), "outside territory")
        .when(moved, "block/lot mismatch").when(has_url & F.col("url_identity").isNull(), "invalid page url")
        .when(has_url & elsewhere, "page url mismatch")
    )
    single = joined.withColumn("violation", verdict).filter("violation is not null").select("pams_pin", "violation")
    twice = pages.filter("pams_pin != ''").groupBy("pams_pin").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(
        "pams_pin", F.lit("duplicate pin").alias("violation")
    )
    return single.unionByName(twice)


def require_no_violations(violations: DataFrame) -> None:
    """Stops the build on the first few violations."""
    found = violations.limit(5).collect()
    if found:
        raise ValueError("; ".join(f"{row.pams_pin}: {row.violation}" for row in found))


def enrich_applications(applications: DataFrame, roof: DataFrame) -> DataFrame:
    """Portal applications with the roof search's detail by (door, page), plus roof permits no page listed.

    Both sides meet in one full join; `source_scope` marks the supplements. The last roof row of a
    page wins as detail; every unlisted roof row is kept.
    """
    key = ["territory_id", "pams_pin", "detail_url"]
    linked = roof.filter("coalesce(detail_url, '') != ''")
    detail = linked.groupBy(*key).agg(
        F.max_by(F.struct("description", "disposition"), F.struct("ordinal", "description", "disposition")).alias("roof_detail")
    )
    listed = applications.join(detail, key, "left").select(
        *key, "ordinal", "permit_number", "work_description", F.lit("property_page").alias("source_scope"), "roof_detail"
    )
    extra = (
        linked.join(applications.select(*key).distinct(), key, "left_anti").join(detail, key)
        .select(
            *key, "ordinal", F.col("municipal_id").alias("permit_number"), F.col("description").alias("work_description"),
            F.lit(SUPPLEMENT).alias("source_scope"), "roof_detail",
        )
    )
    return listed.unionByName(extra)


def _entries(pages: DataFrame, field: str):
    """How many entries a collected page lists under `construction.field`; 0 where the table has no such column."""
    if "construction" not in pages.columns:
        return F.lit(0)
    return F.coalesce(F.size(F.col(f"construction.{field}")), F.lit(0))


def history_summary(territory: DataFrame, pages: DataFrame, permits: DataFrame, extras: DataFrame | None = None) -> DataFrame:
    """Counters per territory: pages, permits, supplements, attached details, inspections and violations."""
    doors = territory.groupBy("territory_id").agg(F.count(F.lit(1)).alias("properties_total"))
    read = F.col("collection_status") == "collected"
    collected = pages.groupBy("territory_id").agg(
        F.count_if(read).alias("pages_collected"),
        F.sum(F.when(read, _entries(pages, "inspections")).otherwise(0)).alias("inspections_total"),
        F.sum(F.when(read, _entries(pages, "violations")).otherwise(0)).alias("violations_total"),
    )
    extra = F.col("source_scope") == SUPPLEMENT
    counted = permits.groupBy("territory_id").agg(
        F.count(F.lit(1)).alias("permits_total"), F.count_if(extra).alias("supplements"),
        F.count_if(F.col("roof_detail").isNotNull()).alias("details_attached"),
    )
    with_permits = permits.select("territory_id", "pams_pin").distinct().groupBy("territory_id").agg(
        F.count(F.lit(1)).alias("properties_with_permits")
    )
    out = doors.join(collected, "territory_id", "left").join(counted, "territory_id", "left").join(
        with_permits, "territory_id", "left"
    )
    if extras is not None:
        out = out.join(extras, "territory_id", "left")
    out = out.na.fill(0)
    return out.withColumn("pages_not_collected", F.col("properties_total") - F.col("pages_collected")).withColumn(
        "page_permits", F.col("permits_total") - F.col("supplements")
    )


def property_history(territory: DataFrame, pages: DataFrame, permits: DataFrame) -> DataFrame:
    """One nested record per territory parcel, also those never collected.

    A property's permits are one list in page order: a record is as long as the property's own
    file. The long table `permits` is the form to work on; this is the form to hand out. Of the
    page, whatever of PAGE_BLOCKS and construction the table has goes along, without private fields.
    """
    record = F.struct("ordinal", "detail_url", "permit_number", "work_description", "source_scope", "roof_detail")
    lists = permits.groupBy("territory_id", "pams_pin").agg(F.sort_array(F.collect_list(record)).alias("permits"))
    kept = [c for c in (*PAGE_BLOCKS, "construction") if c in pages.columns]
    states = without_private(pages.select("territory_id", "pams_pin", "collection_status", *kept))
    return (
        territory.join(states, ["territory_id", "pams_pin"], "left").join(lists, ["territory_id", "pams_pin"], "left")
        .withColumn("collection_status", F.coalesce("collection_status", F.lit("not_collected")))
        .withColumn("permits", F.coalesce("permits", F.array()))
    )


def history_documents(histories: DataFrame) -> DataFrame:
    """(territory_id, pams_pin, document): each record of `property_history` as one JSON text with identity and construction.

    The territory given to `property_history` brings block, lot and address along. Blocks a page lacks are empty, never missing.
    """
    def listed(field: str):
        if "construction" in histories.columns and field in histories.schema["construction"].dataType.names:
            return F.coalesce(F.col(f"construction.{field}"), F.array())
        return F.array()

    def blank(name: str):
        return F.coalesce(F.col(name).cast("string"), F.lit("")).alias(name)

    def block(name: str):
        empty = F.parse_json(F.lit("{}"))
        if name not in histories.columns:
            return empty.alias(name)
        return F.coalesce(F.parse_json(F.to_json(name)), empty).alias(name)

    document = F.struct(
        "pams_pin", blank("block"), blank("lot"), F.trim(F.coalesce("address", F.lit(""))).alias("address"),
        keys.address_key(F.col("address")).alias("normalized_address"), "collection_status", *[block(name) for name in PAGE_BLOCKS],
        F.struct(F.col("permits").alias("permit_applications"), listed("inspections").alias("inspections"),
                 listed("violations").alias("violations")).alias("construction"),
    )
    return histories.select("territory_id", "pams_pin", F.to_json(document, {"ignoreNullFields": "false"}).alias("document"))


def write_histories(
    territory: DataFrame, pages: DataFrame, permits: DataFrame, root: str, run_id: str, errors: DataFrame | None = None
) -> dict[str, DataFrame]:
    """Publishes the histories of a run as one, and returns them as read back.

    `properties` has a document per parcel, `summary` the counters per territory, `errors` what the collection could not read, as
    rows (territory_id, ...) without private fields: their number grows with the pages, so they are no list inside the summary.
    """
    from doorlens.operators.publish import publish_run, read_run

    tables = {
        "properties": history_documents(property_history(territory, pages, permits)),
        "summary": history_summary(territory, pages, permits),
    }
    if errors is not None:
        tables["errors"] = without_private(errors)
        counted = errors.groupBy("territory_id").agg(F.count(F.lit(1)).alias("collection_errors"))
        tables["summary"] = tables["summary"].join(counted, "territory_id", "left").na.fill(0, ["collection_errors"])
    publish_run(tables, root, run_id)
    return read_run(territory.sparkSession, root, tuple(tables))


def strip_private(document: Column, private=PRIVATE_KEYS) -> Column:
    """A map of fields without the private ones, whatever their case."""
    return F.map_filter(document, lambda key, _: ~F.lower(key).isin(*private))


def without_private(df: DataFrame, private=PRIVATE_KEYS) -> DataFrame:
    """The table without private fields at any depth: in structs, in lists of structs and among map keys."""
    def cleaned(value: Column, kind: T.DataType) -> Column:
        if isinstance(kind, T.StructType):
            kept = [f for f in kind.fields if f.name.lower() not in private]
            whole = F.struct(*[cleaned(value.getField(f.name), f.dataType).alias(f.name) for f in kept]) if kept else F.lit(None)
            return F.when(value.isNotNull(), whole)
        if isinstance(kind, T.ArrayType):
            return F.transform(value, lambda x: cleaned(x, kind.elementType))
        if isinstance(kind, T.MapType):
            open_ = strip_private(value, private) if isinstance(kind.keyType, T.StringType) else value
            return F.transform_values(open_, lambda _, x: cleaned(x, kind.valueType))
        return value

    return df.select(*[cleaned(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields if f.name.lower() not in private])
