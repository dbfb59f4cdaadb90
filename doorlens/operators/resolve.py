"""Resolution: every permit, sale, block group and rental listing to a parcel, or to a reason.

A town is a column (`mun`), so one job resolves all of them. Permits keep their long
form; each in-window record gets exactly one route and one municipal bucket.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doorlens.functions import dates, keys, text
from doorlens.operators.ordering import count_below, first_per_key, last_per_key
from doorlens.operators.spatial import locate

PERMIT_WINDOW_DAYS = 730
MOVER_WINDOW_DAYS = 90

# Reasons, buckets and attributions as published.
REASON_NO_PARCEL = "block/lot matched no territory parcel, and the record carries no address to fall back to"
REASON_ADDRESS_UNKNOWN = "block/lot matched no territory parcel, and its address matched no door"
REASON_ADDRESS_AMBIGUOUS = "block/lot matched no territory parcel, and its address matches more than one door"
BUCKET_MATCHED = "permits_matched_municipal"
BUCKET_PLACEHOLDER = "permits_placeholder_block_lot"
BUCKET_UNMATCHED = "permits_unmatched_municipal"
SOURCE_MODIV = "NJ MOD-IV parcel record"
SOURCE_SR1A = "NJ SR1A sales register"
SOURCE_PERMITS = "NJ DCA construction permits (Socrata)"
SOURCE_ACS = "US Census ACS 5-year estimates, block group"
SOURCE_RENTAL = "municipal rental registration list"


# --- permits -----------------------------------------------------------------------


def permits_within(permits: DataFrame, as_of, days: int = PERMIT_WINDOW_DAYS, day: str = "permit_date") -> DataFrame:
    end = dates.as_of_column(as_of)
    return permits.filter(F.col(day).between(F.date_sub(end, days), end))


def unique_addresses(parcels: DataFrame, address: str = "address") -> DataFrame:
    """Address key to the number of doors behind it, with the pin where there is just one."""
    keyed = keys.with_address_key(parcels, address).filter("address_key != ''")
    return keyed.groupBy("mun", "address_key").agg(
        F.count(F.lit(1)).alias("doors_at_address"), F.min("pams_pin").alias("address_pin")
    )


def parcel_lookup(territory: DataFrame, municipal: DataFrame) -> DataFrame:
    """Parcel key to the first door in territory order, NULL when only the town has it."""
    wanted = ["parcel_key", "pams_pin", "territory_rank"]
    doors = keys.with_parcel_keys(territory).select(*wanted)
    town = keys.with_parcel_keys(municipal).select("parcel_key").distinct().select(
        "parcel_key", F.lit(None).cast("string").alias("pams_pin"), F.lit(None).cast("bigint").alias("territory_rank")
    )
    both = doors.select("parcel_key", "pams_pin", F.col("territory_rank").cast("bigint"), F.lit(False).alias("town")) \
        .unionByName(town.withColumn("town", F.lit(True)))
    return both.groupBy("parcel_key").agg(
        F.min_by(F.when(~F.col("town"), F.col("pams_pin")),
                 F.struct(F.col("town"), F.col("territory_rank"), F.col("pams_pin"))).alias("key_pin"),
        F.bool_or("town").alias("in_town"),
    )


def route_permits(
    permits: DataFrame, territory: DataFrame, municipal: DataFrame, as_of, window_days: int = PERMIT_WINDOW_DAYS
) -> DataFrame:
    """In-window permits with `bucket`, `route`, `pams_pin` and `reason`.

    Routes: out_of_territory, block_lot, address, unmatched. Three lookups on the key, the
    block and the address; the permit side is never regrouped. The date filter reaches the scan.
    """
    inside = keys.with_parcel_keys(permits_within(permits, as_of, window_days))
    inside = inside.withColumn(
        "address_key", F.when(F.col("address").isNotNull(), keys.address_key(F.col("address")))
    )
    blocks = keys.with_parcel_keys(territory).select("block_key").distinct().withColumn("in_territory", F.lit(True))
    joined = (
        inside.join(parcel_lookup(territory, municipal), "parcel_key", "left")
        .join(blocks, "block_key", "left")
        .join(unique_addresses(territory), ["mun", "address_key"], "left")
    )
    outside = F.col("in_territory").isNull()
    by_key = F.col("key_pin").isNotNull()
    found = F.coalesce(F.col("doors_at_address"), F.lit(0))
    has_address = F.coalesce(F.col("address_key"), F.lit("")) != ""
    route = (
        F.when(outside, "out_of_territory").when(by_key, "block_lot").when(has_address & (found == 1), "address")
        .otherwise("unmatched")
    )
    bucket = (
        F.when(F.col("is_placeholder"), BUCKET_PLACEHOLDER)
        .when(F.coalesce(F.col("in_town"), F.lit(False)), BUCKET_MATCHED).otherwise(BUCKET_UNMATCHED)
    )
    reason = F.when(
        F.col("route") == "unmatched",
        F.when(~has_address, REASON_NO_PARCEL).when(found > 1, REASON_ADDRESS_AMBIGUOUS)
        .otherwise(REASON_ADDRESS_UNKNOWN),
    )
    pin = F.when(F.col("route") == "block_lot", F.col("key_pin")).when(F.col("route") == "address", F.col("address_pin"))
    return (
        joined.drop("pams_pin").withColumn("route", route).withColumn("bucket", bucket)
        .withColumn("reason", reason).withColumn("pams_pin", pin)
        .drop("key_pin", "in_town", "in_territory", "doors_at_address", "address_pin")
    )


def permit_accounting(permits: DataFrame, routed: DataFrame, by: str = "mun") -> DataFrame:
    """Counters per town. total = out of window + out of territory + matched + unmatched."""

    def routes(name):
        return F.count_if(F.col("route") == name)

    inside = routed.groupBy(by).agg(
        F.count(F.lit(1)).alias("permits_in_window"),
        routes("out_of_territory").alias("permits_out_of_territory"),
        routes("block_lot").alias("matched_by_block_lot"),
        routes("address").alias("matched_by_address"),
        routes("unmatched").alias("permits_unmatched"),
        *[F.count_if(F.col("bucket") == b).alias(b) for b in (BUCKET_MATCHED, BUCKET_PLACEHOLDER, BUCKET_UNMATCHED)],
    )
    totals = permits.groupBy(by).agg(F.count(F.lit(1)).alias("permits_total"))
    counts = totals.join(inside, by, "left").na.fill(0)
    return (
        counts.withColumn("permits_out_of_window", F.col("permits_total") - F.col("permits_in_window"))
        .withColumn("permits_matched", F.col("matched_by_block_lot") + F.col("matched_by_address"))
        .withColumn("permits_in_territory", F.col("permits_matched") + F.col("permits_unmatched"))
    )


def match_rates(accounting: DataFrame) -> DataFrame:
    territory = F.col("permits_in_territory")
    return (
        accounting.withColumn("permit_match_rate", text.safe_rate(F.col("permits_matched"), territory))
        .withColumn("block_lot_match_rate", text.safe_rate(F.col("matched_by_block_lot"), territory))
        .withColumn("address_match_rate", text.safe_rate(F.col("matched_by_address"), territory))
        .withColumn("municipal_match_rate", text.safe_rate(F.col(BUCKET_MATCHED), F.col("permits_in_window")))
    )


def door_permits(routed: DataFrame) -> DataFrame:
    """Permits that reached a door, newest first as `position` from 0, ties by record id downward.

    Long form on purpose: a door with a third of all permits would not fit one array.
    """
    landed = routed.filter("pams_pin is not null").withColumn("_one", F.lit(1))
    return count_below(
        landed, ["mun", "pams_pin"], ["permit_date", "record_id"], "_one", "position", [True, True]
    ).drop("_one")


def unmatched_permits(routed: DataFrame) -> DataFrame:
    return routed.filter("route = 'unmatched'").select("mun", "record_id", "block", "lot", "parcel_key", "reason")


# --- sales -------------------------------------------------------------------------


def with_sale_key(df: DataFrame) -> DataFrame:
    return df.withColumn("sale_key", keys.sale_key(F.col("mun"), F.col("block"), F.col("lot"), F.col("qualifier")))


def latest_sales(sales: DataFrame) -> DataFrame:
    """The latest recorded sale per sale key, arm's-length or not; the first seen wins exact ties."""
    dated = with_sale_key(sales).filter("deed_date is not null and deed_date != ''")
    return last_per_key(dated, ["sale_key"], ["deed_date", "date_recorded", -F.col("ordinal")])


def sales_within(sales: DataFrame, as_of, window_days: int) -> DataFrame:
    age = F.datediff(dates.as_of_column(as_of), dates.deed_date(F.col("deed_date"), as_of))
    return sales.filter(age.between(0, window_days))


def merge_deed(parcels: DataFrame, latest: DataFrame, as_of) -> DataFrame:
    """Adds `deed`: the register's sale when strictly newer than the parcel's own deed, else the parcel's.

    Date, price, code and source move together.
    """
    register = latest.select(
        "sale_key", F.col("deed_date").alias("_reg_text"), F.col("sale_price").alias("_reg_price"),
        F.trim("nu_code").alias("_reg_code"),
    )
    own = dates.deed_date(F.col("deed_date"), as_of)
    recorded = dates.deed_date(F.col("_reg_text"), as_of)
    newer = recorded.isNotNull() & (own.isNull() | (recorded > own))

    def deed(day, price, code, source):
        return F.struct(
            day.alias("deed_day"), price.alias("price"), code.alias("sales_code"), F.lit(source).alias("source")
        )

    return (
        with_sale_key(parcels).join(register, "sale_key", "left")
        .withColumn(
            "deed",
            F.when(newer, deed(recorded, F.col("_reg_price"), F.col("_reg_code"), SOURCE_SR1A))
            .otherwise(deed(own, F.col("sale_price"), F.col("sales_code"), SOURCE_MODIV)),
        )
        .drop("_reg_text", "_reg_price", "_reg_code")
    )


def deed_vintage(municipal: DataFrame, sales: DataFrame, doors: DataFrame, as_of) -> DataFrame:
    """One row per town: latest deed of either register, latest sale, doors inside the mover window.

    Future deeds count as inside: the window has no lower bound.
    """
    own = municipal.groupBy("mun").agg(F.max(dates.deed_date(F.col("deed_date"), as_of)).alias("_own"))
    sold = sales.groupBy("mun").agg(F.max(dates.deed_date(F.col("deed_date"), as_of)).alias("latest_sale_date"))
    age = F.datediff(dates.as_of_column(as_of), F.col("deed.deed_day"))
    moved = doors.groupBy("mun").agg(F.count_if(age <= MOVER_WINDOW_DAYS).alias("doors_in_mover_window"))
    return (
        own.join(sold, "mun", "left").join(moved, "mun", "left")
        .select(
            "mun", F.greatest("_own", "latest_sale_date").alias("latest_deed_date"), "latest_sale_date",
            F.coalesce("doors_in_mover_window", F.lit(0)).alias("doors_in_mover_window"),
        )
    )


# --- block groups, rental, provenance -------------------------------------------------


def attach_block_group(points: DataFrame, boundaries: DataFrame, acs: DataFrame, keys_=("territory_id", "pams_pin")):
    """Adds `geoid` by containment in the boundaries' `polygon` and the block group's statistics by geoid."""
    return attach_statistics(locate(points.drop("geoid"), boundaries, list(keys_)), acs)


def attach_statistics(placed: DataFrame, acs: DataFrame) -> DataFrame:
    """The block group's statistics where the geoid is known already."""
    return placed.join(acs, "geoid", "left")


def rental_flag(doors: DataFrame, registry: DataFrame) -> DataFrame:
    listed = registry.select(F.trim("pams_pin").alias("pams_pin")).distinct().withColumn("_listed", F.lit(True))
    return doors.join(listed, "pams_pin", "left").withColumn(
        "is_rental", F.coalesce("_listed", F.lit(False))
    ).drop("_listed")


def provenance(as_of, retrieved: dict | None = None):
    """A map from each signal that supplied a fact to where and when it came from."""
    when = retrieved or {}
    signals = (
        ("parcel", F.lit(SOURCE_MODIV), F.lit(True)),
        ("sales", F.lit(SOURCE_SR1A), F.col("deed.source") == SOURCE_SR1A),
        ("permits", F.lit(SOURCE_PERMITS), F.col("permit_count") > 0),
        ("acs", F.lit(SOURCE_ACS), F.col("has_block_group")),
        ("rental", F.lit(SOURCE_RENTAL), F.col("is_rental")),
    )
    entries = [
        F.when(
            present,
            F.struct(
                F.lit(name).alias("key"),
                F.struct(
                    source.alias("source"), F.coalesce(F.lit(when.get(name)).cast("date"), dates.as_of_column(as_of))
                    .alias("retrieved")
                ).alias("value"),
            ),
        )
        for name, source, present in signals
    ]
    return F.map_from_entries(F.filter(F.array(*entries), lambda entry: entry.isNotNull()))


def resolve(
    territory: DataFrame,
    permits: DataFrame,
    sales: DataFrame,
    acs: DataFrame,
    registry: DataFrame,
    as_of,
    municipal: DataFrame | None = None,
    boundaries: DataFrame | None = None,
    window_days: int = PERMIT_WINDOW_DAYS,
    town: str = "Ramsey",
    state: str = "NJ",
    routed: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """The whole resolution. Returns doors, permits (long), unmatched and report.

    A territory table with columns `town` and `state` names each parcel's own; else `town` and `state` hold for all.
    """
    municipal = territory if municipal is None else municipal
    routed = route_permits(permits, territory, municipal, as_of, window_days) if routed is None else routed
    landed = routed.filter("pams_pin is not null").groupBy("pams_pin").agg(F.count(F.lit(1)).alias("permit_count"))
    doors = merge_deed(territory, latest_sales(sales), as_of)
    if boundaries is not None:
        doors = locate(doors.drop("geoid"), boundaries, ["territory_id", "pams_pin"])
    doors = rental_flag(doors, registry).join(landed, "pams_pin", "left")
    doors = doors.join(acs.withColumn("has_block_group", F.lit(True)), "geoid", "left")
    doors = (
        doors.withColumn("permit_count", F.coalesce("permit_count", F.lit(0)))
        .withColumn("has_block_group", F.coalesce("has_block_group", F.lit(False)))
        .withColumn("parcel_key", keys.parcel_key(F.col("mun"), F.col("block"), F.col("lot")))
        .withColumn("address_key", keys.address_key(F.col("address")))
        .withColumn("situs", keys.situs_display(F.col("address"), F.col("zip5"), *[
            F.col(c) if c in territory.columns else F.lit(v) for c, v in (("town", town), ("state", state))]))
        .withColumn("provenance", provenance(as_of))
    )
    report = match_rates(permit_accounting(permits, routed)).join(signal_coverage(doors), "mun", "full").na.fill(0)
    return {
        "doors": doors, "permits": door_permits(routed), "unmatched": unmatched_permits(routed), "report": report,
    }


def signal_coverage(doors: DataFrame, by: str = "mun") -> DataFrame:
    signal = (F.col("permit_count") > 0) | F.col("has_block_group") | F.col("is_rental")
    counts = doors.groupBy(by).agg(
        F.count(F.lit(1)).alias("doors_total"), F.count_if(signal).alias("doors_with_signal"),
        F.count_if("has_block_group").alias("doors_with_block_group"),
        F.count_if(F.col("deed.source") == SOURCE_SR1A).alias("sales_applied"),
    )
    return counts.withColumn("coverage", text.safe_rate(F.col("doors_with_signal"), F.col("doors_total")))


# --- lookups -----------------------------------------------------------------------


def address_index(doors: DataFrame) -> DataFrame:
    """(address_key, pams_pin): the short and the full key of each door, first in publication order."""
    both = doors.select(
        "pams_pin", "territory_rank",
        F.explode(F.array(
            F.struct(keys.street_address_key(F.col("situs")).alias("address_key"), F.lit(0).alias("kind")),
            F.struct(keys.address_key(F.col("situs")).alias("address_key"), F.lit(1).alias("kind")),
        )).alias("e"),
    ).select("e.address_key", "pams_pin", "territory_rank", "e.kind")
    return first_per_key(both, ["address_key"], ["territory_rank", "pams_pin", "kind"]).select("address_key", "pams_pin")


def find_doors(requests: DataFrame, doors: DataFrame, address: str = "address") -> DataFrame:
    """Adds the pin of the door each asked-for address names, NULL when none."""
    asked = keys.with_address_key(requests, address)
    return asked.join(address_index(doors).withColumnRenamed("pams_pin", "found_pin"), "address_key", "left")


def doors_per_street(
    doors: DataFrame, min_doors: int = 4, limit: int = 8, keys_=("territory_id",), before_unit: bool = False
) -> DataFrame:
    """The streets with the most doors per territory, by count then name; `before_unit` as in `keys.map_street`."""
    from doorlens.operators.ordering import top_per_key

    counts = (
        doors.withColumn("street", keys.map_street(F.col("situs"), before_unit)).filter("street is not null")
        .groupBy(*keys_, "street").agg(F.count(F.lit(1)).alias("doors")).filter(F.col("doors") >= min_doors)
    )
    return top_per_key(counts, list(keys_), [F.col("doors").desc(), F.col("street")], limit, "street")
