"""Scalar rules as steps over whole tables (C)."""

from __future__ import annotations

from pyspark.sql import functions as F

from doorlens.functions import dates, geo, keys, text
from doorlens.plans.analogs import AS_OF, AS_OF_SQL, Tables
from doorlens.plans.registry import query
from doorlens.scoring import engine

A = AS_OF_SQL


def _component(c: str) -> str:
    """The check's own way to a key part: cut at the dot with plain string functions."""
    c = f"upper(regexp_replace({c}, '\\s+', '', 'g'))"
    head = f"split_part({c}, '.', 1)"
    tail = f"CASE WHEN position('.' IN {c}) > 0 THEN substr({c}, position('.' IN {c}) + 1) ELSE '' END"
    digits = f"regexp_full_match({c}, '[0-9]+\\.[0-9]*')"
    tail = f"CASE WHEN {digits} THEN rtrim({tail}, '0') ELSE {tail} END"
    return (
        f"CASE WHEN {c} = '' THEN '' ELSE CASE WHEN ltrim({head}, '0') = '' THEN '0' ELSE ltrim({head}, '0') END"
        f" || CASE WHEN ({tail}) = '' THEN '' ELSE '.' || ({tail}) END END"
    )


KEY_SQL = f"{_component('mun')} || '/' || {_component('block')} || '/' || {_component('lot')}"
SALE_KEY_SQL = f"""{KEY_SQL} || CASE WHEN trim(qualifier) = '' THEN '' ELSE '/' || upper(trim(qualifier)) END"""


def deed_sql(c: str) -> str:
    century = f"CASE WHEN CAST(substr({c}, 1, 2) AS INT) <= 2 THEN '20' ELSE '19' END"
    return (
        f"try_cast({century} || substr({c}, 1, 2) || '-' || substr({c}, 3, 2) || '-' || substr({c}, 5, 2) AS DATE)"
    )


# The made-up addresses have a known shape, so the check reads the canonical form off the row number.
_STREET = """CASE k % 8 WHEN 0 THEN 'OAK' WHEN 1 THEN 'ELM' WHEN 2 THEN 'MAIN' WHEN 3 THEN 'FAWN HILL'
    WHEN 4 THEN 'E CEDAR' WHEN 5 THEN 'COURT' WHEN 6 THEN 'NORTH PINE' ELSE 'MOMAR' END"""
_TYPE = "CASE k % 5 WHEN 0 THEN 'ST' WHEN 1 THEN 'ST' WHEN 2 THEN 'AVE' WHEN 3 THEN 'AVE' ELSE 'TER' END"
ADDRESS_SQL = f"CAST(k % 200 + 1 AS STRING) || ' ' || {_STREET} || ' ' || {_TYPE}"


@query("c1_parse_deed_date", f"SELECT k, CAST({deed_sql('deed_date')} AS STRING) AS deed_day FROM v_parcel_raw")
def parse_deed_date(t: Tables):
    return t.v_parcel_raw.select("k", dates.deed_date(F.col("deed_date"), AS_OF).cast("string").alias("deed_day"))


@query("c2_normalize_address", f"SELECT k, {ADDRESS_SQL} AS address_key FROM v_parcel_raw")
def normalize_address(t: Tables):
    return keys.with_address_key(t.v_parcel_raw).select("k", "address_key")


@query("c3_parcel_key", f"SELECT record_id, {KEY_SQL} AS parcel_key FROM v_permit_raw")
def parcel_key(t: Tables):
    return keys.with_parcel_keys(t.v_permit_raw).select("record_id", "parcel_key")


@query("c4_sale_key", f"SELECT k, {SALE_KEY_SQL} AS sale_key FROM v_parcel_raw")
def sale_key(t: Tables):
    return keys.with_parcel_keys(t.v_parcel_raw, qualifier="qualifier").select("k", "sale_key")


@query("c7_situs_display", """SELECT k, address || ', Ramsey NJ' || CASE WHEN zip5 = '' THEN '' ELSE ' ' || zip5 END AS situs
    FROM v_parcel_raw""")
def situs_display(t: Tables):
    return t.v_parcel_raw.select(
        "k", keys.situs_display(F.col("address"), F.col("zip5"), F.lit("Ramsey"), F.lit("NJ")).alias("situs")
    )


@query("c8_us_date", """SELECT ordinal, CASE WHEN l_orderkey % 2 = 0 THEN NULL
        ELSE substr(CAST(issue_date AS STRING), 1, 8) || '28' END AS closed, CAST(issue_date AS STRING) AS issued
    FROM v_permit WHERE source = 'SDL'""")
def us_date(t: Tables):
    return t.v_portal_permit.select(
        "ordinal", dates.us_date(F.col("close_date")).cast("string").alias("closed"),
        dates.us_date(F.col("issue_date")).cast("string").alias("issued"),
    )


@query("c9_money", """SELECT k, CAST(k % 900 * 1000 + 500 AS DOUBLE) AS assessed,
        CASE WHEN k % 4 = 0 THEN -1.0 ELSE CAST(k % 700 * 1000 AS DOUBLE) END AS price FROM v_portal""")
def money(t: Tables):
    return t.v_portal.select(
        "k", text.money(F.col("assessed_total")).alias("assessed"),
        F.coalesce(text.money(F.col("last_sale_price")), F.lit(-1.0)).alias("price"),
    )


@query("c10_portal_disposition", """SELECT ordinal, CASE WHEN l_orderkey % 9 IN (0, 1, 2) THEN 'completed'
        WHEN l_orderkey % 9 = 3 THEN 'voided' WHEN l_orderkey % 9 IN (4, 6) THEN 'expired'
        WHEN l_orderkey % 9 = 5 THEN 'abandoned' END AS disposition
    FROM v_permit WHERE source = 'SDL'""")
def portal_disposition(t: Tables):
    return t.v_portal_permit.select("ordinal", text.portal_disposition(F.col("status")).alias("disposition"))


_PORTAL_STREET = _STREET.replace("NORTH PINE", "N PINE")
# A rear landmark only goes when a house number leads; with a unit word it is cut there anyway.
PORTAL_KEY_SQL = f"""CASE WHEN v.ordinal % 5 = 0 THEN CAST(k % 200 + 1 AS STRING) || ' ' || {_PORTAL_STREET} || ' ' || {_TYPE}
    WHEN v.ordinal % 7 = 0 THEN CAST(k % 200 + 1 AS STRING) || ' ' || CAST(k % 200 + 3 AS STRING) || ' OAK ST'
    WHEN v.ordinal % 11 = 0 THEN 'BARN 12 ELM ST'
    ELSE CAST(k % 200 + 1 AS STRING) || ' ' || {_PORTAL_STREET} || ' ' || {_TYPE} END"""


@query("c11_portal_address", f"SELECT v.ordinal, {PORTAL_KEY_SQL} AS address_key FROM v_permit v")
def portal_address(t: Tables):
    lines = t.v_portal_line.join(t.v_town, "territory_id")
    return lines.select("ordinal", keys.portal_address_key(F.col("location"), F.col("town"), F.col("state"), F.col("zip")).alias("address_key"))


@query("c12_roof_relevance", """SELECT ordinal, CASE WHEN l_partkey % 2 <> 0 AND description LIKE 'roof %' THEN description
        WHEN l_partkey % 3 = 0 THEN 'Re-roof, ice shield' END AS evidence FROM v_permit""")
def roof_relevance(t: Tables):
    return t.v_portal_line.select(
        "ordinal", text.roof_evidence(F.col("work_description"), F.col("comments")).alias("evidence")
    )


@query("c13_page_url_identity", """SELECT page_id, CASE WHEN len(parts) = 2 THEN parts[1] END AS block,
        CASE WHEN len(parts) = 2 THEN parts[2] END AS lot
    FROM (SELECT page_id, list_filter(string_split(
              regexp_replace(regexp_replace(url, '^[a-z]+://[^/?#]*', ''), '[?#].*$', ''), '/'),
              lambda x: x <> '') AS parts FROM v_page) AS p""")
def page_url_identity(t: Tables):
    from doorlens.operators.history import path_identity

    portal = F.regexp_replace("url", r"^([a-z]+://[^/?#]*)", "$1/properties")
    return t.v_page.withColumn("identity", path_identity(portal)).select(
        "page_id", F.col("identity.block").alias("block"), F.col("identity.lot").alias("lot")
    )


@query("c14_whole_years", f"""SELECT ordinal, extract(year FROM {A}) - extract(year FROM issue_date)
        - CASE WHEN extract(month FROM issue_date) * 100 + extract(day FROM issue_date) > 630 THEN 1 ELSE 0 END AS years
    FROM v_permit""")
def whole_years(t: Tables):
    return t.v_permit.select("ordinal", dates.whole_years(F.col("issue_date"), F.lit(AS_OF)).cast("bigint").alias("years"))


@query("c15_shift_years", "SELECT ordinal, CAST(CAST(issue_date - INTERVAL 2 YEAR AS DATE) AS STRING) AS earlier FROM v_permit")
def shift_years(t: Tables):
    return t.v_permit.select("ordinal", dates.years_back(F.col("issue_date"), 2).cast("string").alias("earlier"))


STRENGTH_SQL = """CASE WHEN {d} IS NULL OR {d} < 0 OR {d} >= 365 THEN 0.0 WHEN {d} <= 90 THEN 90.0
    ELSE 90.0 * (exp(-2.0 * ({d} - 90) / 275.0) - exp(-2.0)) / (1.0 - exp(-2.0)) END"""


@query("c16_mover_strength", f"""SELECT ordinal, round({STRENGTH_SQL.format(d=f"({A} - sale_day)")}, 6) AS strength FROM v_sale""")
def mover_strength(t: Tables):
    days = F.datediff(F.lit(AS_OF), F.col("sale_day"))
    return t.v_sale.select("ordinal", F.round(engine.mover_strength(days), 6).alias("strength"))


@query("c17_blend", f"""SELECT ordinal, round(b + s / 90.0 * (90.0 - 7.0 * b / 8.0), 6) AS blended FROM (
    SELECT ordinal, CAST(ordinal % 119 AS DOUBLE) AS b, {STRENGTH_SQL.format(d=f"({A} - sale_day)")} AS s FROM v_sale) AS x""")
def blend(t: Tables):
    days = F.datediff(F.lit(AS_OF), F.col("sale_day"))
    base = (F.col("ordinal") % 119).cast("double")
    return t.v_sale.select("ordinal", F.round(engine.blend(base, engine.mover_strength(days)), 6).alias("blended"))


@query("c18_round_half_up", """SELECT ordinal, CAST(trunc(half) + CASE WHEN half - trunc(half) >= 0.5 THEN 1 ELSE 0 END
    AS BIGINT) AS rounded FROM (SELECT ordinal, CAST(ordinal % 401 AS DOUBLE) / 4.0 AS half FROM v_sale) AS x""")
def round_half_up(t: Tables):
    return t.v_sale.select("ordinal", text.round_half_up((F.col("ordinal") % 401) / F.lit(4.0)).alias("rounded"))


@query("c19_clamp", """SELECT ordinal, CAST(floor(CASE WHEN p < 0 THEN 0 WHEN p > 100 THEN 100 ELSE p END + 0.5) AS BIGINT)
        AS score, round(floor(CASE WHEN p < 0 THEN 0 WHEN p > 100 THEN 100 ELSE p END + 0.5) - p, 6) AS adjustment
    FROM (SELECT ordinal, CAST(ordinal % 701 AS DOUBLE) / 5.0 - 20.0 AS p FROM v_sale) AS x""")
def clamp(t: Tables):
    before = F.col("p")
    score = text.round_half_up(F.least(F.greatest(before, F.lit(0.0)), F.lit(100.0)))
    return t.v_sale.withColumn("p", (F.col("ordinal") % 701) / F.lit(5.0) - 20.0).select(
        "ordinal", score.alias("score"), F.round(score - before, 6).alias("adjustment")
    )


def equirect_sql(radius: str) -> str:
    d = "0.017453292519943295"
    return (
        f"sqrt(power((lon - -74.15) * {d} * cos((lat + 41.05) / 2.0 * {d}), 2) + power((lat - 41.05) * {d}, 2)) * {radius}"
    )


@query("c20_equirectangular", f"""SELECT pams_pin, round({equirect_sql('6371008.8')}, 4) AS territory_m,
        round({equirect_sql('6371000.0')}, 4) AS comparables_m FROM v_parcel WHERE lon IS NOT NULL""")
def equirectangular(t: Tables):
    lon, lat = F.lit(-74.15), F.lit(41.05)
    return t.v_parcel.filter("lon is not null").select(
        "pams_pin",
        F.round(geo.equirectangular_m(F.col("lon"), F.col("lat"), lon, lat, geo.TERRITORY_RADIUS_M), 4).alias("territory_m"),
        F.round(geo.equirectangular_m(F.col("lon"), F.col("lat"), lon, lat), 4).alias("comparables_m"),
    )


HAVERSINE_SQL = """2 * 6371008.8 * asin(sqrt(power(sin(radians({b2} - {b1}) / 2), 2)
    + cos(radians({b1})) * cos(radians({b2})) * power(sin(radians({a2} - {a1}) / 2), 2)))"""


@query("c21_leg_minutes", f"""SELECT pams_pin, round({HAVERSINE_SQL.format(a1='-74.15', b1='41.05', a2='lon', b2='lat')}
        * 1.3 / (3.0 * 1609.344 / 60.0), 6) AS minutes FROM v_parcel WHERE lon IS NOT NULL""")
def leg_minutes(t: Tables):
    return t.v_parcel.filter("lon is not null").select(
        "pams_pin",
        F.round(geo.straight_leg_minutes(F.lit(-74.15), F.lit(41.05), F.col("lon"), F.col("lat")), 6).alias("minutes"),
    )


@query("c22_area_centroid", """SELECT geoid, round((min_x + max_x) / 2, 8) AS lon, round((min_y + max_y) / 2, 8) AS lat
    FROM v_block_group""")
def area_centroid(t: Tables):
    from doorlens.operators.spatial import box_polygon

    box = box_polygon(F.col("min_x"), F.col("min_y"), F.col("max_x"), F.col("max_y"))
    return t.v_block_group.withColumn("c", geo.area_centroid(box)).select(
        "geoid", F.round("c.lon", 8).alias("lon"), F.round("c.lat", 8).alias("lat")
    )


_BASE = f"{geo.ORTHO_BASE}/Orthos_Natural_2020_NJ_WM/MapServer/export?bbox="
_MERC = """SELECT pams_pin, round(radians(lon) * 6378137.0, 3) AS x,
    round(ln(tan(pi() / 4 + radians(lat) / 2)) * 6378137.0, 3) AS y FROM v_parcel WHERE lon IS NOT NULL"""


@query("c23_tile_reference", f"""SELECT pams_pin, '{_BASE}' || printf('%.3f', x - 60.0) || '%2C' || printf('%.3f', y - 60.0)
        || '%2C' || printf('%.3f', x + 60.0) || '%2C' || printf('%.3f', y + 60.0)
        || '&bboxSR=3857&imageSR=3857&size=640%2C640&format=png&f=image' AS image_ref FROM ({_MERC}) AS m""")
def tile_reference(t: Tables):
    from doorlens.operators.imagery import tile_manifest

    return tile_manifest(t.v_parcel).filter("vintage = 2020").select("pams_pin", "image_ref")


@query("c24_reference_bbox", f"""SELECT pams_pin, round(x - 60.0, 3) AS min_x, round(y - 60.0, 3) AS min_y,
        round(x + 60.0, 3) AS max_x, round(y + 60.0, 3) AS max_y FROM ({_MERC}) AS m""")
def reference_bbox(t: Tables):
    from doorlens.operators.imagery import tile_manifest

    tiles = tile_manifest(t.v_parcel, vintages=(2015,)).withColumn("b", geo.ref_bbox(F.col("image_ref")))
    names = ("min_x", "min_y", "max_x", "max_y")
    return tiles.select("pams_pin", *[F.round(F.get("b", F.lit(i)), 3).alias(n) for i, n in enumerate(names)])


@query("c25_home_age_bands", """SELECT pams_pin, CAST(CASE WHEN yr_constr <= 0 OR yr_constr > 2001 THEN 0
        WHEN 2001 - yr_constr >= 75 THEN 10 WHEN 2001 - yr_constr >= 50 THEN 8 WHEN 2001 - yr_constr >= 30 THEN 5
        ELSE 0 END AS BIGINT) AS points FROM v_parcel""")
def home_age_bands(t: Tables):
    age = F.when((F.col("yr_constr") > 0) & (F.col("yr_constr") <= AS_OF.year), F.lit(AS_OF.year) - F.col("yr_constr"))
    return t.v_parcel.select("pams_pin", engine.banded(age, engine.HOME_BANDS).cast("bigint").alias("points"))


@query("c26_roof_age_bands", f"""SELECT pams_pin, CAST(age AS BIGINT) AS roof_age, CAST(CASE WHEN age >= 20 THEN 12
        WHEN age >= 15 THEN 8 WHEN age >= 10 THEN 4 ELSE 0 END AS BIGINT) AS points FROM (
    SELECT pams_pin, 2013 - extract(year FROM d) - CASE WHEN extract(month FROM d) * 100 + extract(day FROM d) > 630 THEN 1
        ELSE 0 END AS age FROM (
        SELECT pams_pin, max(coalesce(completion_date, issue_date)) AS d FROM v_permit
        WHERE disposition = 'completed' AND description = 'roof replacement'
          AND coalesce(completion_date, issue_date) <= DATE '2013-06-30' GROUP BY pams_pin) AS m) AS a""")
def roof_age_bands(t: Tables):
    from doorlens.scoring import facts

    end = F.lit("2013-06-30").cast("date")
    done = facts.completion_day(F.col("disposition"), F.col("completion_date"), F.col("issue_date"))
    installs = t.v_permit.filter(text.is_roof_install(F.col("description")) & (done <= end))
    latest = installs.groupBy("pams_pin").agg(F.max(done).alias("d"))
    age = dates.whole_years(F.col("d"), end)
    return latest.select(
        "pams_pin", age.cast("bigint").alias("roof_age"), engine.banded(age, engine.ROOF_BANDS).cast("bigint").alias("points")
    )


@query("c28_spoken_street", """SELECT k, CASE k % 8 WHEN 0 THEN 'Oak' WHEN 1 THEN 'Elm' WHEN 2 THEN 'Main'
        WHEN 3 THEN 'Fawn Hill' WHEN 4 THEN 'E Cedar' WHEN 5 THEN 'Court' WHEN 6 THEN 'North Pine' ELSE 'Momar' END || ' '
        || CASE k % 5 WHEN 0 THEN 'Street' WHEN 1 THEN 'St.' WHEN 2 THEN 'Ave' WHEN 3 THEN 'Avenue' ELSE 'Terrace' END
        || CASE WHEN k % 17 <> 0 AND k % 19 = 0 THEN ' #2' ELSE '' END AS street FROM v_situs""")
def spoken_street(t: Tables):
    return t.v_situs.select("k", keys.spoken_street(F.col("situs")).alias("street"))


@query("c31_rounded_breakdown", """SELECT k, CAST(base AS BIGINT) AS base, CAST(lift AS BIGINT) AS lift,
        CAST(rental AS BIGINT) AS rental, CAST(score - base - lift - rental AS BIGINT) AS adjustment,
        CASE WHEN raw < 0 THEN 'floor' WHEN raw > 100 THEN 'ceiling' ELSE 'none' END AS clamp FROM (
    SELECT k, score, project + capacity + fit AS base, floor(k % 97 / 8.0 + 0.5) AS lift,
           CASE WHEN k % 3 = 0 THEN -25 ELSE 0 END AS rental,
           project + capacity + fit + k % 97 / 8.0 + CASE WHEN k % 3 = 0 THEN -25 ELSE 0 END AS raw
    FROM v_door_score WHERE score IS NOT NULL) AS x""")
def rounded_breakdown(t: Tables):
    from doorlens.operators.publish import rounded_breakdown as breakdown

    doors = t.v_door_score.filter("score is not null").select(
        "k", "score", (F.col("project") + F.col("capacity") + F.col("fit")).alias("base"),
        (F.col("k") % 97 / F.lit(8.0)).alias("mover_lift"), F.when(F.col("k") % 3 == 0, -25).otherwise(0).alias("rental_modifier"),
    )
    return breakdown(doors).select(
        "k", *[F.col(c).cast("bigint").alias(n) for c, n in (
            ("shown_base", "base"), ("shown_lift", "lift"), ("shown_rental", "rental"), ("shown_adjustment", "adjustment"))],
        F.coalesce("clamp", F.lit("none")).alias("clamp"),
    )
