"""Joins (J) and the set operations on them (U)."""

from __future__ import annotations

from pyspark.sql import functions as F

from doorlens.operators import filters, history, imagery, permits, resolve, spatial, suggest
from doorlens.plans.analogs import AS_OF, AS_OF_SQL, Tables
from doorlens.plans.registry import query
from doorlens.plans.scalars import ADDRESS_SQL, KEY_SQL, SALE_KEY_SQL, _component, deed_sql
from doorlens.scoring import facts

A = AS_OF_SQL
BLOCK_SQL = f"{_component('mun')} || '/' || {_component('block')}"
DOOR = ["territory_id", "pams_pin"]


def territory(t: Tables):
    return filters.of_class(t.v_parcel_raw)


def routed(t: Tables):
    t = t.landed()
    return resolve.route_permits(t.v_permit_raw, territory(t), t.v_parcel_raw, AS_OF)


# The routing rules written once as SQL; the queries below look at it from different sides.
ROUTED_SQL = f"""parcels AS (SELECT *, {KEY_SQL} AS pkey, {BLOCK_SQL} AS bkey, {ADDRESS_SQL} AS akey FROM v_parcel_raw),
    doors AS (SELECT pkey, arg_min(pams_pin, territory_rank) AS pin FROM parcels WHERE prop_class = '2' GROUP BY pkey),
    blocks AS (SELECT DISTINCT bkey FROM parcels WHERE prop_class = '2'),
    town AS (SELECT DISTINCT pkey FROM parcels),
    addresses AS (SELECT mun, akey, count(*) AS n, min(pams_pin) AS pin FROM parcels WHERE prop_class = '2'
                  GROUP BY mun, akey),
    p AS (SELECT *, {KEY_SQL} AS pkey, {BLOCK_SQL} AS bkey,
                 CASE WHEN address = '1 NOWHERE RD' THEN address WHEN address IS NOT NULL THEN {ADDRESS_SQL} END AS akey
          FROM v_permit_raw WHERE permit_date BETWEEN {A} - 730 AND {A}),
    joined AS (SELECT p.*, d.pin AS key_pin, b.bkey IS NOT NULL AS inside, w.pkey IS NOT NULL AS in_town,
                      coalesce(a.n, 0) AS n, a.pin AS address_pin
               FROM p LEFT JOIN doors d ON p.pkey = d.pkey LEFT JOIN blocks b ON p.bkey = b.bkey
                    LEFT JOIN town w ON p.pkey = w.pkey LEFT JOIN addresses a ON p.mun = a.mun AND p.akey = a.akey),
    routed AS (SELECT *, CASE WHEN NOT inside THEN 'out_of_territory' WHEN key_pin IS NOT NULL THEN 'block_lot'
                              WHEN n = 1 THEN 'address' ELSE 'unmatched' END AS route,
                      CASE WHEN ltrim(trim(block), '0') = '' OR ltrim(trim(lot), '0') = ''
                           THEN 'permits_placeholder_block_lot' WHEN in_town THEN 'permits_matched_municipal'
                           ELSE 'permits_unmatched_municipal' END AS bucket,
                      CASE WHEN NOT inside THEN NULL WHEN key_pin IS NOT NULL THEN key_pin WHEN n = 1 THEN address_pin END
                          AS pams_pin
               FROM joined)"""


@query("j1_permit_block_lot", f"WITH {ROUTED_SQL} SELECT record_id, pams_pin FROM routed WHERE route = 'block_lot'")
def permit_block_lot(t: Tables):
    return routed(t).filter("route = 'block_lot'").select("record_id", "pams_pin")


@query("j2_permit_address_fallback", f"""WITH {ROUTED_SQL} SELECT record_id, route, pams_pin,
        CASE WHEN route = 'address' THEN NULL WHEN akey IS NULL THEN '{resolve.REASON_NO_PARCEL}'
             WHEN n > 1 THEN '{resolve.REASON_ADDRESS_AMBIGUOUS}' ELSE '{resolve.REASON_ADDRESS_UNKNOWN}' END AS reason
    FROM routed WHERE route IN ('address', 'unmatched')""")
def permit_address_fallback(t: Tables):
    return routed(t).filter("route in ('address', 'unmatched')").select("record_id", "route", "pams_pin", "reason")


@query("j3_out_of_territory", f"WITH {ROUTED_SQL} SELECT record_id, block FROM routed WHERE route = 'out_of_territory'")
def out_of_territory(t: Tables):
    return routed(t).filter("route = 'out_of_territory'").select("record_id", "block")


@query("j4_municipal_bucket", f"WITH {ROUTED_SQL} SELECT record_id, bucket FROM routed")
def municipal_bucket(t: Tables):
    return routed(t).select("record_id", "bucket")


LATEST_SQL = f"""latest AS (SELECT * FROM (SELECT *, {SALE_KEY_SQL} AS skey, row_number() OVER (PARTITION BY {SALE_KEY_SQL}
    ORDER BY deed_date DESC, date_recorded DESC, ordinal) AS rn FROM v_sale WHERE deed_date <> '') AS s WHERE rn = 1)"""


@query("j5_sale_to_parcel", f"""WITH {LATEST_SQL}, parcels AS (SELECT k, {SALE_KEY_SQL} AS skey FROM v_parcel_raw)
    SELECT p.k, l.deed_date, coalesce(l.sale_price, -1.0) AS sale_price FROM parcels p LEFT JOIN latest l ON p.skey = l.skey""")
def sale_to_parcel(t: Tables):
    latest = resolve.latest_sales(t.v_sale).select("sale_key", "deed_date", "sale_price")
    return resolve.with_sale_key(t.v_parcel_raw.drop("deed_date", "sale_price")).join(latest, "sale_key", "left").select(
        "k", "deed_date", F.coalesce("sale_price", F.lit(-1.0)).alias("sale_price")
    )


DEED_SQL = f"""{LATEST_SQL},
    parcels AS (SELECT *, {SALE_KEY_SQL} AS skey, {deed_sql('deed_date')} AS own FROM v_parcel_raw),
    merged AS (SELECT p.*, l.sale_price AS reg_price, l.nu_code AS reg_code, l.sale_day AS reg_day,
                      l.skey IS NOT NULL AND (p.own IS NULL OR l.sale_day > p.own) AS newer
               FROM parcels p LEFT JOIN latest l ON p.skey = l.skey),
    deeds AS (SELECT *, CASE WHEN newer THEN reg_day ELSE own END AS deed_day,
                     CASE WHEN newer THEN reg_price ELSE sale_price END AS price,
                     CASE WHEN newer THEN reg_code ELSE sales_code END AS code,
                     CASE WHEN newer THEN 'NJ SR1A sales register' ELSE 'NJ MOD-IV parcel record' END AS source
              FROM merged)"""


@query("j6_deed_merge", f"""WITH {DEED_SQL} SELECT k, CAST(deed_day AS STRING) AS deed_day, price, code, source FROM deeds""")
def deed_merge(t: Tables):
    t = t.landed()
    merged = resolve.merge_deed(t.v_parcel_raw, resolve.latest_sales(t.v_sale), AS_OF)
    return merged.select("k", F.col("deed.deed_day").cast("string").alias("deed_day"), F.col("deed.price").alias("price"),
                         F.col("deed.sales_code").alias("code"), F.col("deed.source").alias("source"))


def boxes(t: Tables):
    corner = [F.col(c) for c in ("min_x", "min_y", "max_x", "max_y")]
    return t.v_block_group.select("geoid", "ordinal", spatial.box_polygon(*corner).alias("polygon"))


PLACED_SQL = """placed AS (SELECT p.pams_pin, arg_min(b.geoid, b.ordinal) AS geoid FROM v_parcel p JOIN v_block_group b
        ON p.lon BETWEEN b.min_x AND b.max_x AND p.lat BETWEEN b.min_y AND b.max_y GROUP BY p.pams_pin)"""


@query("j7_point_in_polygon", f"""WITH {PLACED_SQL} SELECT p.pams_pin, g.geoid FROM v_parcel p
    LEFT JOIN placed g ON p.pams_pin = g.pams_pin""")
def point_in_polygon(t: Tables):
    return spatial.locate(t.v_parcel.drop("geoid"), boxes(t), DOOR).select("pams_pin", "geoid")


@query("j8_door_to_acs", f"""WITH {PLACED_SQL} SELECT p.pams_pin, g.geoid, coalesce(round(a.dual_income_pct, 6), -1.0) AS dual_income_pct
    FROM v_parcel p LEFT JOIN placed g ON p.pams_pin = g.pams_pin LEFT JOIN v_acs_stats a ON g.geoid = 'BG' || lpad(a.geoid, 2, '0')""")
def door_to_acs(t: Tables):
    stats = t.v_acs_stats.withColumn("geoid", F.concat(F.lit("BG"), F.lpad("geoid", 2, "0")))
    return resolve.attach_block_group(t.v_parcel, boxes(t), stats).select(
        "pams_pin", "geoid", F.coalesce(F.round("dual_income_pct", 6), F.lit(-1.0)).alias("dual_income_pct")
    )


@query("j9_rental_flag", """SELECT pams_pin, pams_pin IN (SELECT pams_pin FROM v_rental) AS is_rental FROM v_parcel""")
def rental_flag(t: Tables):
    padded = t.v_rental.withColumn("pams_pin", F.concat(F.lit(" "), F.col("pams_pin"), F.lit("  ")))
    return resolve.rental_flag(t.v_parcel, padded).select("pams_pin", "is_rental")


NEAR_SQL = """near AS (SELECT * FROM (
        SELECT s.territory_id, s.pams_pin, c.pams_pin AS comp_pin, c.net_value AS value, d.m AS distance_m,
               row_number() OVER (PARTITION BY s.territory_id, s.pams_pin ORDER BY d.m, c.pams_pin) AS rank
        FROM v_parcel s JOIN v_parcel c ON s.territory_id = c.territory_id AND s.pams_pin <> c.pams_pin,
             LATERAL (SELECT sqrt(power((c.lon - s.lon) * 0.017453292519943295
                 * cos((c.lat + s.lat) / 2.0 * 0.017453292519943295), 2)
                 + power((c.lat - s.lat) * 0.017453292519943295, 2)) * 6371000.0 AS m) AS d
        WHERE c.prop_class = '2' AND c.net_value > 0 AND c.lon IS NOT NULL AND s.lon IS NOT NULL) AS x WHERE rank <= 20)"""


@query("j10_nearest_comparables", f"""WITH {NEAR_SQL} SELECT pams_pin, comp_pin, CAST(rank AS BIGINT) AS rank,
    round(distance_m, 4) AS distance_m, value FROM near""")
def nearest_comparables(t: Tables):
    t = t.landed()
    return spatial.nearest_comparables(t.v_parcel).select(
        "pams_pin", "comp_pin", F.col("rank").cast("bigint").alias("rank"), F.round("distance_m", 4).alias("distance_m"),
        "value",
    )


@query("j11_portal_page", """SELECT p.pams_pin, coalesce(v.collection_status = 'collected', false) AS sdl_page_available
    FROM v_parcel p LEFT JOIN v_portal v ON p.pams_pin = v.pams_pin""")
def portal_page(t: Tables):
    from doorlens.sources.readers import with_page_state

    return with_page_state(t.v_parcel.select("pams_pin"), t.v_portal)


@query("j12_statewide_same_day", """SELECT s.ordinal, s.municipal_id FROM v_statewide s WHERE NOT EXISTS (
    SELECT 1 FROM (SELECT pams_pin, issue_date AS d FROM v_permit WHERE source = 'SDL'
                   UNION ALL SELECT pams_pin, issue_date FROM v_roof_permit WHERE issue_date IS NOT NULL) AS k
    WHERE k.pams_pin = s.pams_pin AND k.d = s.issue_date)""")
def statewide_same_day(t: Tables):
    t = t.landed()
    return permits.drop_same_day_statewide(t.v_statewide, t.v_portal_permit, t.v_roof_permit).select(
        "ordinal", "municipal_id"
    )


BASE_SQL = """apps AS (SELECT pams_pin, permit_number AS mid, ordinal, work_type, work_description,
               lower(trim(work_type)) IN ('amendment', 'supplement', 'supplemental') AS amends,
               CASE WHEN status IN ('CA and Close Date Issued', 'Closed with Date', 'Certificate (CA) Issued') THEN 'completed'
                    WHEN status = 'Voided by town' THEN 'voided' WHEN status IN ('STALE', 'Permit Expired') THEN 'expired'
                    WHEN status = ' Abandoned' THEN 'abandoned' END AS disposition,
               CAST(strptime(issue_date, '%m/%d/%Y') AS DATE) AS issue_day,
               CAST(strptime(nullif(close_date, ''), '%m/%d/%Y') AS DATE) AS close_day
           FROM v_portal_permit),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY pams_pin, mid ORDER BY amends,
                      CASE WHEN amends THEN ordinal ELSE -ordinal END) AS rn,
                      count(*) FILTER (WHERE amends) OVER (PARTITION BY pams_pin, mid) AS amendments
               FROM apps),
    base AS (SELECT * FROM ranked WHERE rn = 1)"""


@query("a6_project_coalescing", f"""WITH {BASE_SQL} SELECT pams_pin, mid AS municipal_id, work_type, work_description AS
    description, disposition, CAST(issue_day AS STRING) AS issue_date,
    CAST(CASE WHEN disposition = 'completed' THEN close_day END AS STRING) AS completion_date, amendments FROM base""")
def project_coalescing(t: Tables):
    return permits.portal_projects(t.v_portal_permit).select(
        "pams_pin", "municipal_id", "work_type", "description", "disposition",
        F.col("issue_date").cast("string").alias("issue_date"),
        F.col("completion_date").cast("string").alias("completion_date"), "amendments",
    )


ROOF_FILL_SQL = f"""{BASE_SQL},
    roof AS (SELECT pams_pin, municipal_id AS mid, first(nullif(description, '') ORDER BY ordinal) AS description,
                    min(work_type) AS work_type, first(disposition ORDER BY disposition IS NULL, ordinal) AS disposition,
                    first(issue_date ORDER BY issue_date IS NULL, ordinal) AS issue_day
             FROM v_roof_permit GROUP BY pams_pin, municipal_id),
    filled AS (SELECT coalesce(b.pams_pin, r.pams_pin) AS pams_pin, coalesce(b.mid, r.mid) AS mid,
                      coalesce(nullif(b.work_description, ''), r.description) AS description,
                      coalesce(nullif(b.work_type, ''), r.work_type) AS work_type,
                      coalesce(b.disposition, r.disposition) AS disposition,
                      coalesce(b.issue_day, r.issue_day) AS issue_day,
                      CASE WHEN b.disposition = 'completed' THEN b.close_day END AS completed
               FROM base b FULL OUTER JOIN roof r ON b.pams_pin = r.pams_pin AND b.mid = r.mid)"""


@query("j13_roof_enrichment", f"""WITH {ROOF_FILL_SQL} SELECT pams_pin, mid AS municipal_id, description, work_type,
    disposition, CAST(issue_day AS STRING) AS issue_date FROM filled""")
def roof_enrichment(t: Tables):
    t = t.landed()
    none = t.v_statewide.filter(F.lit(False))
    return permits.coalesce_permits(t.v_portal_permit, t.v_roof_permit, none).select(
        "pams_pin", "municipal_id", "description", "work_type", "disposition",
        F.col("issue_date").cast("string").alias("issue_date"),
    )


COALESCED_SQL = f"""{ROOF_FILL_SQL},
    state AS (SELECT pams_pin, municipal_id AS mid, first(description ORDER BY ordinal) AS description,
                     first(issue_date ORDER BY ordinal) AS issue_day,
                     first(completion_date ORDER BY completion_date IS NULL, ordinal) AS completed
              FROM v_statewide GROUP BY pams_pin, municipal_id),
    coalesced AS (SELECT coalesce(f.pams_pin, s.pams_pin) AS pams_pin, coalesce(f.mid, s.mid) AS mid,
                         CASE WHEN f.mid IS NULL THEN s.description ELSE f.description END AS description, f.work_type,
                         f.disposition, f.issue_day, s.issue_day AS statewide_day,
                         coalesce(f.completed, s.completed) AS completed, f.mid IS NOT NULL AS from_portal,
                         s.mid IS NOT NULL AS from_statewide
                  FROM filled f FULL OUTER JOIN state s ON f.pams_pin = s.pams_pin AND f.mid = s.mid)"""


@query("j14_statewide_coalesce", f"""WITH {COALESCED_SQL} SELECT pams_pin, mid AS municipal_id, description, disposition,
    CAST(issue_day AS STRING) AS issue_date, CAST(statewide_day AS STRING) AS statewide_issue_date,
    CAST(completed AS STRING) AS completion_date, from_portal, from_statewide FROM coalesced""")
def statewide_coalesce(t: Tables):
    t = t.landed()
    merged = permits.coalesce_permits(t.v_portal_permit, t.v_roof_permit, t.v_statewide, drop_same_day=False)
    return merged.select(
        "pams_pin", "municipal_id", "description", "disposition",
        *[F.col(c).cast("string").alias(c) for c in ("issue_date", "statewide_issue_date", "completion_date")],
        "from_portal", "from_statewide",
    )


MATCH_SQL = """known AS (SELECT territory_id, replace(akey, 'NORTH', 'N') AS akey, count(*) AS n, min(pams_pin) AS pin
           FROM (SELECT *, {address} AS akey FROM v_parcel_raw) AS r GROUP BY 1, 2),
    lines AS (SELECT v.territory_id, v.ordinal, {portal} AS akey, v.l_partkey, v.description, v.l_suppkey % 2 = 0 AS has_detail
              FROM v_permit v),
    matched AS (SELECT l.*, coalesce(k.n, 0) AS n, k.pin FROM lines l
                LEFT JOIN known k ON l.territory_id = k.territory_id AND l.akey = k.akey)"""


def _match_sql() -> str:
    from doorlens.plans.scalars import PORTAL_KEY_SQL

    return MATCH_SQL.format(address=ADDRESS_SQL, portal=PORTAL_KEY_SQL)


def matched(t: Tables):
    t = t.landed()
    return history.match_permits(t.v_portal_line, t.v_parcel_raw, towns=t.v_town)


@query("j15_match_by_situs", f"""WITH {_match_sql()} SELECT ordinal, CASE n WHEN 0 THEN 'unmatched' WHEN 1 THEN 'matched'
        ELSE 'ambiguous' END AS outcome, CASE WHEN n = 1 THEN pin END AS pams_pin FROM matched""")
def match_by_situs(t: Tables):
    return matched(t).select("ordinal", "outcome", "pams_pin")


@query("j15_ambiguous_candidates", f"""WITH {_match_sql()} SELECT k.territory_id, k.akey AS address_key, r.pams_pin
    FROM known k JOIN (SELECT territory_id, pams_pin, replace({ADDRESS_SQL}, 'NORTH', 'N') AS akey FROM v_parcel_raw) AS r
        ON k.territory_id = r.territory_id AND k.akey = r.akey WHERE k.n > 1""")
def ambiguous_candidates(t: Tables):
    return history.ambiguous_candidates(t.landed().v_parcel_raw)


ENRICHED_SQL = """det AS (SELECT pams_pin, detail_url, arg_max(description, ordinal) AS d FROM v_roof_permit
             GROUP BY pams_pin, detail_url),
    enriched AS (SELECT a.territory_id, a.pams_pin, a.detail_url, a.ordinal, 'property_page' AS source_scope, d.d AS detail
                 FROM v_portal_permit a LEFT JOIN det d ON a.pams_pin = d.pams_pin AND a.detail_url = d.detail_url
                 UNION ALL
                 SELECT r.territory_id, r.pams_pin, r.detail_url, r.ordinal, 'roof_keyword_search_supplement', d.d
                 FROM v_roof_permit r JOIN det d ON r.pams_pin = d.pams_pin AND r.detail_url = d.detail_url
                 WHERE NOT EXISTS (SELECT 1 FROM v_portal_permit a
                                   WHERE a.pams_pin = r.pams_pin AND a.detail_url = r.detail_url))"""


@query("j16_detail_enrichment", f"WITH {ENRICHED_SQL} SELECT pams_pin, detail_url, ordinal, source_scope, detail FROM enriched")
def detail_enrichment(t: Tables):
    t = t.landed()
    return history.enrich_applications(t.v_portal_permit, t.v_roof_permit).select(
        "pams_pin", "detail_url", "ordinal", "source_scope", F.col("roof_detail.description").alias("detail")
    )


_PAGES = """SELECT CASE WHEN k % 59 = 0 THEN '' WHEN k % 61 = 0 THEN 'ZZ_' || pams_pin ELSE pams_pin END AS pams_pin,
       CASE WHEN k % 67 = 0 THEN '9999' ELSE block END AS block, lot,
       CASE WHEN k % 71 = 0 THEN 'https://portal.example/properties/' || block || '/77'
            WHEN k % 73 = 0 THEN 'https://portal.example/elsewhere/1' WHEN k % 2 = 0 THEN ''
            ELSE 'https://portal.example/town/properties/' || block || '/' || lot END AS page_url, k
FROM v_parcel"""


@query("j17_integrity_violations", """SELECT DISTINCT CASE WHEN k % 59 = 0 THEN '' WHEN k % 61 = 0 THEN 'ZZ_' || pams_pin
           ELSE pams_pin END AS pams_pin, violation
    FROM (SELECT *, CASE WHEN k % 59 = 0 THEN 'empty pin' WHEN k % 61 = 0 THEN 'outside territory'
              WHEN k % 67 = 0 THEN 'block/lot mismatch' WHEN k % 71 = 0 THEN 'page url mismatch'
              WHEN k % 73 = 0 THEN 'invalid page url' END AS violation FROM v_parcel) AS v WHERE violation IS NOT NULL
    UNION ALL SELECT CASE WHEN k % 61 = 0 THEN 'ZZ_' || pams_pin ELSE pams_pin END, 'duplicate pin'
    FROM v_parcel WHERE k % 79 = 0 AND k % 59 <> 0""")
def integrity_violations(t: Tables):
    t = t.landed()
    # Large towns have a block 9999: the block that is to be wrong on a page is one that no parcel has.
    pages = t.sql(_PAGES).withColumn("block", F.when(F.col("k") % 67 == 0, F.lit("none")).otherwise(F.col("block")))
    twice = pages.unionByName(pages.filter("k % 79 = 0"))
    return history.integrity_violations(twice, t.v_parcel).distinct()


_SEEN = """SELECT image_ref, CASE WHEN event_id % 3 = 0 THEN 'p1' ELSE 'p2' END AS prompt_version FROM v_response"""


@query("j19_cold_tiles", f"""SELECT image_ref FROM v_tile WHERE image_ref NOT IN (
    SELECT image_ref FROM ({_SEEN}) AS s WHERE prompt_version = 'p1')""")
def cold_tiles(t: Tables):
    return imagery.unseen_tiles(t.v_tile, t.sql(_SEEN), "p1").select("image_ref")


_FRAMES = """SELECT territory_id, pams_pin, k, CASE k % 4 WHEN 0 THEN 'fit_pool' WHEN 1 THEN 'fit_solar'
        WHEN 2 THEN 'fit_condition_decline' ELSE 'fit_lot' END AS type,
       CASE WHEN k % 5 = 0 THEN 'https://tiles.example/export?x=1'
            ELSE 'https://tiles.example/export?bbox=' || CAST(k AS STRING) || '%2C2.5%2C3.0%2C4.0' END AS ref,
       CASE WHEN k % 7 = 0 THEN NULL ELSE CAST(k % 100 AS DOUBLE) / CAST(100 AS DOUBLE) END AS confidence,
       CASE WHEN k % 11 = 0 THEN NULL ELSE '2020-01-01' END AS capture_date
FROM v_parcel"""


@query("j20_attach_frames", f"""SELECT pams_pin, type, CASE WHEN k % 4 = 3 OR k % 5 = 0 OR k % 7 = 0 OR k % 11 = 0 THEN NULL
        ELSE ref END AS image_url FROM ({_FRAMES}) AS f""")
def attach_frames(t: Tables):
    rows = t.sql(_FRAMES)
    frame = F.struct(F.col("ref").alias("image_ref"), "confidence", "capture_date")
    signals = rows.select(*DOOR, *[frame.alias(c) for c in imagery.FRAME_OF.values()])
    return imagery.attach_frames(rows.select(*DOOR, "type"), signals).select(
        "pams_pin", "type", F.get_json_object("imagery", "$.image_url").alias("image_url")
    )


@query("j21_tile_manifest", """SELECT pams_pin, CAST(vintage AS BIGINT) AS vintage, CAST(vintage AS STRING) || '-01-01'
    AS capture_date FROM v_parcel, (VALUES (2015), (2020)) AS v(vintage) WHERE lon IS NOT NULL""")
def tile_manifest(t: Tables):
    return imagery.tile_manifest(t.v_parcel).select("pams_pin", F.col("vintage").cast("bigint").alias("vintage"), "capture_date")


@query("j22_find_doors", f"""WITH firsts AS (SELECT {ADDRESS_SQL} AS akey, arg_min(pams_pin, k) AS pin FROM v_situs GROUP BY 1)
    SELECT r.ordinal, f.pin AS found_pin FROM (SELECT ordinal, {ADDRESS_SQL} AS akey FROM v_permit) AS r
    LEFT JOIN firsts f ON r.akey = f.akey""")
def find_doors(t: Tables):
    t = t.landed()
    asked = t.v_permit.select("ordinal", "k").join(t.v_parcel_raw.select("k", "address"), "k")
    return resolve.find_doors(asked, t.v_situs).select("ordinal", "found_pin")


_TYPO = "replace(replace(replace(replace({a}, 'OAK', 'OAKK'), 'MAIN', 'MIAN'), 'FAWN', 'FAUN'), 'COURT', 'SHORT')"


# Longest matching blocks in SQL: each open range of a pair is cut at its longest common text, until none is left.
_BLOCKS_SQL = """cut AS (
        SELECT known_key, address_key, known_key AS x, address_key AS y FROM (SELECT DISTINCT known_key, address_key FROM pairs) AS p
        UNION ALL
        SELECT known_key, address_key, side.x, side.y FROM (
            SELECT known_key, address_key, unnest([
                {'x': substr(x, 1, pos - 1), 'y': substr(y, 1, strpos(y, piece) - 1)},
                {'x': substr(x, pos + length(piece)), 'y': substr(y, strpos(y, piece) + length(piece))}]) AS side
            FROM (SELECT *, substr(x, pos, size) AS piece FROM (SELECT *, -best.back AS pos, best.size AS size FROM (
                SELECT *, list_max(list_transform(range(1, length(x) + 1), lambda i: {'size': len(list_filter(
                    range(1, length(x) - i + 2), lambda k: contains(y, substr(x, i, k)))), 'back': -i})) AS best FROM cut) AS b) AS c) AS d
            WHERE size > 0) AS e WHERE side.x <> '' AND side.y <> ''),
    likeness AS (SELECT known_key, address_key, 2.0 * sum(list_max(list_transform(range(1, length(x) + 1), lambda i: len(list_filter(
            range(1, length(x) - i + 2), lambda k: contains(y, substr(x, i, k)))))))
            / CAST(length(known_key) + length(address_key) AS DOUBLE) AS likeness FROM cut GROUP BY known_key, address_key)"""


@query("j23_suggest_doors", f"""WITH RECURSIVE q AS (SELECT DISTINCT territory_id, {_TYPO.format(a=ADDRESS_SQL)} AS address_key FROM v_situs),
    known AS (SELECT DISTINCT territory_id AS t, akey AS known_key FROM (SELECT territory_id, {ADDRESS_SQL} AS akey FROM v_situs) AS x),
    pairs AS (SELECT territory_id, address_key, known_key FROM q JOIN known ON territory_id = t),
    {_BLOCKS_SQL},
    best AS (SELECT p.*, likeness, row_number() OVER (PARTITION BY territory_id, p.address_key ORDER BY likeness DESC, p.known_key DESC) AS rn
             FROM pairs p JOIN likeness l ON p.known_key = l.known_key AND p.address_key = l.address_key WHERE likeness >= 0.6)
    SELECT territory_id, address_key, known_key AS suggested_key, round(likeness, 6) AS likeness FROM best WHERE rn = 1""")
def suggest_doors(t: Tables):
    typed = t.v_situs.select("territory_id", F.expr(_TYPO.format(a="address")).alias("address"))
    return suggest.suggest_doors(typed, t.v_situs).withColumn("likeness", F.round("likeness", 6))


@query("j24_talk_tracks", """SELECT pams_pin, CASE WHEN kind IN ('fit_pool', 'fit_solar')
            THEN 'Do you have a pool or anything out back?'
        WHEN kind IN ('fit_lot', 'fit_home_age') THEN 'How old''s the house, do you know?'
        WHEN kind = 'mover_recency' THEN 'Have you been here long?'
        WHEN kind = 'project_active' THEN 'Who do you usually call when something on the house needs doing?'
        ELSE 'Are you the one who deals with the house stuff, or is that somebody else?' END AS hook
    FROM (SELECT pams_pin, CASE k % 7 WHEN 0 THEN 'fit_pool' WHEN 1 THEN 'fit_solar' WHEN 2 THEN 'fit_lot'
              WHEN 3 THEN 'mover_recency' WHEN 4 THEN 'project_active' WHEN 5 THEN 'brand_new_type' END AS kind FROM v_situs) AS s""")
def talk_tracks(t: Tables):
    from doorlens.operators.route import talk_tracks as tracks

    kinds = F.create_map(*[F.lit(x) for pair in enumerate(
        ("fit_pool", "fit_solar", "fit_lot", "mover_recency", "project_active", "brand_new_type")) for x in pair])
    stops = t.v_situs.withColumn("evidence_type", F.try_element_at(kinds, (F.col("k") % 7).cast("int")))
    return tracks(stops, "Acme Home").select("pams_pin", F.substring_index("talk_track", " this week. ", -1).alias("hook"))


@query("j26_source_precedence", f"""WITH own AS (SELECT p.pams_pin, {deed_sql('r.deed_date')} AS d, r.sale_price, r.sales_code
           FROM v_parcel p JOIN v_parcel_raw r ON p.k = r.k),
    every AS (SELECT pams_pin, 1 AS rank, 'SR1A' AS source, sale_day AS d, sale_price FROM v_sale
              WHERE source = 'SR1A' AND deed_date <> ''
        UNION ALL SELECT pams_pin, 2, 'MODIV', d, sale_price FROM own WHERE d IS NOT NULL AND sale_price > 0
        UNION ALL SELECT pams_pin, 3, 'SDL', CAST(try_strptime(last_sale_date, '%m/%d/%Y') AS DATE), k % 700 * 1000.0
                  FROM v_portal WHERE collection_status = 'collected' AND k % 4 <> 0 AND k % 700 > 0
                    AND try_strptime(last_sale_date, '%m/%d/%Y') IS NOT NULL)
    SELECT pams_pin, source, CAST(d AS STRING) AS sale_day, CAST(sale_price AS DOUBLE) AS sale_price FROM every e
    WHERE rank = (SELECT min(rank) FROM every m WHERE m.pams_pin = e.pams_pin)""")
def source_precedence(t: Tables):
    t = t.landed()
    register = t.v_sale.filter("source = 'SR1A'")
    return facts.preferred_sales(register, t.v_parcel_raw, t.v_portal, AS_OF).select(
        "pams_pin", "source", F.col("sale_day").cast("string").alias("sale_day"), "sale_price"
    )


@query("j26_assessed_value", """SELECT p.pams_pin, CASE WHEN p.net_value > 0 THEN p.net_value
        WHEN v.collection_status = 'collected' THEN CAST(v.k % 900 * 1000 + 500 AS DOUBLE) ELSE -1.0 END AS assessed_value
    FROM v_parcel p LEFT JOIN v_portal v ON p.pams_pin = v.pams_pin""")
def assessed_value(t: Tables):
    pages = t.v_portal.select("pams_pin", "assessed_total", (F.col("collection_status") == "collected").alias("exact"))
    value = facts.assessed_value(F.col("net_value"), F.col("assessed_total"), F.coalesce("exact", F.lit(False)))
    return t.v_parcel.join(pages, "pams_pin", "left").select(
        "pams_pin", F.coalesce(value, F.lit(-1.0)).alias("assessed_value")
    )


# --- set operations ---------------------------------------------------------------------------


@query("u4_accounting_partition", """SELECT mun, CAST(0 AS BIGINT) AS unaccounted, CAST(0 AS BIGINT) AS misfiled
    FROM v_permit_raw GROUP BY mun""")
def accounting_partition(t: Tables):
    counts = resolve.permit_accounting(t.v_permit_raw, routed(t))
    placed = F.col("permits_in_territory") + F.col("permits_out_of_territory") + F.col("permits_out_of_window")
    filed = F.col(resolve.BUCKET_MATCHED) + F.col(resolve.BUCKET_PLACEHOLDER) + F.col(resolve.BUCKET_UNMATCHED)
    return counts.select("mun", (F.col("permits_total") - placed).alias("unaccounted"),
                         (F.col("permits_in_window") - filed).alias("misfiled"))


@query("u5_duplicate_addresses", f"WITH {_match_sql()} SELECT territory_id, akey AS address_key, n AS doors FROM known WHERE n > 1")
def duplicate_addresses(t: Tables):
    return history.duplicate_addresses(t.v_parcel_raw)


