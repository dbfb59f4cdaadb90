"""Source rules over whole tables (S), and the projections sinks write (K)."""

from __future__ import annotations

from pyspark.sql import functions as F

from doorlens.operators import imagery
from doorlens.plans.analogs import AS_OF, AS_OF_SQL, Tables
from doorlens.plans.registry import query
from doorlens.sources import readers


_PAGES = """SELECT CASE WHEN l_linenumber = 4 THEN NULL ELSE CAST(l_orderkey AS BIGINT) END AS object_id,
    CAST(l_partkey AS BIGINT) AS page, (CAST(l_orderkey AS BIGINT) * 10 + l_linenumber) * 1000000 + (l_partkey * 131 + l_suppkey * 7) % 1000000 AS ordinal FROM lineitem"""


@query("s2_page_union", f"""WITH pages_ AS ({_PAGES}), ranked AS (SELECT *, row_number() OVER (PARTITION BY object_id,
        CASE WHEN object_id IS NULL THEN (page, ordinal) END ORDER BY page, ordinal) AS rn FROM pages_)
    SELECT object_id, page, ordinal FROM ranked WHERE rn = 1""")
def page_union(t: Tables):
    return readers.union_pages(t.sql(_PAGES), "object_id")


_RAW_PERMIT = """SELECT record_id AS recordid, block, lot,
       CASE ordinal % 5 WHEN 0 THEN 'not a date' WHEN 1 THEN NULL
            ELSE CAST(permit_date AS STRING) || 'T00:00:00.000' END AS permitdate,
       CASE WHEN ordinal % 3 = 0 THEN '  ' ELSE ' Alteration ' END AS permittypedesc,
       CASE WHEN ordinal % 2 = 0 THEN ' ALT' ELSE NULL END AS permittype,
       CASE WHEN ordinal % 4 = 0 THEN 'unknown' ELSE CAST(CAST(floor(cost) AS BIGINT) AS STRING) END AS constcost
FROM v_permit_raw"""


@query("s3_read_permits", f"""WITH raw AS ({_RAW_PERMIT})
    SELECT recordid AS record_id, block, lot,
           coalesce(nullif(trim(permittypedesc), ''), trim(coalesce(permittype, ''))) AS type,
           CAST(try_cast(substr(permitdate, 1, 10) AS DATE) AS STRING) AS permit_date,
           coalesce(try_cast(constcost AS DOUBLE), 0.0) AS cost
    FROM raw""")
def read_permits(t: Tables):
    return readers.distil_permits(t.sql(_RAW_PERMIT)).withColumn("permit_date", F.col("permit_date").cast("string"))


@query("s4_derived_filters", f"""SELECT municipal_id, ordinal, CAST(issue_date AS STRING) AS issue_date FROM v_permit
    WHERE mun = '0203' AND issue_date >= {AS_OF_SQL} - 730""")
def derived_filters(t: Tables):
    recent = F.col("issue_date") >= F.date_sub(F.lit(AS_OF), 730)
    return t.v_permit.filter((F.col("mun") == "0203") & recent).select(
        "municipal_id", "ordinal", F.col("issue_date").cast("string").alias("issue_date")
    )


_SLICED = """SELECT ordinal, trim(substr(line, 1, 2)) || trim(substr(line, 3, 2)) AS mun,
       trim(substr(line, 35, 3)) AS nu_code, trim(substr(line, 38, 9)) AS rep, trim(substr(line, 47, 9)) AS ver,
       trim(substr(line, 339, 6)) AS deed_date, trim(substr(line, 345, 6)) AS date_recorded,
       trim(substr(line, 351, 5)) AS b, trim(substr(line, 356, 4)) AS bs, trim(substr(line, 360, 5)) AS l,
       trim(substr(line, 365, 4)) AS ls, trim(substr(line, 620, 5)) AS qualifier, trim(substr(line, 627, 3)) AS prop_class,
       trim(substr(line, 653, 4)) AS yb
FROM v_sr1a_line WHERE length(line) = 663"""
_SALES_SQL = f"""SELECT ordinal, mun, nu_code, deed_date, date_recorded, qualifier, prop_class,
       CASE WHEN b = '' THEN '' WHEN ltrim(b, '0') = '' THEN '0' ELSE ltrim(b, '0') END
           || CASE WHEN bs = '' THEN '' ELSE '.' || bs END AS block,
       CASE WHEN l = '' THEN '' WHEN ltrim(l, '0') = '' THEN '0' ELSE ltrim(l, '0') END
           || CASE WHEN ls = '' THEN '' ELSE '.' || ls END AS lot,
       CASE WHEN regexp_matches(ver, '^0*[1-9][0-9]*$') THEN CAST(ver AS DOUBLE)
            WHEN regexp_matches(rep, '^0*[1-9][0-9]*$') THEN CAST(rep AS DOUBLE) ELSE 0.0 END AS sale_price,
       CASE WHEN yb = '' THEN 0 ELSE CAST(yb AS BIGINT) END AS year_built
FROM ({_SLICED}) AS cut"""


def _sales(t: Tables, muns=None):
    t = t.landed()
    return readers.distil_sales(t.v_sr1a_line.drop("k"), muns).withColumn(
        "year_built", F.col("year_built").cast("bigint")
    ).drop("prop_loc")


@query("s5_read_sr1a", f"SELECT * FROM ({_SALES_SQL}) AS s WHERE mun = '0202'")
def read_sr1a(t: Tables):
    return _sales(t, ["0202"])


@query("c5_sr1a_block_lot", f"SELECT ordinal, block, lot FROM ({_SALES_SQL}) AS s")
def sr1a_block_lot(t: Tables):
    return _sales(t).select("ordinal", "block", "lot")


@query("c6_sr1a_price", f"SELECT ordinal, sale_price FROM ({_SALES_SQL}) AS s")
def sr1a_price(t: Tables):
    return _sales(t).select("ordinal", "sale_price")


@query("s9_acs_estimate", """SELECT geoid, CASE WHEN try_cast(income AS DOUBLE) > -1000000 THEN try_cast(income AS DOUBLE)
    ELSE -1.0 END AS median_hh_income FROM v_acs""")
def acs_estimate(t: Tables):
    return t.v_acs.select("geoid", F.coalesce(readers.acs_estimate(F.col("income")), F.lit(-1.0)).alias("median_hh_income"))


@query("s10_dual_income", "SELECT geoid, coalesce(round(dual_income_pct, 6), -1.0) AS dual_income_pct FROM v_acs_stats")
def dual_income(t: Tables):
    share = readers.dual_income(F.col("couples"), F.col("both_a"), F.col("both_b"), F.col("both_c"))
    return t.v_acs.select("geoid", F.coalesce(F.round(share, 6), F.lit(-1.0)).alias("dual_income_pct"))


# The check rebuilds what each answer holds from the row it was written from, not by parsing it again.
_ANSWERS = """SELECT r.event_id, r.batch_id, CASE WHEN r.k100 % 11 = 5 AND r.signal <> 'error' THEN 'no-such-tile'
           WHEN r.k100 % 11 = 5 AND r.k100 % 4 = 3 THEN 'no-such-tile' ELSE r.image_ref END AS image_ref,
       r.signal = 'error' AND r.k100 % 4 IN (0, 1) AS no_envelope,
       CASE WHEN r.signal <> 'error' THEN r.signal WHEN r.k100 % 4 = 2 THEN 'pool' ELSE 'garage' END AS signal,
       CASE WHEN r.signal = 'error' AND r.k100 % 4 = 2 THEN NULL ELSE r.k100 % 7 <> 0 END AS present,
       CASE WHEN r.signal = 'error' AND r.k100 % 4 = 2 THEN 0.9 WHEN r.k100 = 99 THEN 1.5
            ELSE CAST(r.k100 AS DOUBLE) / 100.0 END AS confidence
FROM v_response r"""


@query("s14_vision_envelopes", f"""SELECT event_id AS ordinal, image_ref, signal, present,
       round(confidence, 6) AS confidence FROM ({_ANSWERS}) AS a WHERE NOT no_envelope""")
def vision_envelopes(t: Tables):
    t = t.landed()
    rows, _ = imagery.parse_answers(t.v_answer)
    return rows.select("ordinal", "image_ref", "signal", "present", F.round("confidence", 6).alias("confidence"))


_CONTRACT_SQL = f"""SELECT event_id AS ordinal, CASE WHEN no_envelope THEN NULL ELSE a.image_ref END AS image_ref,
       CASE WHEN no_envelope THEN 'response was not a {{''detections'': [...]}} JSON object'
            WHEN t.pams_pin IS NULL OR b.image_ref IS NULL THEN 'detection names an image_ref that was not in this batch'
            WHEN signal = 'garage' THEN 'unknown vision signal'
            WHEN present IS NULL THEN 'present must be a bool'
            WHEN confidence > 1.0 THEN 'confidence must be a number within [0, 1]' END AS reason,
       t.pams_pin, t.capture_date, a.signal, a.present, a.confidence
FROM ({_ANSWERS}) AS a LEFT JOIN v_tile t ON t.image_ref = a.image_ref
    LEFT JOIN (SELECT DISTINCT batch_id, image_ref FROM v_batch) AS b ON b.batch_id = a.batch_id AND b.image_ref = a.image_ref"""


@query("s15_detection_contract", f"SELECT ordinal, image_ref, reason FROM ({_CONTRACT_SQL}) AS c WHERE reason IS NOT NULL")
def detection_contract(t: Tables):
    t = t.landed()
    _, quarantine = imagery.detections_from(t.v_answer, t.v_tile, t.v_batch)
    return quarantine.select("ordinal", "image_ref", "reason")


@query("j18_detection_provenance", f"""SELECT ordinal, image_ref, pams_pin, capture_date, signal, present,
       round(confidence, 6) AS confidence FROM ({_CONTRACT_SQL}) AS c WHERE reason IS NULL""")
def detection_provenance(t: Tables):
    t = t.landed()
    valid, _ = imagery.detections_from(t.v_answer, t.v_tile, t.v_batch)
    return valid.select("ordinal", "image_ref", "pams_pin", "capture_date", "signal", "present",
                        F.round("confidence", 6).alias("confidence"))


@query("u3_stale_versions", "SELECT DISTINCT score_contract_version FROM v_door_score WHERE score_contract_version <> 'v2'")
def stale_versions(t: Tables):
    return readers.stale_versions(t.v_door_score)


