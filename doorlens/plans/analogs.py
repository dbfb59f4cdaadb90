"""Property-record tables derived from the given star-schema tables.

Each view is one SQL text that Spark and DuckDB both accept, so a Spark result and
its check start from the same rows. Every view reads whole tables and grows with
them. Spark reads the Parquet files in place; the check has the tables as views.
"""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import DataFrame, SparkSession

from doorlens.session import land, sized_by_rows

AS_OF = dt.date(2001, 6, 30)
AS_OF_SQL = "DATE '2001-06-30'"

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

# Street names and suffix spellings of the made-up addresses.
_STREETS = ("OAK", "ELM", "MAIN", "FAWN HILL", "E CEDAR", "COURT", "NORTH PINE", "MOMAR")
_SUFFIXES = ("STREET", "St.", "AVE", "avenue", "Terrace")


def _pick(expression: str, values) -> str:
    whens = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values))
    return f"CASE {expression} {whens} END"


VIEWS = {
    "v_parcel": """
        SELECT territory_id, '02' || lpad(CAST(territory_id AS STRING), 2, '0') AS mun,
               '02' || lpad(CAST(territory_id AS STRING), 2, '0') || '_' || CAST(block AS STRING) || '_'
                   || CAST(lot AS STRING) AS pams_pin,
               k, CAST(block AS STRING) AS block, CAST(lot AS STRING) AS lot,
               CASE WHEN seg = 'AUTOMOBILE' THEN '4A' ELSE '2' END AS prop_class,
               bal * CAST(100 AS DOUBLE) AS net_value,
               CAST(CASE WHEN k % 29 = 0 THEN 0 ELSE 1900 + k % 100 END AS INT) AS yr_constr,
               CAST(k % 97 AS DOUBLE) / CAST(100 AS DOUBLE) AS calc_acre,
               CASE WHEN k % 53 = 0 THEN NULL
                    ELSE CAST(-74.2 AS DOUBLE) + CAST(k * 7919 % 1000 AS DOUBLE) / CAST(10000 AS DOUBLE) END AS lon,
               CASE WHEN k % 53 = 0 THEN NULL
                    ELSE CAST(41.0 AS DOUBLE) + CAST(k * 104729 % 1009 AS DOUBLE) / CAST(10000 AS DOUBLE) END AS lat,
               CAST(nk AS STRING) AS geoid
        FROM (SELECT c_custkey AS k, c_acctbal AS bal, c_mktsegment AS seg, c_nationkey AS nk,
                     CAST(CASE WHEN c_custkey % 200 = 0 THEN 5 ELSE n_regionkey END AS BIGINT) AS territory_id,
                     CAST(floor(c_custkey / 8) AS BIGINT) AS block, c_custkey % 8 + 1 AS lot
              FROM customer JOIN nation ON c_nationkey = n_nationkey) AS base""",
    "v_anchor": """
        SELECT territory_id, CAST(-74.15 AS DOUBLE) AS anchor_lon, CAST(41.05 AS DOUBLE) AS anchor_lat,
               CAST(40 + 40 * territory_id AS INT) AS target
        FROM (SELECT DISTINCT territory_id FROM v_parcel) AS t""",
    "v_town": """
        SELECT territory_id, CASE territory_id WHEN 0 THEN 'Ramsey' WHEN 1 THEN 'Mahwah' WHEN 2 THEN 'Upper St. Mary (East)'
                   ELSE 'Town ' || CAST(territory_id AS STRING) END AS town,
               'NJ' AS state, '07' || lpad(CAST(territory_id * 13 + 430 AS STRING), 3, '0') AS zip
        FROM v_anchor""",
    "v_parcel_raw": f"""
        SELECT territory_id, mun, pams_pin, k, prop_class,
               ' 0' || block AS block,
               CASE WHEN k % 5 = 0 THEN '1.' WHEN k % 3 = 0 THEN lot || '.0' WHEN k % 3 = 1 THEN ' 0' || lot
                    ELSE lot || '.50' END AS lot,
               CASE WHEN k % 31 = 0 THEN ' c' || lpad(CAST(k % 50 AS STRING), 4, '0') ELSE '' END AS qualifier,
               CAST(k % 200 + 1 AS STRING) || ' '
                   || {_pick('k % 8', _STREETS)} || ' ' || {_pick('k % 5', _SUFFIXES)}
                   || CASE WHEN k % 17 = 0 THEN ', Apt 3B' WHEN k % 19 = 0 THEN ' #2' ELSE '' END AS address,
               CASE WHEN k % 23 = 0 THEN '' ELSE '0' || CAST(7000 + k % 500 AS STRING) END AS zip5,
               CASE WHEN k % 7 = 0 THEN NULL WHEN k % 41 = 0 THEN '991332'
                    ELSE replace(substr(CAST(DATE '1999-01-01' + CAST(k % 1100 AS INT) AS STRING), 3, 8), '-', '')
               END AS deed_date,
               CAST(k % 13 * 50000 AS DOUBLE) AS sale_price,
               CASE WHEN k % 37 = 0 THEN '26' ELSE '' END AS sales_code, k AS territory_rank
        FROM v_parcel""",
    "v_permit": """
        SELECT p.territory_id, p.mun, p.pams_pin, p.k, p.block, p.lot,
               CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING) AS municipal_id,
               (CAST(l_orderkey AS BIGINT) * 10 + l_linenumber) * 1000000 + (l_partkey * 131 + l_suppkey * 7) % 1000000
                   AS ordinal,
               issue_date, l_quantity, l_extendedprice AS cost,
               CASE l_returnflag WHEN 'R' THEN 'completed' WHEN 'A' THEN NULL
                    ELSE CASE l_partkey % 3 WHEN 0 THEN 'voided' WHEN 1 THEN 'expired' ELSE 'administrative' END
               END AS disposition,
               CASE l_linestatus WHEN 'F' THEN 'SDL' ELSE 'statewide' END AS source,
               CASE WHEN l_returnflag = 'R' AND l_linenumber % 2 = 1 THEN issue_date + CAST(l_quantity AS INT) END
                   AS completion_date,
               CASE p_type WHEN 'ECONOMY' THEN 'roof replacement' WHEN 'SMALL' THEN 'roof repair'
                    WHEN 'MEDIUM' THEN 'in-ground pool' WHEN 'PROMO' THEN 'solar panels'
                    WHEN 'LARGE' THEN 'siding' ELSE p_name END AS description,
               p_type, l_partkey, l_orderkey, l_linenumber, l_suppkey
        FROM (SELECT *, CAST(l_shipdate AS DATE) + CASE WHEN l_partkey % 5 = 0 THEN 0 ELSE -4000 END AS issue_date
              FROM lineitem) AS line
             JOIN orders ON l_orderkey = o_orderkey
             JOIN part ON l_partkey = p_partkey
             JOIN v_parcel p ON p.k = o_custkey""",
    "v_permit_raw": """
        SELECT v.territory_id, v.mun, CAST(v.ordinal AS STRING) AS record_id, v.ordinal, v.issue_date AS permit_date,
               CASE WHEN v.l_partkey % 37 = 0 THEN '0000' WHEN v.l_partkey % 41 = 0 THEN '99999'
                    ELSE r.block END AS block,
               CASE WHEN v.l_partkey % 37 = 0 THEN '00' WHEN v.l_partkey % 43 = 0 OR v.l_partkey % 47 = 0 THEN '999'
                    ELSE r.lot END AS lot,
               CASE WHEN v.l_partkey % 43 = 0 THEN CASE WHEN v.ordinal % 3 = 0 THEN '1 NOWHERE RD' ELSE r.address END
               END AS address, v.cost, v.k
        FROM v_permit v JOIN v_parcel_raw r ON v.k = r.k""",
    "v_sale": """
        SELECT p.territory_id, p.mun, p.pams_pin, p.k, o_orderkey AS ordinal, r.block, r.lot, r.qualifier,
               CASE WHEN o_orderkey % 97 = 0 THEN ''
                    ELSE replace(substr(CAST(CAST(o_orderdate AS DATE) AS STRING), 3, 8), '-', '') END AS deed_date,
               replace(substr(CAST(CAST(o_orderdate AS DATE) + 14 AS STRING), 3, 8), '-', '') AS date_recorded,
               CAST(o_orderdate AS DATE) AS sale_day,
               CASE WHEN o_orderkey % 11 = 0 THEN CAST(1 AS DOUBLE) WHEN o_orderkey % 13 = 0 THEN CAST(100 AS DOUBLE)
                    ELSE o_totalprice END AS sale_price,
               CASE WHEN o_orderpriority = '1-URGENT' THEN '26' ELSE '' END AS nu_code,
               CASE o_orderkey % 5 WHEN 0 THEN 'MODIV' WHEN 1 THEN 'SDL' ELSE 'SR1A' END AS source
        FROM orders JOIN v_parcel p ON p.k = o_custkey JOIN v_parcel_raw r ON r.k = p.k""",
    "v_sr1a_line": """
        SELECT ordinal, k,
               substr(rpad(substr(mun, 1, 4), 34, ' ') || rpad(nu_code, 3, ' ')
                   || lpad(CAST(CAST(floor(sale_price) AS BIGINT) AS STRING), 9, '0')
                   || CASE WHEN ordinal % 7 = 0 THEN '000000000'
                           ELSE lpad(CAST(CAST(floor(sale_price) AS BIGINT) + 5 AS STRING), 9, '0') END
                   || rpad('', 51, ' ') || rpad('', 191, 'X')
                   || rpad('', 41, ' ') || rpad(deed_date, 6, ' ') || date_recorded
                   || lpad(CAST(CAST(floor(k / 8) AS BIGINT) AS STRING), 5, '0') || '    '
                   || lpad(CAST(k % 8 + 1 AS STRING), 5, '0')
                   || CASE WHEN k % 3 = 2 THEN '50  ' ELSE '    ' END
                   || rpad('', 251, ' ') || rpad(upper(trim(qualifier)), 5, ' ') || '  ' || '2  '
                   || rpad('', 23, ' ') || CASE WHEN k % 29 = 0 THEN '    ' ELSE CAST(1900 + k % 100 AS STRING) END
                   || rpad('', 7, ' '), 1, CASE WHEN ordinal % 101 = 0 THEN 662 ELSE 663 END) AS line
        FROM v_sale""",
    "v_rental": """
        SELECT p.territory_id, p.pams_pin, CAST(o_orderdate AS DATE) AS reg_date
        FROM orders JOIN v_parcel p ON p.k = o_custkey WHERE o_orderstatus = 'P' AND o_orderpriority = '5-LOW'""",
    "v_acs": """
        SELECT CAST(n_nationkey AS STRING) AS geoid,
               CASE WHEN n_nationkey = 24 THEN 'N/A' ELSE CAST(1000 AS STRING) END AS couples,
               CAST(100 + n_nationkey * 10 AS STRING) AS both_a, CAST(n_nationkey * 5 AS STRING) AS both_b,
               CAST(n_nationkey * 5 AS STRING) AS both_c,
               CASE WHEN n_nationkey = 23 THEN '-666666666' ELSE CAST(50000 + n_nationkey * 1000 AS STRING) END AS income
        FROM nation""",
    "v_acs_stats": """
        SELECT geoid, CASE WHEN geoid = '24' THEN CAST(NULL AS DOUBLE)
                      ELSE (CAST(100 AS DOUBLE) + CAST(geoid AS DOUBLE) * CAST(20 AS DOUBLE)) / CAST(1000 AS DOUBLE)
                      END AS dual_income_pct
        FROM v_acs""",
    "v_block_group": """
        SELECT 'BG' || lpad(CAST(n_nationkey AS STRING), 2, '0') AS geoid, CAST(n_nationkey AS BIGINT) AS ordinal,
               CAST(-74.2 AS DOUBLE) + CAST(n_nationkey % 5 AS DOUBLE) * CAST(0.02 AS DOUBLE) AS min_x,
               CAST(-74.2 AS DOUBLE) + CAST(n_nationkey % 5 + 1 AS DOUBLE) * CAST(0.02 AS DOUBLE) AS max_x,
               CAST(41.0 AS DOUBLE) + floor(n_nationkey / 5) * CAST(0.02 AS DOUBLE) AS min_y,
               CAST(41.0 AS DOUBLE) + (floor(n_nationkey / 5) + 1) * CAST(0.02 AS DOUBLE) AS max_y
        FROM nation""",
    "v_tile": """
        SELECT territory_id, pams_pin, 2015 AS vintage, 'tile-' || CAST(k AS STRING) || '-2015' AS image_ref,
               '2015-01-01' AS capture_date FROM v_parcel WHERE lon IS NOT NULL
        UNION ALL
        SELECT territory_id, pams_pin, 2020 AS vintage, 'tile-' || CAST(k AS STRING) || '-2020' AS image_ref,
               '2020-01-01' AS capture_date FROM v_parcel WHERE lon IS NOT NULL""",
    "v_response": """
        SELECT event_id, 'batch-' || CAST(user_id AS STRING) AS batch_id, event_id AS ordinal,
               'tile-' || CAST(user_id AS STRING) || '-' || CASE WHEN event_id % 2 = 0 THEN '2015' ELSE '2020' END
                   AS image_ref,
               CASE event_type WHEN 'view' THEN 'pool' WHEN 'click' THEN 'solar' WHEN 'purchase' THEN 'condition_good'
                    WHEN 'signup' THEN 'condition_poor' ELSE 'error' END AS signal,
               CAST(replace(replace(props, '{"k": ', ''), '}', '') AS INT) AS k100
        FROM events""",
    "v_answer": """
        SELECT event_id, batch_id, ordinal,
               CASE WHEN signal = 'error' AND k100 % 4 = 0 THEN 'I could not read this tile.'
                    WHEN signal = 'error' AND k100 % 4 = 1 THEN '[{"image_ref": "' || image_ref || '"}]'
                    WHEN signal = 'error' AND k100 % 4 = 2 THEN '{"detections": [{"image_ref": "' || image_ref
                        || '", "signal": "pool", "present": "yes", "confidence": 0.9}]}'
                    ELSE CASE WHEN k100 % 10 = 3 THEN '```json' || chr(10) ELSE '' END
                        || '{"detections": [{"image_ref": "' || CASE WHEN k100 % 11 = 5 THEN 'no-such-tile' ELSE image_ref END
                        || '", "signal": "' || CASE WHEN signal = 'error' THEN 'garage' ELSE signal END
                        || '", "present": ' || CASE WHEN k100 % 7 = 0 THEN 'false' ELSE 'true' END
                        || ', "confidence": ' || CASE WHEN k100 = 99 THEN '1.5'
                             ELSE '0.' || lpad(CAST(k100 AS STRING), 2, '0') END || '}]}'
                        || CASE WHEN k100 % 10 = 3 THEN chr(10) || '```' ELSE '' END END AS response
        FROM v_response""",
    "v_batch": """
        SELECT DISTINCT batch_id, image_ref FROM v_response WHERE batch_id NOT LIKE '%7' OR image_ref LIKE '%-2015'
        UNION ALL SELECT DISTINCT batch_id, 'tile-1-2015' AS image_ref FROM v_response WHERE batch_id LIKE '%3'""",
    "v_detection": """
        SELECT r.batch_id, r.ordinal, t.territory_id, t.pams_pin, r.image_ref, t.capture_date, r.signal,
               (r.k100 % 7 <> 0) AS present, CAST(r.k100 AS DOUBLE) / CAST(100 AS DOUBLE) AS confidence
        FROM v_response r JOIN v_tile t ON r.image_ref = t.image_ref
        WHERE r.signal <> 'error' AND r.k100 < 99""",
    "v_outcome": """
        SELECT CASE WHEN event_id % 101 = 0 THEN ' ' ELSE 'door-' || CAST(user_id AS STRING) END AS door_id,
               CASE WHEN event_id % 103 = 0 THEN 'yesterday'
                    ELSE substr(CAST(ts AS STRING), 1, 19) END AS attempt_time,
               CASE WHEN event_id % 107 = 0 THEN '' ELSE 'v2' END AS score_contract_version,
               CAST(replace(replace(props, '{"k": ', ''), '}', '') AS INT)
                   + CASE WHEN event_id % 109 = 0 THEN 200 ELSE 0 END AS attempt_score,
               CASE event_type WHEN 'view' THEN 'receptive_conversation' WHEN 'click' THEN 'not_receptive'
                    WHEN 'error' THEN 'hung_up' ELSE 'no_answer' END AS primary_outcome,
               CASE WHEN event_id % 113 = 0 THEN NULL ELSE event_id % 3 = 0 END AS follow_up_requested,
               event_id % 7 = 0 AS service_booked, event_id
        FROM events""",
    "v_label": """
        SELECT event_id, 'tile-' || CAST(user_id AS STRING) AS image_ref,
               (event_id % 10 < 7) AS actual,
               (CAST(replace(replace(props, '{"k": ', ''), '}', '') AS INT) >= 60) AS predicted,
               (event_id % 10 = 9) AS probe
        FROM events WHERE event_type IN ('view', 'click')""",
    "v_spend": """
        SELECT event_type AS source, CAST(1 + event_id % 4 AS BIGINT) AS units, value AS usd FROM events""",
    "v_portal": """
        SELECT p.territory_id, p.pams_pin, p.k, p.lon, p.lat,
               CASE WHEN p.k % 6 = 0 THEN 'not_collected' ELSE 'collected' END AS collection_status,
               '$' || CAST(CAST(p.k % 900 AS BIGINT) AS STRING) || ',500' AS assessed_total,
               CAST(1 + p.k % 12 AS STRING) || '/' || CAST(1 + p.k % 31 AS STRING) || '/' || CAST(1990 + p.k % 12 AS STRING)
                   AS last_sale_date,
               CASE WHEN p.k % 4 = 0 THEN '$' ELSE '$' || CAST(p.k % 700 AS STRING) || '000' END AS last_sale_price
        FROM v_parcel p""",
    "v_portal_permit": """
        SELECT territory_id, pams_pin, ordinal, municipal_id AS permit_number,
               CASE WHEN l_partkey % 7 = 0 THEN 'Amendment' WHEN l_partkey % 11 = 0 THEN ' supplement ' ELSE 'Alteration'
               END AS work_type,
               CASE WHEN l_partkey % 3 = 0 THEN '' ELSE description END AS work_description,
               CASE l_orderkey % 9 WHEN 0 THEN 'CA and Close Date Issued' WHEN 1 THEN 'Closed with Date'
                    WHEN 2 THEN 'Certificate (CA) Issued' WHEN 3 THEN 'Voided by town' WHEN 4 THEN 'STALE'
                    WHEN 5 THEN ' Abandoned' WHEN 6 THEN 'Permit Expired' WHEN 7 THEN '' ELSE 'Finals Passed' END AS status,
               CAST(extract(month FROM issue_date) AS STRING) || '/' || CAST(extract(day FROM issue_date) AS STRING)
                   || '/' || CAST(extract(year FROM issue_date) AS STRING) AS issue_date,
               CASE WHEN l_orderkey % 2 = 0 THEN '' ELSE CAST(extract(month FROM issue_date) AS STRING) || '/28/'
                   || CAST(extract(year FROM issue_date) AS STRING) END AS close_date,
               'https://portal.example/permit/' || municipal_id AS detail_url
        FROM v_permit WHERE source = 'SDL'""",
    "v_roof_permit": """
        SELECT territory_id, pams_pin, ordinal, municipal_id, 'https://portal.example/permit/' || municipal_id
                   || CASE WHEN l_suppkey % 4 = 0 THEN '-old' ELSE '' END AS detail_url,
               description, 'Alteration' AS work_type,
               CASE WHEN l_orderkey % 4 = 0 THEN 'completed' END AS disposition,
               CASE WHEN l_orderkey % 3 > 0 THEN issue_date END AS issue_date
        FROM v_permit WHERE description LIKE '%roof%' AND l_quantity > 25""",
    "v_statewide": """
        SELECT territory_id, pams_pin, ordinal,
               CASE WHEN l_suppkey % 5 = 0 THEN municipal_id || '-S' ELSE municipal_id END AS municipal_id,
               description, issue_date, completion_date
        FROM v_permit WHERE source = 'statewide' OR l_quantity < 17""",
    "v_portal_line": f"""
        SELECT p.territory_id, v.ordinal, v.municipal_id,
               CASE WHEN v.ordinal % 5 = 0 THEN r.address || ' - Rear garage'
                    WHEN v.ordinal % 7 = 0 THEN CAST(v.k % 200 + 1 AS STRING) || '-' || CAST(v.k % 200 + 3 AS STRING)
                        || ' OAK ST'
                    WHEN v.ordinal % 11 = 0 THEN 'Barn - 12 Elm St' ELSE r.address || ', ' || w.town || ' ' || w.state || ' ' || w.zip END AS location,
               CAST(extract(month FROM v.issue_date) AS STRING) || '/' || CAST(extract(day FROM v.issue_date) AS STRING)
                   || '/' || CAST(extract(year FROM v.issue_date) AS STRING) AS issue_text,
               CASE WHEN v.l_partkey % 2 = 0 THEN 'proofing walls' ELSE v.description END AS work_description,
               CASE WHEN v.l_partkey % 3 = 0 THEN 'Re-roof, ice shield' ELSE 'none' END AS comments,
               (v.l_suppkey % 2 = 0) AS has_detail
        FROM v_permit v JOIN v_parcel p ON v.k = p.k JOIN v_parcel_raw r ON v.k = r.k JOIN v_town w ON p.territory_id = w.territory_id""",
    "v_edge": """
        SELECT src, dst, metres FROM (
            SELECT p_partkey AS src, p_partkey + 1 AS dst, CAST(20 + p_size AS DOUBLE) AS metres
            FROM part WHERE p_size < 43 AND p_partkey % 50 < 49
            UNION ALL
            SELECT p_partkey AS src, p_partkey + 50 AS dst, CAST(20 + p_size AS DOUBLE) AS metres
            FROM part WHERE p_size > 4 AND p_type <> 'PROMO'
            UNION ALL
            SELECT p_partkey AS src, -1 - p_partkey AS dst, CAST(5 + p_size AS DOUBLE) AS metres
            FROM part WHERE p_brand = 'Brand#2') AS e""",
    "v_node": """
        SELECT p_partkey AS id, CAST(-74.2 AS DOUBLE) + CAST(p_partkey % 50 AS DOUBLE) * CAST(0.002 AS DOUBLE) AS lon,
               CAST(41.0 AS DOUBLE) + floor(p_partkey / 50) * CAST(0.0025 AS DOUBLE) AS lat, p_partkey % 5 AS area
        FROM part""",
    "v_segment": """
        SELECT p_partkey AS id, p_partkey % 3 AS area, CAST(p_partkey % 50 * 30 AS DOUBLE) + CAST(p_size % 3 AS DOUBLE) / CAST(4 AS DOUBLE) AS x1,
               CAST(floor(p_partkey / 50) * 30 AS DOUBLE) AS y1,
               CAST((p_partkey + 1) % 50 * 30 AS DOUBLE) + CAST(p_size % 5 AS DOUBLE) / CAST(4 AS DOUBLE) AS x2,
               CAST(floor((p_partkey + 1) / 50) * 30 AS DOUBLE) + CAST(p_size AS DOUBLE) AS y2
        FROM part""",
    "v_lot": """
        SELECT p_partkey AS k, p_partkey % 3 AS area, x AS min_x, y AS min_y, x + CAST(6 + p_size % 9 + CASE WHEN p_size = 50 THEN 300 ELSE 0 END AS DOUBLE) AS max_x,
               y + CAST(5 + p_size % 11 AS DOUBLE) AS max_y
        FROM (SELECT *, CAST(p_partkey % 50 * 30 + 4 + p_size % 5 AS DOUBLE) + CAST(0.125 AS DOUBLE) AS x,
                     CAST(floor(p_partkey / 50) * 30 + 3 + p_size % 7 AS DOUBLE) + CAST(0.125 AS DOUBLE) AS y
              FROM part WHERE p_size % 4 <> 0) AS lots""",
    "v_parcel_box": """
        SELECT territory_id, pams_pin, k, lon, lat, lon - half AS min_x, lat - half AS min_y, lon + half AS max_x, lat + half AS max_y
        FROM (SELECT *, CAST(1 + k % 7 AS DOUBLE) / CAST(8192 AS DOUBLE) AS half FROM v_parcel WHERE lon IS NOT NULL) AS sized""",
    "v_route_request": """
        SELECT CAST(n_nationkey AS BIGINT) AS route_id, CAST(n_regionkey AS BIGINT) AS territory_id,
               CAST(-74.19 AS DOUBLE) + CAST(n_nationkey % 5 AS DOUBLE) * CAST(0.02 AS DOUBLE) AS lon,
               CAST(41.01 AS DOUBLE) + floor(n_nationkey / 5) * CAST(0.02 AS DOUBLE) AS lat,
               CAST(0.5 AS DOUBLE) + CAST(n_nationkey % 4 AS DOUBLE) * CAST(0.5 AS DOUBLE) AS hours, CAST(5 AS INT) AS max_doors,
               CASE WHEN n_nationkey % 8 = 7 THEN 'v1' ELSE 'v2' END AS score_contract_version
        FROM nation""",
    "v_route_door": """
        SELECT territory_id, pams_pin, CASE WHEN k % 9 = 0 THEN NULL ELSE k % 101 END AS score, lon, lat
        FROM v_parcel""",
    "v_page": """
        SELECT page_id, url FROM pages""",
    "v_situs": """
        SELECT territory_id, pams_pin, k, address || ', Ramsey NJ' || CASE WHEN zip5 = '' THEN '' ELSE ' ' || zip5 END
               AS situs, address, territory_rank
        FROM v_parcel_raw""",
    "v_door_score": """
        SELECT territory_id, pams_pin, k, CASE WHEN k % 31 = 0 THEN NULL ELSE CAST(k * 37 % 101 AS INT) END AS score,
               CAST(k * 7 % 46 AS INT) AS project, CAST(k * 11 % 26 AS INT) AS capacity,
               CAST(k * 13 % 49 AS INT) AS fit, CASE WHEN k % 7 = 0 THEN 'v1' ELSE 'v2' END AS score_contract_version
        FROM v_parcel""",
}

# The same rows as the view of that name, for Spark: lines meet their part, then their order with its parcel, so they are dealt twice and
# not three times, and what a line is worth is worked out before the second time.
SPARK_VIEWS = {
    "v_permit": """
        SELECT p.territory_id, p.mun, p.pams_pin, p.k, p.block, p.lot,
               CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING) AS municipal_id,
               (CAST(l_orderkey AS BIGINT) * 10 + l_linenumber) * 1000000 + low AS ordinal, issue_date, l_quantity, cost,
               disposition, source, completion_date, description, p_type, l_partkey, l_orderkey, l_linenumber, l_suppkey
        FROM (SELECT (l_partkey * 131 + l_suppkey * 7) % 1000000 AS low, issue_date, l_quantity, l_extendedprice AS cost,
                     CASE l_returnflag WHEN 'R' THEN 'completed' WHEN 'A' THEN NULL
                          ELSE CASE l_partkey % 3 WHEN 0 THEN 'voided' WHEN 1 THEN 'expired' ELSE 'administrative' END
                     END AS disposition,
                     CASE l_linestatus WHEN 'F' THEN 'SDL' ELSE 'statewide' END AS source,
                     CASE WHEN l_returnflag = 'R' AND l_linenumber % 2 = 1 THEN issue_date + CAST(l_quantity AS INT) END
                         AS completion_date,
                     CASE p_type WHEN 'ECONOMY' THEN 'roof replacement' WHEN 'SMALL' THEN 'roof repair'
                          WHEN 'MEDIUM' THEN 'in-ground pool' WHEN 'PROMO' THEN 'solar panels'
                          WHEN 'LARGE' THEN 'siding' ELSE p_name END AS description,
                     p_type, l_partkey, l_orderkey, l_linenumber, l_suppkey
              FROM (SELECT *, CAST(l_shipdate AS DATE) + CASE WHEN l_partkey % 5 = 0 THEN 0 ELSE -4000 END AS issue_date
                    FROM lineitem) AS line
                   JOIN part ON l_partkey = p_partkey) AS typed
             JOIN (SELECT o_orderkey, owner.* FROM orders JOIN v_parcel owner ON owner.k = o_custkey) AS p ON l_orderkey = o_orderkey""",
}

_VIEW_NAME = re.compile(r"\bv_\w+")


def _needed(sql: str, views: dict[str, str] = VIEWS) -> list[str]:
    """The views a text uses, each after the views it is built from."""
    ordered: list[str] = []

    def visit(text: str) -> None:
        for name in _VIEW_NAME.findall(text):
            if name in views and name not in ordered:
                visit(views[name])
                if name not in ordered:
                    ordered.append(name)

    visit(sql)
    return ordered


def with_views(sql: str, views: dict[str, str] = VIEWS) -> str:
    """`sql` with the definitions of the views it names in front."""
    body = sql.strip()
    recursive = bool(re.match(r"WITH\s+RECURSIVE\b", body, re.I))
    body = re.sub(r"^WITH\s+(RECURSIVE\s+)?", ", " if _needed(sql, views) else "WITH ", body, count=1, flags=re.I) \
        if re.match(r"WITH\b", body, re.I) else body
    ctes = ", ".join(f"{name} AS ({views[name].strip()})" for name in _needed(sql, views))
    if not ctes:
        return body if not recursive else body.replace("WITH ", "WITH RECURSIVE ", 1)
    return f"WITH {'RECURSIVE ' if recursive else ''}{ctes} {body}"


class Tables:
    """The given Parquet tables and the derived views, as DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        sized_by_rows(spark)
        self.spark, self.sf_dir = spark, sf_dir.rstrip("/")
        self._views: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def sql(self, text: str) -> DataFrame:
        body = with_views(text, VIEWS | SPARK_VIEWS)
        used = [name for name in TABLES if re.search(rf"\b{name}\b", body)]
        sources = ", ".join(f"{name} AS (SELECT * FROM parquet.`{self.sf_dir}/{name}.parquet`)" for name in used)
        if sources:
            body = f"WITH {sources}, {body[5:]}" if body.startswith("WITH ") else f"WITH {sources} {body}"
        return self.spark.sql(body)

    def view(self, name: str) -> DataFrame:
        if name not in self._views:
            self._views[name] = self.sql(f"SELECT * FROM {name}")
        return self._views[name]

    def landed(self) -> "Tables":
        """The same views as written tables, for jobs that read them many times."""
        return LandedTables(self.spark, self.sf_dir)

    def derived(self) -> "Tables":
        """The same views as they are derived, for jobs that read one once and few of its columns."""
        return Tables(self.spark, self.sf_dir)

    def __getattr__(self, name: str) -> DataFrame:
        if name in VIEWS:
            return self.view(name)
        if name in TABLES:
            return self.table(name)
        raise AttributeError(name)


class LandedTables(Tables):
    """Derived views written once per session under the checkpoint folder and read back as Parquet.

    A composite job uses its inputs in many branches. Read from a written table each branch is a
    pruned scan; read from the view each would repeat the joins that derive it.
    """

    _written: dict[tuple[str, str, str], DataFrame] = {}

    def view(self, name: str) -> DataFrame:
        key = (self.spark.sparkContext.applicationId, self.sf_dir, name)
        if key not in self._written:
            self._written[key] = land(super().view(name), name)
        return self._written[key]
