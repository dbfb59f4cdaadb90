"""Rankings and orders (W)."""

from __future__ import annotations

from pyspark.sql import functions as F

from doorlens.operators import history, publish, spatial
from doorlens.operators.ordering import count_below
from doorlens.plans.analogs import AS_OF, AS_OF_SQL, Tables
from doorlens.plans.joins import NEAR_SQL, ROUTED_SQL, _match_sql, matched, routed
from doorlens.plans.registry import query
from doorlens.plans.scalars import equirect_sql
from doorlens.scoring import facts

A = AS_OF_SQL


@query("w1_select_territory", f"""SELECT territory_id, pams_pin, rank AS territory_rank FROM (
    SELECT p.territory_id, p.pams_pin, target, row_number() OVER (PARTITION BY p.territory_id
        ORDER BY {equirect_sql('6371008.8')}, p.pams_pin) AS rank
    FROM v_parcel p JOIN v_anchor a ON p.territory_id = a.territory_id WHERE prop_class = '2' AND lon IS NOT NULL) AS x
    WHERE rank <= target""")
def select_territory(t: Tables):
    t = t.landed()
    return spatial.select_territory(t.v_parcel, t.v_anchor).select(
        "territory_id", "pams_pin", F.col("territory_rank").cast("bigint").alias("territory_rank")
    )


@query("w2_knn_rank", f"""WITH {NEAR_SQL} SELECT pams_pin, arg_min(comp_pin, rank) AS nearest, CAST(max(rank) AS BIGINT) AS found
    FROM near GROUP BY pams_pin""")
def knn_rank(t: Tables):
    t = t.landed()
    near = spatial.nearest_comparables(t.v_parcel)
    return near.groupBy("pams_pin").agg(
        F.min_by("comp_pin", "rank").alias("nearest"), F.max("rank").cast("bigint").alias("found")
    )


def scorer_sales(t: Tables, landed: bool = True):
    t = t.landed() if landed else t.derived()
    return t.v_sale.select(
        "territory_id", "pams_pin", "ordinal", "source", "sale_day", "sale_price", F.col("nu_code").alias("sales_code")
    )


SALES_FACTS_SQL = f"""sales AS (SELECT *, sale_price > 100 AND nu_code = '' AND sale_day <= {A} AS valid FROM v_sale),
    sale_facts AS (SELECT territory_id, pams_pin, max(sale_day) FILTER (WHERE valid) AS last_sale,
        first(source ORDER BY sale_day DESC, ordinal) FILTER (WHERE valid) AS last_source,
        count(*) FILTER (WHERE NOT valid) AS invalid_sales FROM sales GROUP BY territory_id, pams_pin)"""


@query("w3_freshest_valid_sale", f"""WITH {SALES_FACTS_SQL} SELECT pams_pin, CAST(last_sale AS STRING) AS last_sale,
    last_source, invalid_sales FROM sale_facts""")
def freshest_valid_sale(t: Tables):
    return facts.sale_facts(scorer_sales(t), None, AS_OF).select(
        "pams_pin", F.col("last_sale").cast("string").alias("last_sale"), F.col("last_sale_source").alias("last_source"),
        "invalid_sales",
    )


_TRAIL_OF = """SELECT territory_id, pams_pin, ordinal, CAST(ordinal % 7 AS BIGINT) AS kind,
    CASE ordinal % 5 WHEN 0 THEN 'fit_pool' WHEN 1 THEN 'capacity_territory_percentile' WHEN 2 THEN 'project_active'
        WHEN 3 THEN 'capacity_local_relative_value' ELSE 'mover_recency' END AS type,
    CAST(ordinal % 11 AS DOUBLE) - CAST(3 AS DOUBLE) AS points FROM {permits}"""
_TRAIL = _TRAIL_OF.format(permits="v_permit")


def trail(lines):
    """The trail over permits that are at hand, as `_TRAIL` has it over the view."""
    return lines.sparkSession.sql(_TRAIL_OF.format(permits="{lines}"), lines=lines)


@query("w4_evidence_sequence", f"""SELECT pams_pin, ordinal, row_number() OVER (PARTITION BY pams_pin ORDER BY kind, ordinal) - 1 AS seq
    FROM ({_TRAIL}) AS t""")
def evidence_sequence(t: Tables):
    rows = t.sql(_TRAIL).withColumns({
        "one": F.lit(1), "high": F.shiftright("ordinal", 40), "mid": F.shiftright("ordinal", 20)
    })
    return count_below(rows, facts.DOOR, ["kind", "high", "mid", "ordinal"], "one", "seq").select(
        "pams_pin", "ordinal", F.col("seq").cast("bigint").alias("seq")
    )


@query("w5_reason_chip", f"""SELECT pams_pin, first(type ORDER BY points DESC, type) AS reason_chip FROM ({_TRAIL}) AS t
    WHERE type NOT IN ('capacity_territory_percentile', 'capacity_local_relative_value') GROUP BY pams_pin""")
def reason_chip(t: Tables):
    return publish.reason_chips(t.sql(_TRAIL)).select("pams_pin", "reason_chip")


@query("f16_speakable_evidence", f"""SELECT ordinal, type FROM ({_TRAIL}) AS t
    WHERE type NOT IN ('capacity_territory_percentile', 'capacity_local_relative_value')""")
def speakable_evidence(t: Tables):
    from doorlens.operators.filters import speakable

    return speakable(t.sql(_TRAIL)).select("ordinal", "type")


@query("w6_panel_order", f"""SELECT pams_pin, ordinal, row_number() OVER (PARTITION BY pams_pin ORDER BY abs(points) DESC, ordinal) - 1
    AS place FROM ({_TRAIL}) AS t""")
def panel_order(t: Tables):
    rows = t.sql(_TRAIL).withColumns({"size": F.abs("points"), "one": F.lit(1), "high": F.shiftright("ordinal", 20)})
    return count_below(
        rows, facts.DOOR, ["size", "high", "ordinal"], "one", "place", [True, False, False]
    ).select("pams_pin", "ordinal", F.col("place").cast("bigint").alias("place"))


@query("w7_unmatched_order", f"""WITH {ROUTED_SQL} SELECT record_id, row_number() OVER (PARTITION BY mun ORDER BY record_id) - 1 AS place
    FROM routed WHERE route = 'unmatched'""")
def unmatched_order(t: Tables):
    from doorlens.operators.resolve import unmatched_permits

    rows = unmatched_permits(routed(t)).withColumns({"one": F.lit(1), "head": F.substring("record_id", 1, 6)})
    return count_below(rows, ["mun"], ["head", "record_id"], "one", "place").select(
        "record_id", F.col("place").cast("bigint").alias("place")
    )


@query("w8_permits_newest_first", f"""WITH {_match_sql()} SELECT m.ordinal, row_number() OVER (PARTITION BY m.territory_id, pin
    ORDER BY v.issue_date DESC, m.ordinal) - 1 AS position FROM matched m JOIN v_permit v ON m.ordinal = v.ordinal WHERE n = 1""")
def permits_newest_first(t: Tables):
    return history.newest_first(matched(t)).select("ordinal", F.col("position").cast("bigint").alias("position"))


@query("w9_sales_newest_first", """SELECT ordinal, row_number() OVER (PARTITION BY mun ORDER BY deed_date DESC, date_recorded DESC,
    ordinal) - 1 AS position FROM v_sale""")
def sales_newest_first(t: Tables):
    rows = t.v_sale.withColumn("one", F.lit(1))
    return count_below(
        rows, ["mun"], ["deed_date", "date_recorded", "ordinal"], "one", "position", [True, True, False]
    ).select("ordinal", F.col("position").cast("bigint").alias("position"))


