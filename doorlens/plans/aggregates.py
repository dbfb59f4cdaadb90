"""Aggregations (A)."""

from __future__ import annotations

from pyspark.sql import functions as F

from doorlens.operators import history, imagery, outcomes, permits, publish, report, resolve
from doorlens.operators.spatial import nearest_comparables, valid_single_family
from doorlens.plans.analogs import AS_OF, AS_OF_SQL, Tables
from doorlens.plans.joins import (
    DEED_SQL, ENRICHED_SQL, LATEST_SQL, NEAR_SQL, PLACED_SQL, ROUTED_SQL, _match_sql, boxes, matched, routed, territory,
)
from doorlens.plans.registry import query
from doorlens.plans.scalars import deed_sql
from doorlens.scoring import engine, facts

A = AS_OF_SQL
def _rows():
    return F.count(F.lit(1))


@query("a1_latest_sale", f"WITH {LATEST_SQL} SELECT skey AS sale_key, ordinal, deed_date, date_recorded FROM latest")
def latest_sale(t: Tables):
    return resolve.latest_sales(t.v_sale).select("sale_key", "ordinal", "deed_date", "date_recorded")


ACCOUNT_SQL = f"""{ROUTED_SQL},
    totals AS (SELECT mun, count(*) AS permits_total FROM v_permit_raw GROUP BY mun),
    counted AS (SELECT mun, count(*) AS permits_in_window,
        count(*) FILTER (WHERE route = 'out_of_territory') AS permits_out_of_territory,
        count(*) FILTER (WHERE route = 'block_lot') AS matched_by_block_lot,
        count(*) FILTER (WHERE route = 'address') AS matched_by_address,
        count(*) FILTER (WHERE route = 'unmatched') AS permits_unmatched,
        count(*) FILTER (WHERE bucket = 'permits_matched_municipal') AS permits_matched_municipal,
        count(*) FILTER (WHERE bucket = 'permits_placeholder_block_lot') AS permits_placeholder_block_lot,
        count(*) FILTER (WHERE bucket = 'permits_unmatched_municipal') AS permits_unmatched_municipal
        FROM routed GROUP BY mun)"""
COUNTS = (
    "permits_total", "permits_in_window", "permits_out_of_territory", "matched_by_block_lot", "matched_by_address",
    "permits_unmatched", "permits_matched_municipal", "permits_placeholder_block_lot", "permits_unmatched_municipal",
)


@query("a2_permit_accounting", f"""WITH {ACCOUNT_SQL} SELECT t.mun, {', '.join(COUNTS)},
    permits_total - permits_in_window AS permits_out_of_window FROM totals t JOIN counted c ON t.mun = c.mun""")
def permit_accounting(t: Tables):
    t = t.landed()
    return resolve.permit_accounting(t.v_permit_raw, routed(t)).select("mun", *COUNTS, "permits_out_of_window")


def _ratio(top: str, bottom: str) -> str:
    return f"CASE WHEN {bottom} > 0 THEN round(CAST({top} AS DOUBLE) / ({bottom}), 6) ELSE 0.0 END"


RATES_SQL = f"""{_ratio('matched_by_block_lot + matched_by_address',
                        'matched_by_block_lot + matched_by_address + permits_unmatched')} AS permit_match_rate,
    {_ratio('matched_by_block_lot', '(matched_by_block_lot + matched_by_address + permits_unmatched)')} AS block_lot_match_rate,
    {_ratio('matched_by_address', '(matched_by_block_lot + matched_by_address + permits_unmatched)')} AS address_match_rate,
    {_ratio('permits_matched_municipal', 'permits_in_window')} AS municipal_match_rate"""
RATES = ("permit_match_rate", "block_lot_match_rate", "address_match_rate", "municipal_match_rate")


@query("a3_match_rates", f"WITH {ACCOUNT_SQL} SELECT mun, {RATES_SQL} FROM counted")
def match_rates(t: Tables):
    t = t.landed()
    rates = resolve.match_rates(resolve.permit_accounting(t.v_permit_raw, routed(t)))
    return rates.select("mun", *[F.round(r, 6).alias(r) for r in RATES])


def resolved(t: Tables):
    t = t.landed()
    parcels = territory(t).join(t.v_parcel.select("k", "geoid", "yr_constr", "net_value", "calc_acre", "lon", "lat"), "k")
    acs = t.v_acs_stats.withColumn("geoid", F.concat(F.lit("BG"), F.lpad("geoid", 2, "0"))).filter("geoid != 'BG24'")
    return resolve.resolve(parcels, t.v_permit_raw, t.v_sale, acs, t.v_rental, AS_OF, municipal=t.v_parcel_raw, boundaries=boxes(t))


SIGNAL_SQL = f"""WITH {ROUTED_SQL}, {PLACED_SQL}, landed AS (SELECT DISTINCT pams_pin FROM routed WHERE pams_pin IS NOT NULL),
    signals AS (SELECT r.mun, r.pams_pin, l.pams_pin IS NOT NULL AS permits, coalesce(g.geoid <> 'BG24', false) AS bg,
                       r.pams_pin IN (SELECT pams_pin FROM v_rental) AS rental
                FROM v_parcel_raw r LEFT JOIN placed g ON r.pams_pin = g.pams_pin LEFT JOIN landed l ON r.pams_pin = l.pams_pin
                WHERE r.prop_class = '2')"""


@query("a4_signal_coverage", f"""{SIGNAL_SQL} SELECT mun, count(*) AS doors_total,
    count(*) FILTER (WHERE permits OR bg OR rental) AS doors_with_signal,
    count(*) FILTER (WHERE bg) AS doors_with_block_group,
    round(count(*) FILTER (WHERE permits OR bg OR rental) / CAST(count(*) AS DOUBLE), 6) AS coverage
    FROM signals GROUP BY mun""")
def signal_coverage(t: Tables):
    return resolve.signal_coverage(resolved(t)["doors"]).select(
        "mun", "doors_total", "doors_with_signal", "doors_with_block_group", F.round("coverage", 6).alias("coverage")
    )


@query("a5_permits_per_door", f"""WITH {ROUTED_SQL} SELECT pams_pin, record_id, row_number() OVER (
    PARTITION BY mun, pams_pin ORDER BY permit_date DESC, record_id DESC) - 1 AS position FROM routed WHERE pams_pin IS NOT NULL""")
def permits_per_door(t: Tables):
    return resolve.door_permits(routed(t)).select("pams_pin", "record_id", F.col("position").cast("bigint").alias("position"))


def scorer_permits(t: Tables, landed: bool = True):
    """The scorer's permits; a job that reads them once takes them as they are derived, not as a written table of all columns."""
    t = t.landed() if landed else t.derived()
    return t.v_permit.select(
        "territory_id", "pams_pin", F.col("ordinal").cast("string").alias("permit_id"), "municipal_id", "description",
        F.lit(None).cast("string").alias("work_type"), "disposition", "issue_date", "completion_date",
        F.lit(None).cast("date").alias("last_activity_date"), (F.col("source") == "SDL").alias("from_portal"),
        (F.col("source") == "statewide").alias("from_statewide"), "ordinal",
    )


DEDUPE_SQL = """deduped AS (SELECT * FROM (SELECT *, min(ordinal) OVER (PARTITION BY pams_pin, municipal_id) AS place,
        row_number() OVER (PARTITION BY pams_pin, municipal_id ORDER BY source = 'statewide', ordinal) AS rn
    FROM v_permit) AS d WHERE rn = 1)"""


@query("a7_scorer_dedupe", f"WITH {DEDUPE_SQL} SELECT pams_pin, municipal_id, CAST(ordinal AS STRING) AS permit_id, place FROM deduped")
def scorer_dedupe(t: Tables):
    return permits.dedupe_permits(scorer_permits(t)).select(
        "pams_pin", "municipal_id", "permit_id", F.col("ordinal").alias("place")
    )


@query("a8_territory_median", """SELECT p.territory_id, coalesce(median(CASE WHEN prop_class = '2' AND net_value > 0
    THEN net_value END), 0.0) AS median_value FROM v_parcel p GROUP BY p.territory_id""")
def territory_median(t: Tables):
    t = t.landed()
    return facts.territory_median(t.v_parcel)


@query("a9_local_median", f"""WITH {NEAR_SQL}, m AS (SELECT pams_pin, count(*) AS comps, median(value) AS comp_median FROM near
        GROUP BY pams_pin)
    SELECT p.pams_pin, comps, round(comp_median, 4) AS comp_median, round(net_value / comp_median, 6) AS ratio,
           CAST(CASE WHEN comps < 10 THEN 0 WHEN net_value / comp_median >= 1.5 THEN 10 WHEN net_value / comp_median >= 1.2
                THEN 7 WHEN net_value / comp_median > 1.0 THEN 3 ELSE 0 END AS BIGINT) AS points
    FROM v_parcel p JOIN m ON p.pams_pin = m.pams_pin WHERE net_value > 0""")
def local_median(t: Tables):
    t = t.landed()
    medians = facts.comparable_facts(nearest_comparables(t.v_parcel))
    ratio = engine.local_ratio(F.col("net_value"), F.col("comp_median"))
    points = F.when(F.col("comps") < engine.MIN_COMPARABLES, 0).otherwise(engine.local_points(F.col("ratio")))
    return t.v_parcel.filter("net_value > 0").join(medians, facts.DOOR).withColumn("ratio", ratio).select(
        "pams_pin", "comps", F.round("comp_median", 4).alias("comp_median"), F.round("ratio", 6).alias("ratio"),
        points.cast("bigint").alias("points"),
    )


MIDRANK_SQL = """ranks AS (SELECT territory_id, pams_pin, net_value,
        (rank() OVER (PARTITION BY territory_id ORDER BY net_value) - 1
         + 0.5 * count(*) OVER (PARTITION BY territory_id, net_value)) / count(*) OVER (PARTITION BY territory_id) * 100.0
            AS percentile
    FROM v_parcel WHERE prop_class = '2' AND net_value > 0 AND lon IS NOT NULL)"""


@query("a10_midrank_percentile", f"""WITH {MIDRANK_SQL} SELECT pams_pin, round(percentile, 6) AS percentile,
    CAST(CASE WHEN percentile >= 90 THEN 10 WHEN percentile >= 75 THEN 7 WHEN percentile >= 50 THEN 3 ELSE 0 END AS BIGINT)
        AS points FROM ranks""")
def midrank_percentile(t: Tables):
    t = t.landed()
    homes = valid_single_family(t.v_parcel).withColumn("value", F.col("net_value"))
    rank = facts.midrank_percentile(F.col("below"), F.col("equal"), F.col("total"))
    ranked = facts.value_ranks(homes).withColumn("percentile", rank)
    return homes.join(ranked, ["territory_id", "value"]).select(
        "pams_pin", F.round("percentile", 6).alias("percentile"),
        engine.banded(F.col("percentile"), engine.PERCENTILE_BANDS).cast("bigint").alias("points"),
    )


PROJECT_SQL = f"""{DEDUPE_SQL},
    judged AS (SELECT *, CASE WHEN disposition = 'completed' THEN coalesce(completion_date, issue_date) END AS done FROM deduped),
    flagged AS (SELECT *, disposition IS NULL AND issue_date BETWEEN DATE '2000-06-30' AND {A} AS active,
                       coalesce(done BETWEEN DATE '1999-06-30' AND {A}, false) AS completed FROM judged),
    per_door AS (SELECT territory_id, pams_pin, count(*) AS permits, count(*) FILTER (WHERE active OR completed) AS projects,
                     max(CASE WHEN description = 'roof replacement' AND done <= {A} THEN done END) AS roof_when,
                     count(*) FILTER (WHERE description LIKE '%roof%') AS roof_records,
                     count(*) FILTER (WHERE description LIKE '%pool%' AND done IS NOT NULL) AS pool_permits,
                     count(*) FILTER (WHERE description LIKE '%solar%' AND done IS NOT NULL) AS solar_permits
                 FROM flagged GROUP BY territory_id, pams_pin)"""


@query("a11_category_cap", f"""WITH {PROJECT_SQL} SELECT pams_pin, least(15 * projects, 45) AS project,
    CASE WHEN 15 * projects > 45 THEN 45 - 15 * projects ELSE 0 END AS cap_points FROM per_door""")
def category_cap(t: Tables):
    t = t.landed()
    found = facts.permit_facts(facts.classify_permits(scorer_permits(t), None, AS_OF))
    raw = F.col("projects") * engine.PROJECT_POINTS
    capped = F.least(raw, F.lit(engine.PROJECT_CAP))
    return found.select("pams_pin", capped.cast("bigint").alias("project"), (capped - raw).cast("bigint").alias("cap_points"))


@query("a14_score_spread", """SELECT territory_id, CAST(min(score) AS DOUBLE) AS score_min, CAST(max(score) AS DOUBLE) AS score_max,
    round(avg(score), 6) AS score_mean, round(avg(project), 6) AS project_mean, round(avg(capacity), 6) AS capacity_mean,
    round(avg(fit), 6) AS fit_mean FROM v_door_score WHERE score IS NOT NULL GROUP BY territory_id""")
def score_spread(t: Tables):
    wide = report.spread(t.v_door_score, ("score", "project", "capacity", "fit"))
    return wide.select("territory_id", "score_min", "score_max",
                       *[F.round(f"{c}_mean", 6).alias(f"{c}_mean") for c in ("score", "project", "capacity", "fit")])


@query("a15_deciles", "SELECT territory_id, " + ", ".join(
    f"round(quantile_cont(CAST(score AS DOUBLE), 0.{n}), 6) AS q{n}0" for n in range(1, 10)
) + " FROM v_door_score WHERE score IS NOT NULL GROUP BY territory_id")
def deciles(t: Tables):
    return report.deciles(t.v_door_score).select("territory_id", *[F.round(q, 6).alias(q) for q in report.DECILES])


_GAPS = """SELECT territory_id, pams_pin, 'imagery_missing' AS gap FROM v_parcel WHERE lon IS NULL
    UNION ALL SELECT territory_id, pams_pin, 'assessed_value_missing' AS gap FROM v_parcel WHERE net_value <= 0
    UNION ALL SELECT territory_id, pams_pin, 'acs_missing' AS gap FROM v_parcel WHERE geoid = '24'"""


@query("a16_missing_signals", f"SELECT territory_id, gap, count(*) AS doors FROM ({_GAPS}) AS g GROUP BY territory_id, gap")
def missing_signals(t: Tables):
    return report.missing_signals(t.sql(_GAPS))


@query("a13_confidence", f"""SELECT p.pams_pin, CASE WHEN count(g.gap) >= 2 THEN 'low' ELSE 'normal' END AS confidence
    FROM v_parcel p LEFT JOIN ({_GAPS}) AS g ON p.pams_pin = g.pams_pin GROUP BY p.pams_pin""")
def confidence(t: Tables):
    counted = t.sql(_GAPS).groupBy(*facts.DOOR).agg(_rows().alias("gaps"))
    low = F.when(F.coalesce("gaps", F.lit(0)) >= 2, "low").otherwise("normal")
    return t.v_parcel.join(counted, facts.DOOR, "left").select("pams_pin", low.alias("confidence"))


@query("a18_coverage_and_cost", """WITH paid AS (SELECT territory_id, sum(round(sale_price / 1000000.0, 2)) AS usd FROM v_sale
        GROUP BY territory_id)
    SELECT d.territory_id, count(*) AS doors_total, count(score) AS doors_scored, round(count(score) / CAST(count(*) AS DOUBLE), 6)
        AS coverage, round(max(usd), 2) AS cost_usd, round(max(usd) / count(score), 6) AS cost_per_door
    FROM v_door_score d JOIN paid p ON d.territory_id = p.territory_id GROUP BY d.territory_id""")
def coverage_and_cost(t: Tables):
    spend = t.v_sale.select("territory_id", F.round(F.col("sale_price") / 1000000.0, 2).alias("usd"))
    return publish.coverage(t.v_door_score, spend).select(
        "territory_id", "doors_total", "doors_scored", F.round("coverage", 6).alias("coverage"),
        F.round("cost_usd", 2).alias("cost_usd"), F.round("cost_per_door", 6).alias("cost_per_door"),
    )


@query("a19_vision_metrics", """SELECT tp, fp, fn, tn, round(tp / CAST(tp + fp AS DOUBLE), 6) AS precision,
        round(tp / CAST(tp + fn AS DOUBLE), 6) AS recall, round(pc / CAST(pr AS DOUBLE), 6) AS hallucination_rate FROM (
    SELECT count(*) FILTER (WHERE NOT probe AND actual AND predicted) AS tp,
           count(*) FILTER (WHERE NOT probe AND NOT actual AND predicted) AS fp,
           count(*) FILTER (WHERE NOT probe AND actual AND NOT predicted) AS fn,
           count(*) FILTER (WHERE NOT probe AND NOT actual AND NOT predicted) AS tn,
           count(*) FILTER (WHERE probe AND predicted) AS pc, count(*) FILTER (WHERE probe) AS pr FROM v_label) AS c""")
def vision_metrics(t: Tables):
    return imagery.vision_metrics(t.v_label).select(
        "tp", "fp", "fn", "tn", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "hallucination_rate")]
    )


@query("a20_deed_vintage", f"""WITH {DEED_SQL},
    own AS (SELECT mun, max({deed_sql('deed_date')}) AS d FROM v_parcel_raw GROUP BY mun),
    sold AS (SELECT mun, max(sale_day) AS d FROM v_sale WHERE deed_date <> '' GROUP BY mun),
    moved AS (SELECT mun, count(*) FILTER (WHERE {A} - deed_day <= 90) AS n FROM deeds WHERE prop_class = '2' GROUP BY mun)
    SELECT own.mun, CAST(greatest(own.d, sold.d) AS STRING) AS latest_deed_date, CAST(sold.d AS STRING) AS latest_sale_date,
           coalesce(moved.n, 0) AS doors_in_mover_window
    FROM own LEFT JOIN sold ON own.mun = sold.mun LEFT JOIN moved ON own.mun = moved.mun""")
def deed_vintage(t: Tables):
    t = t.landed()
    doors = resolve.merge_deed(territory(t), resolve.latest_sales(t.v_sale), AS_OF)
    return resolve.deed_vintage(t.v_parcel_raw, t.v_sale, doors, AS_OF).select(
        "mun", F.col("latest_deed_date").cast("string").alias("latest_deed_date"),
        F.col("latest_sale_date").cast("string").alias("latest_sale_date"), "doors_in_mover_window",
    )


@query("a21_doors_with_imagery", """SELECT territory_id, count(DISTINCT pams_pin) AS doors FROM v_detection
    WHERE present AND confidence >= 0.6 GROUP BY territory_id""")
def doors_with_imagery(t: Tables):
    framed = t.v_detection.filter("present and confidence >= 0.6").select("territory_id", "pams_pin").distinct()
    return framed.groupBy("territory_id").agg(_rows().alias("doors"))


VISION_SQL = """kept AS (SELECT *, substr(capture_date, 1, 4) AS vintage, replace(signal, 'condition_', '') AS grade
              FROM v_detection WHERE confidence >= 0.6),
    vision AS (SELECT territory_id, pams_pin,
        coalesce(arg_max(present, ordinal) FILTER (WHERE signal = 'pool'), false) AS pool,
        coalesce(arg_max(present, ordinal) FILTER (WHERE signal = 'solar'), false) AS solar,
        arg_max(grade, ordinal) FILTER (WHERE present AND signal LIKE 'condition%' AND vintage = '2015') AS c2015,
        arg_max(grade, ordinal) FILTER (WHERE present AND signal LIKE 'condition%' AND vintage = '2020') AS c2020
      FROM kept GROUP BY territory_id, pams_pin)"""


@query("a22_detection_signals", f"""WITH {VISION_SQL} SELECT pams_pin, pool, solar, c2015 AS condition_2015,
    c2020 AS condition_2020 FROM vision""")
def detection_signals(t: Tables):
    return imagery.imagery_signals(t.v_detection).select("pams_pin", "pool", "solar", "condition_2015", "condition_2020")


@query("a23_condition_decline", f"""WITH {VISION_SQL} SELECT pams_pin, coalesce(
    list_position(['poor', 'fair', 'good', 'excellent'], c2020) < list_position(['poor', 'fair', 'good', 'excellent'], c2015),
    false) AS declined FROM vision""")
def condition_decline(t: Tables):
    return imagery.imagery_signals(t.v_detection).select("pams_pin", "declined")


OUTCOME_SQL = """valid AS (SELECT * FROM v_outcome WHERE trim(door_id) <> '' AND attempt_time <> 'yesterday'
        AND score_contract_version <> '' AND attempt_score BETWEEN 0 AND 100
        AND primary_outcome IN ('receptive_conversation', 'not_receptive', 'no_answer') AND follow_up_requested IS NOT NULL)"""


@query("a24_band_lift", f"""WITH {OUTCOME_SQL}, bands AS (SELECT unnest(range(0, 6)) AS band),
    placed AS (SELECT *, CASE WHEN attempt_score < 13 THEN 0 WHEN attempt_score < 19.5 THEN 1 WHEN attempt_score < 28 THEN 2
        WHEN attempt_score < 45.1 THEN 3 WHEN attempt_score < 100.5 THEN 4 ELSE 5 END AS band FROM valid)
    SELECT CAST(b.band AS BIGINT) AS band, count(p.band) AS attempts,
        round(coalesce(avg(CASE WHEN primary_outcome = 'receptive_conversation' THEN 1.0 WHEN p.band IS NOT NULL THEN 0.0 END), 0.0), 6)
            AS receptive_rate,
        round(coalesce(avg(CAST(follow_up_requested AS DOUBLE)), 0.0), 6) AS follow_up_rate,
        round(coalesce(avg(CAST(service_booked AS DOUBLE)), 0.0), 6) AS service_booked_rate
    FROM bands b LEFT JOIN placed p ON b.band = p.band GROUP BY b.band""")
def band_lift(t: Tables):
    valid, _ = outcomes.validate_outcomes(t.v_outcome)
    return outcomes.band_lift(valid, [13, 19.5, 28, 45.1, 100.5]).select(
        F.col("band").cast("bigint").alias("band"), "attempts",
        *[F.round(c, 6).alias(c) for c in ("receptive_rate", "follow_up_rate", "service_booked_rate")],
    )


@query("a25_spend_ledger", """SELECT coalesce(source, 'total') AS source, CAST(sum(units) AS BIGINT) AS units, round(sum(usd), 4) AS usd
    FROM v_spend GROUP BY ROLLUP (source)""")
def spend_ledger(t: Tables):
    return outcomes.spend_ledger(t.v_spend).select(
        F.coalesce("source", F.lit("total")).alias("source"), "units", F.round("usd", 4).alias("usd")
    )


@query("a26_match_summary", f"""WITH {_match_sql()},
    roof AS (SELECT *, has_detail AND ((l_partkey % 2 <> 0 AND description LIKE 'roof %') OR l_partkey % 3 = 0) AS explicit
             FROM matched),
    dup AS (SELECT territory_id, count(*) AS n FROM known WHERE n > 1 GROUP BY territory_id),
    doors AS (SELECT territory_id, count(*) AS n FROM v_parcel_raw GROUP BY territory_id)
    SELECT r.territory_id, max(o.n) AS properties_total, count(*) AS records_total,
        count(*) FILTER (WHERE r.n = 1) AS records_matched, count(*) FILTER (WHERE r.n = 0) AS records_unmatched,
        count(*) FILTER (WHERE r.n > 1) AS records_ambiguous, count(*) FILTER (WHERE r.n = 1 AND has_detail) AS details_collected,
        count(*) FILTER (WHERE r.n = 1 AND explicit) AS explicit_roof_records,
        count(DISTINCT pin) FILTER (WHERE r.n = 1) AS properties_with_matches,
        count(DISTINCT pin) FILTER (WHERE r.n = 1 AND explicit) AS properties_with_explicit_roof,
        coalesce(max(d.n), 0) AS duplicate_address_keys,
        count(*) FILTER (WHERE r.n = 1) - count(*) FILTER (WHERE r.n = 1 AND explicit) AS keyword_only_records
    FROM roof r JOIN doors o ON r.territory_id = o.territory_id LEFT JOIN dup d ON r.territory_id = d.territory_id
    GROUP BY r.territory_id""")
def match_summary(t: Tables):
    t = t.landed()
    return history.match_summary(matched(t), t.v_parcel_raw)


@query("a27_history_summary", f"""WITH {ENRICHED_SQL},
    doors AS (SELECT territory_id, count(*) AS n FROM v_parcel GROUP BY 1),
    pages AS (SELECT territory_id, count(*) FILTER (WHERE collection_status = 'collected') AS n FROM v_portal GROUP BY 1),
    counted AS (SELECT territory_id, count(*) AS permits_total,
        count(*) FILTER (WHERE source_scope = 'roof_keyword_search_supplement') AS supplements, count(detail) AS details_attached,
        count(DISTINCT pams_pin) AS properties_with_permits FROM enriched GROUP BY 1)
    SELECT d.territory_id, d.n AS properties_total, coalesce(p.n, 0) AS pages_collected,
        coalesce(permits_total, 0) AS permits_total, coalesce(supplements, 0) AS supplements,
        coalesce(details_attached, 0) AS details_attached, coalesce(properties_with_permits, 0) AS properties_with_permits
    FROM doors d LEFT JOIN pages p ON d.territory_id = p.territory_id LEFT JOIN counted c ON d.territory_id = c.territory_id""")
def history_summary(t: Tables):
    t = t.landed()
    enriched = history.enrich_applications(t.v_portal_permit, t.v_roof_permit)
    return history.history_summary(t.v_parcel, t.v_portal, enriched).select(
        "territory_id", "properties_total", "pages_collected", "permits_total", "supplements", "details_attached",
        "properties_with_permits",
    )


@query("a29_provenance", f"""WITH {DEED_SQL}, {ROUTED_SQL.replace('parcels AS', 'rparcels AS').replace('FROM parcels', 'FROM rparcels')},
    {PLACED_SQL}, landed AS (SELECT DISTINCT pams_pin FROM routed WHERE pams_pin IS NOT NULL)
    SELECT d.pams_pin, concat_ws(',', CASE WHEN g.geoid <> 'BG24' THEN 'acs' END, 'parcel',
        CASE WHEN l.pams_pin IS NOT NULL THEN 'permits' END,
        CASE WHEN d.pams_pin IN (SELECT pams_pin FROM v_rental) THEN 'rental' END,
        CASE WHEN d.newer THEN 'sales' END) AS signals
    FROM deeds d LEFT JOIN placed g ON d.pams_pin = g.pams_pin LEFT JOIN landed l ON d.pams_pin = l.pams_pin WHERE d.prop_class = '2'""")
def provenance(t: Tables):
    return resolved(t)["doors"].select(
        "pams_pin", F.array_join(F.sort_array(F.map_keys("provenance")), ",").alias("signals")
    )


@query("a30_source_attribution", f"""SELECT pams_pin, CASE WHEN bool_or(source = 'SDL') THEN '{facts.SOURCE_PORTAL}' ELSE '' END
    || CASE WHEN bool_or(source = 'SDL') AND bool_or(source = 'statewide') THEN ' + ' ELSE '' END
    || CASE WHEN bool_or(source = 'statewide') THEN '{facts.SOURCE_STATEWIDE}' ELSE '' END AS attribution
    FROM v_permit GROUP BY pams_pin""")
def source_attribution(t: Tables):
    found = t.v_permit.groupBy("pams_pin").agg(
        F.bool_or(F.col("source") == "SDL").alias("p"), F.bool_or(F.col("source") == "statewide").alias("s")
    )
    return found.select("pams_pin", facts.permit_source(F.col("p"), F.col("s")).alias("attribution"))


@query("a31_permit_briefs", f"""WITH {DEDUPE_SQL},
    roof AS (SELECT *, row_number() OVER (PARTITION BY pams_pin ORDER BY place) AS n,
                    count(*) OVER (PARTITION BY pams_pin) AS c FROM deduped WHERE description LIKE '%roof%')
    SELECT pams_pin, string_agg(description || ', issued ' || CAST(issue_date AS STRING), '; ' ORDER BY place)
        || CASE WHEN max(c) > 3 THEN '; and ' || CAST(max(c) - 3 AS STRING) || ' more' ELSE '' END AS briefs
    FROM roof WHERE n <= 3 GROUP BY pams_pin""")
def permit_briefs(t: Tables):
    found = facts.permit_facts(facts.classify_permits(scorer_permits(t), None, AS_OF)).filter("roof_records > 0")
    return found.select("pams_pin", facts.briefs(F.col("roof_briefs"), F.col("roof_records"), 3).alias("briefs"))


_STREET_OF = """CASE k % 8 WHEN 0 THEN 'OAK' WHEN 1 THEN 'ELM' WHEN 2 THEN 'MAIN' WHEN 3 THEN 'FAWN HILL' WHEN 4 THEN 'E CEDAR'
    WHEN 5 THEN 'COURT' WHEN 6 THEN 'NORTH PINE' ELSE 'MOMAR' END || ' ' || CASE k % 5 WHEN 0 THEN 'ST' WHEN 1 THEN 'ST.'
    WHEN 2 THEN 'AVE' WHEN 3 THEN 'AVE' ELSE 'TER' END || CASE WHEN k % 17 <> 0 AND k % 19 = 0 THEN ' #2' ELSE '' END"""


@query("a32_doors_per_street", f"""SELECT territory_id, street, doors FROM (
    SELECT territory_id, street, doors, row_number() OVER (PARTITION BY territory_id ORDER BY doors DESC, street) AS n FROM (
        SELECT territory_id, {_STREET_OF} AS street, count(*) AS doors FROM v_situs GROUP BY 1, 2) AS c WHERE doors >= 4) AS r
    WHERE n <= 8""")
def doors_per_street(t: Tables):
    return resolve.doors_per_street(t.v_situs, before_unit=True).select("territory_id", "street", "doors")


