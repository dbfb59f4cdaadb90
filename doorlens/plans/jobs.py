"""Composite jobs (X), sinks (K) and the checks over their results."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from doorlens.operators import documents, filters, history, imagery, outcomes, permits, publish, report, resolve, route, spatial
from doorlens.plans.aggregates import (
    OUTCOME_SQL, PROJECT_SQL, RATES, RATES_SQL, ACCOUNT_SQL, VISION_SQL, _GAPS, resolved, scorer_permits,
)
from doorlens.plans.analogs import AS_OF, AS_OF_SQL, Tables
from doorlens.plans.joins import (
    COALESCED_SQL, DEED_SQL, ENRICHED_SQL, NEAR_SQL, PLACED_SQL, ROUTED_SQL, _match_sql, matched,
)
from doorlens.plans.registry import query
from doorlens.plans.scalars import ADDRESS_SQL, HAVERSINE_SQL, KEY_SQL, STRENGTH_SQL
from doorlens.plans.windows import SALES_FACTS_SQL, _TRAIL, scorer_sales, trail
from doorlens.scoring import engine, facts
from doorlens.session import land

A = AS_OF_SQL
DOOR = facts.DOOR


# --- resolution -----------------------------------------------------------------------------


@query("x1_resolve_doors", f"""WITH {DEED_SQL}, {ROUTED_SQL.replace('parcels AS', 'rparcels AS').replace('FROM parcels', 'FROM rparcels')},
    {PLACED_SQL}, landed AS (SELECT pams_pin, count(*) AS n FROM routed WHERE pams_pin IS NOT NULL GROUP BY pams_pin)
    SELECT d.pams_pin, CAST(d.deed_day AS STRING) AS deed_day, d.price, d.source AS deed_source, coalesce(l.n, 0) AS permit_count,
        coalesce(g.geoid <> 'BG24', false) AS has_block_group, d.pams_pin IN (SELECT pams_pin FROM v_rental) AS is_rental,
        {KEY_SQL.replace('mun', 'd.mun').replace('block', 'd.block').replace('lot', 'd.lot').replace('d.bd.lotck', 'd.block')}
            AS parcel_key,
        {ADDRESS_SQL.replace('k %', 'd.k %')} AS address_key
    FROM deeds d LEFT JOIN placed g ON d.pams_pin = g.pams_pin LEFT JOIN landed l ON d.pams_pin = l.pams_pin WHERE d.prop_class = '2'""")
def resolve_doors(t: Tables):
    return resolved(t)["doors"].select(
        "pams_pin", F.col("deed.deed_day").cast("string").alias("deed_day"), F.col("deed.price").alias("price"),
        F.col("deed.source").alias("deed_source"), "permit_count", "has_block_group", "is_rental", "parcel_key", "address_key",
    )


@query("x1_resolve_report", f"""WITH {ACCOUNT_SQL},
    homes AS (SELECT mun, count(*) AS doors_total FROM v_parcel_raw WHERE prop_class = '2' GROUP BY mun)
    SELECT c.mun, doors_total, permits_total, permits_in_window, permits_unmatched, {RATES_SQL}
    FROM counted c JOIN totals t ON c.mun = t.mun JOIN homes d ON c.mun = d.mun""")
def resolve_report(t: Tables):
    return resolved(t)["report"].select(
        "mun", "doors_total", "permits_total", "permits_in_window", "permits_unmatched",
        *[F.round(r, 6).alias(r) for r in RATES],
    )


@query("x2_build_permits", f"""WITH {COALESCED_SQL.replace('FROM v_statewide', '''FROM (SELECT * FROM v_statewide s WHERE NOT EXISTS (
        SELECT 1 FROM (SELECT pams_pin, issue_date AS d FROM v_permit WHERE source = 'SDL'
                       UNION ALL SELECT pams_pin, issue_date FROM v_roof_permit WHERE issue_date IS NOT NULL) AS kk
        WHERE kk.pams_pin = s.pams_pin AND kk.d = s.issue_date)) AS sw''')}
    SELECT pams_pin, mid AS municipal_id, description, disposition, CAST(statewide_day AS STRING) AS statewide_issue_date,
        from_portal, from_statewide FROM coalesced""")
def build_permits(t: Tables):
    t = t.landed()
    return permits.coalesce_permits(t.v_portal_permit, t.v_roof_permit, t.v_statewide).select(
        "pams_pin", "municipal_id", "description", "disposition",
        F.col("statewide_issue_date").cast("string").alias("statewide_issue_date"), "from_portal", "from_statewide",
    )


# --- scoring ------------------------------------------------------------------------------------


def score_inputs(t: Tables) -> dict:
    """The scorer's tables over the derived parcels. Rental lists and imagery are off in one territory each."""
    t = t.landed()
    pages = t.v_portal.select("pams_pin", (F.col("collection_status") == "collected").alias("sdl_page_available"))
    doors = (
        t.v_parcel.join(t.v_acs_stats, "geoid", "left").join(pages, "pams_pin", "left")
        .select(
            *DOOR, F.lit(AS_OF).alias("as_of"), F.when(F.col("net_value") > 0, F.col("net_value")).alias("assessed_value"),
            F.when(F.col("yr_constr") > 0, F.col("yr_constr")).alias("construction_year"),
            F.col("calc_acre").alias("lot_acres"), "dual_income_pct",
            F.coalesce("sdl_page_available", F.lit(False)).alias("sdl_page_available"),
            (F.col("territory_id") != 4).alias("rental_available"), (F.col("territory_id") != 3).alias("imagery_available"),
        )
    )
    homes = spatial.valid_single_family(t.v_parcel)
    return {
        "doors": doors, "sales": scorer_sales(t, landed=False), "permits": scorer_permits(t, landed=False),
        "comparables": spatial.nearest_comparables(t.v_parcel),
        "values": homes.select("territory_id", F.col("net_value").alias("value")), "rental": t.v_rental,
        "observed": imagery.observations(imagery.imagery_signals(t.v_detection)),
    }


SCORE_SQL = f"""{PROJECT_SQL}, {NEAR_SQL}, {SALES_FACTS_SQL}, {VISION_SQL},
    comps AS (SELECT pams_pin, count(*) AS comps, median(value) AS comp_median FROM near GROUP BY pams_pin),
    list AS (SELECT territory_id, net_value AS value FROM v_parcel WHERE prop_class = '2' AND net_value > 0 AND lon IS NOT NULL),
    rental AS (SELECT pams_pin, max(reg_date) AS reg FROM v_rental GROUP BY pams_pin),
    facts AS (SELECT p.territory_id, p.pams_pin, CASE WHEN net_value > 0 THEN net_value END AS assessed, p.yr_constr AS yr,
            p.calc_acre AS acre, a.dual_income_pct AS dual, coalesce(g.collection_status = 'collected', false) AS page,
            p.territory_id <> 4 AS rent_on, p.territory_id <> 3 AS img_on, coalesce(d.permits, 0) AS permits,
            coalesce(d.projects, 0) AS projects, d.roof_when, coalesce(d.roof_records, 0) AS roof_records,
            coalesce(d.pool_permits, 0) AS pool_permits, coalesce(d.solar_permits, 0) AS solar_permits,
            coalesce(c.comps, 0) AS comps, c.comp_median, s.last_sale, coalesce(s.invalid_sales, 0) AS invalid_sales, s.last_source,
            r.reg, coalesce(v.pool, false) AS pool_img, coalesce(v.solar, false) AS solar_img,
            coalesce(list_position(['poor', 'fair', 'good', 'excellent'], v.c2020)
                     < list_position(['poor', 'fair', 'good', 'excellent'], v.c2015), false) AS declined,
            (SELECT count(*) FILTER (WHERE l.value < net_value) + 0.5 * count(*) FILTER (WHERE l.value = net_value)
             FROM list l WHERE l.territory_id = p.territory_id) / nullif((SELECT count(*) FROM list l
             WHERE l.territory_id = p.territory_id), 0) * 100.0 AS pct
        FROM v_parcel p LEFT JOIN v_acs_stats a ON p.geoid = a.geoid LEFT JOIN v_portal g ON p.pams_pin = g.pams_pin
            LEFT JOIN per_door d ON p.pams_pin = d.pams_pin LEFT JOIN comps c ON p.pams_pin = c.pams_pin
            LEFT JOIN sale_facts s ON p.pams_pin = s.pams_pin LEFT JOIN rental r ON p.pams_pin = r.pams_pin
            LEFT JOIN vision v ON p.pams_pin = v.pams_pin),
    points AS (SELECT *, 15 * projects AS project_raw, least(15 * projects, 45) AS project,
            CASE WHEN assessed IS NULL OR comps < 10 THEN 0 WHEN assessed / comp_median >= 1.5 THEN 10
                 WHEN assessed / comp_median >= 1.2 THEN 7 WHEN assessed / comp_median > 1.0 THEN 3 ELSE 0 END AS local_pts,
            CASE WHEN assessed IS NULL THEN 0 WHEN pct >= 90 THEN 10 WHEN pct >= 75 THEN 7 WHEN pct >= 50 THEN 3 ELSE 0 END
                AS pct_pts,
            CASE WHEN dual >= 0.35 THEN 5 ELSE 0 END AS acs_pts,
            2001 - extract(year FROM roof_when) - CASE WHEN extract(month FROM roof_when) * 100 + extract(day FROM roof_when) > 630
                THEN 1 ELSE 0 END AS roof_age,
            CASE WHEN yr <= 0 OR yr > 2001 THEN 0 WHEN 2001 - yr >= 75 THEN 10 WHEN 2001 - yr >= 50 THEN 8
                 WHEN 2001 - yr >= 30 THEN 5 ELSE 0 END AS home_pts,
            CASE WHEN img_on AND declined THEN 8 ELSE 0 END AS decline_pts,
            CASE WHEN pool_permits > 0 OR (img_on AND pool_img) THEN 8 ELSE 0 END AS pool_pts,
            CASE WHEN solar_permits > 0 OR (img_on AND solar_img) THEN 5 ELSE 0 END AS solar_pts,
            CASE WHEN acre >= 0.5 THEN 5 ELSE 0 END AS lot_pts, {A} - last_sale AS days,
            rent_on AND coalesce(CASE WHEN last_sale IS NOT NULL THEN reg >= last_sale ELSE reg >= DATE '1999-06-30' END, false)
                AS rent_current,
            rent_on AND NOT coalesce(CASE WHEN last_sale IS NOT NULL THEN reg >= last_sale ELSE reg >= DATE '1999-06-30' END, true)
                AS rent_stale
        FROM facts),
    summed AS (SELECT *, least(local_pts + pct_pts + acs_pts, 25) AS capacity,
            CASE WHEN roof_age >= 20 THEN 12 WHEN roof_age >= 15 THEN 8 WHEN roof_age >= 10 THEN 4 ELSE 0 END AS roof_pts,
            {STRENGTH_SQL.format(d='days')} AS strength FROM points),
    fitted AS (SELECT *, least(roof_pts + home_pts + decline_pts + pool_pts + solar_pts + lot_pts, 48) AS fit FROM summed),
    based AS (SELECT *, CAST(project + capacity + fit AS DOUBLE) AS base FROM fitted),
    lifted AS (SELECT *, strength / 90.0 * (90.0 + base / 8.0 - base) AS lift,
            CASE WHEN rent_current THEN -25 ELSE 0 END AS rental_modifier FROM based),
    totalled AS (SELECT *, base + lift + rental_modifier AS pre FROM lifted),
    scored AS (SELECT *, floor(CASE WHEN pre < 0 THEN 0 WHEN pre > 100 THEN 100 ELSE pre END + 0.5) AS score,
            concat_ws(',', CASE WHEN dual IS NULL THEN 'acs_missing' END,
                CASE WHEN assessed IS NULL THEN 'assessed_value_missing' END,
                CASE WHEN NOT img_on THEN 'imagery_missing' END,
                CASE WHEN assessed IS NOT NULL AND comps < 10 THEN 'local_comparables_insufficient' END,
                CASE WHEN NOT rent_on THEN 'rental_data_missing' END,
                CASE WHEN NOT page THEN 'sdl_page_unavailable' END) AS gaps FROM totalled)"""
LONGS = ("project", "capacity", "fit", "base", "rental_modifier", "score")


@query("x3_score_doors", f"""WITH {SCORE_SQL} SELECT territory_id, pams_pin, {', '.join(f'CAST({c} AS BIGINT) AS {c}' for c in LONGS)},
    last_sale IS NOT NULL AS mover_eligible, coalesce(days, -1) AS days_since_move, round(strength, 6) AS mover_strength,
    round(lift, 6) AS mover_lift, round(pre, 6) AS pre_rounding, round(score - pre, 6) AS adjustment,
    CASE WHEN len(gaps) - len(replace(gaps, ',', '')) >= 1 THEN 'low' ELSE 'normal' END AS confidence, gaps FROM scored""")
def score_doors(t: Tables):
    return engine.score(**score_inputs(t))["doors"].select(
        *DOOR, *[F.col(c).cast("bigint").alias(c) for c in LONGS], "mover_eligible",
        F.coalesce("days_since_move", F.lit(-1)).cast("bigint").alias("days_since_move"),
        *[F.round(c, 6).alias(c) for c in ("mover_strength", "mover_lift", "pre_rounding", "adjustment")], "confidence",
        F.array_join(F.array_sort("data_gaps"), ",").alias("gaps"),
    )


EVIDENCE_SQL = f"""{SCORE_SQL}, evidence AS (
    SELECT f.pams_pin, CASE WHEN f.active THEN 'project_active' ELSE 'project_completed' END AS type, 15.0 AS points
        FROM flagged f WHERE f.active OR f.completed
    UNION ALL SELECT pams_pin, 'project_cap_adjustment', project - project_raw FROM scored WHERE project_raw > 45
    UNION ALL SELECT pams_pin, 'project_neutralized', 0 FROM scored WHERE permits > 0 AND project = 0
    UNION ALL SELECT pams_pin, 'capacity_local_relative_value', local_pts FROM scored WHERE local_pts > 0
    UNION ALL SELECT pams_pin, 'capacity_territory_percentile', pct_pts FROM scored WHERE pct_pts > 0
    UNION ALL SELECT pams_pin, 'capacity_acs_dual_income_prior', acs_pts FROM scored WHERE acs_pts > 0
    UNION ALL SELECT pams_pin, 'fit_roof_age', roof_pts FROM scored WHERE roof_when IS NOT NULL OR roof_records > 0
    UNION ALL SELECT pams_pin, 'fit_home_age', home_pts FROM scored WHERE home_pts > 0
    UNION ALL SELECT pams_pin, 'fit_condition_decline', decline_pts FROM scored WHERE decline_pts > 0
    UNION ALL SELECT pams_pin, 'fit_pool', pool_pts FROM scored WHERE pool_pts > 0
    UNION ALL SELECT pams_pin, 'fit_solar', solar_pts FROM scored WHERE solar_pts > 0
    UNION ALL SELECT pams_pin, 'fit_lot', lot_pts FROM scored WHERE lot_pts > 0
    UNION ALL SELECT pams_pin, 'mover_invalid_sale', 0 FROM scored WHERE invalid_sales > 0
    UNION ALL SELECT pams_pin, 'mover_recency', lift FROM scored WHERE lift > 0
    UNION ALL SELECT pams_pin, 'rental_registration', -25 FROM scored WHERE rent_current
    UNION ALL SELECT pams_pin, 'rental_stale', 0 FROM scored WHERE rent_stale)"""


@query("u2_union_of_evidence", f"""WITH {EVIDENCE_SQL} SELECT pams_pin, type, count(*) AS entries, round(sum(points), 6) AS points
    FROM evidence GROUP BY pams_pin, type""")
def union_of_evidence(t: Tables):
    return engine.score(**score_inputs(t))["evidence"].groupBy("pams_pin", "type").agg(
        F.count(F.lit(1)).alias("entries"), F.round(F.sum("points"), 6).alias("points")
    )


@query("k4_evidence_table", f"""WITH {EVIDENCE_SQL} SELECT e.pams_pin, count(*) AS entries, CAST(max(0) AS BIGINT) AS first_seq,
    count(*) - 1 AS last_seq FROM evidence e GROUP BY e.pams_pin""")
def evidence_table(t: Tables):
    scored = engine.score(**score_inputs(t))
    table = publish.evidence_table(scored["evidence"], scored["doors"])
    return table.groupBy("pams_pin").agg(
        F.countDistinct("seq").alias("entries"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq")
    )


@query("a12_reconciliation", """SELECT territory_id, count(*) AS doors, CAST(0 AS BIGINT) AS unreconciled FROM v_parcel
    GROUP BY territory_id""")
def reconciliation(t: Tables):
    scored = engine.score(**score_inputs(t))
    doors = scored["doors"]
    bad = report.unreconciled(doors, scored["evidence"]).select(*DOOR).withColumn("bad", F.lit(1))
    return doors.join(bad, DOOR, "left").groupBy("territory_id").agg(
        F.count(F.lit(1)).alias("doors"), F.count("bad").alias("unreconciled")
    )


@query("x4_project_category", f"""WITH {PROJECT_SQL} SELECT pams_pin, CASE WHEN active THEN 'project_active' ELSE 'project_completed'
    END AS type, row_number() OVER (PARTITION BY pams_pin ORDER BY place) - 1 AS seq, CASE WHEN active
    THEN 'open municipal project with activity in the last 12 months: ' ELSE 'project completed ' || CAST(done AS STRING)
        || ', within 24 months: ' END || description || ', issued ' || CAST(issue_date AS STRING) AS reason
    FROM flagged WHERE active OR completed""")
def project_category(t: Tables):
    return engine.project_evidence(facts.classify_permits(scorer_permits(t), None, AS_OF)).select(
        "pams_pin", "type", "seq", "reason"
    )


@query("x5_capacity_category", f"""WITH {SCORE_SQL} SELECT pams_pin, CAST(capacity AS BIGINT) AS capacity,
    CAST(local_pts AS BIGINT) AS local_points, CAST(pct_pts AS BIGINT) AS percentile_points, CAST(acs_pts AS BIGINT) AS acs_points
    FROM scored""")
def capacity_category(t: Tables):
    wide = engine.score(**score_inputs(t))["wide"]
    return wide.select("pams_pin", *[F.col(c).cast("bigint").alias(c) for c in (
        "capacity", "local_points", "percentile_points", "acs_points")])


@query("x6_fit_category", f"""WITH {SCORE_SQL} SELECT pams_pin, CAST(fit AS BIGINT) AS fit, CAST(roof_pts AS BIGINT) AS roof_points,
    CAST(home_pts AS BIGINT) AS home_points, CAST(decline_pts AS BIGINT) AS decline_points, CAST(pool_pts AS BIGINT) AS pool_points,
    CAST(solar_pts AS BIGINT) AS solar_points, CAST(lot_pts AS BIGINT) AS lot_points FROM scored""")
def fit_category(t: Tables):
    wide = engine.score(**score_inputs(t))["wide"]
    return wide.select("pams_pin", *[F.col(c).cast("bigint").alias(c) for c in (
        "fit", "roof_points", "home_points", "decline_points", "pool_points", "solar_points", "lot_points")])


@query("x7_mover", f"""WITH {SALES_FACTS_SQL}, m AS (SELECT p.pams_pin, last_sale, last_source, coalesce(invalid_sales, 0) AS invalid,
        {A} - last_sale AS days FROM v_parcel p LEFT JOIN sale_facts s ON p.pams_pin = s.pams_pin)
    SELECT pams_pin, last_sale IS NOT NULL AS mover_eligible, coalesce(days, -1) AS days_since_move,
        round({STRENGTH_SQL.format(d='days')}, 6) AS mover_strength, invalid > 0 AS has_invalid_sale FROM m""")
def mover(t: Tables):
    wide = engine.score(**score_inputs(t))["wide"]
    return wide.select(
        "pams_pin", "mover_eligible", F.coalesce("days_since_move", F.lit(-1)).cast("bigint").alias("days_since_move"),
        F.round("mover_strength", 6).alias("mover_strength"),
        (F.coalesce("invalid_sales", F.lit(0)) > 0).alias("has_invalid_sale"),
    )


@query("x8_rental_modifier", f"""WITH {SCORE_SQL} SELECT pams_pin, CAST(rental_modifier AS BIGINT) AS rental_modifier,
    rent_stale AS rental_stale FROM scored""")
def rental_modifier(t: Tables):
    wide = engine.score(**score_inputs(t))["wide"]
    return wide.select("pams_pin", F.col("rental_modifier").cast("bigint").alias("rental_modifier"), "rental_stale")


@query("x9_data_gaps", f"""WITH {SCORE_SQL} SELECT pams_pin, unnest(string_split(gaps, ',')) AS gap FROM scored WHERE gaps <> ''""")
def data_gaps(t: Tables):
    return engine.score(**score_inputs(t))["gaps"].select("pams_pin", "gap")


@query("x10_feature_corroboration", f"""WITH {SCORE_SQL} SELECT pams_pin, CASE WHEN pool_permits > 0 AND img_on AND pool_img THEN 'both'
    WHEN pool_permits > 0 THEN 'permit' ELSE 'imagery' END AS pool_basis FROM scored WHERE pool_pts > 0""")
def feature_corroboration(t: Tables):
    evidence = engine.score(**score_inputs(t))["evidence"].filter("type = 'fit_pool'")
    basis = F.when(F.col("reason").contains("confirmed in aerial imagery"), "both").when(
        F.col("reason").contains("visible in aerial imagery"), "imagery").otherwise("permit")
    return evidence.select("pams_pin", basis.alias("pool_basis"))


@query("k3_doors_table", f"""WITH {SCORE_SQL}, bare AS (SELECT p.pams_pin FROM v_parcel p JOIN v_parcel_raw r ON p.k = r.k
        WHERE (r.deed_date IS NULL OR r.deed_date = '991332') AND p.yr_constr <= 0 AND p.net_value <= 0)
    SELECT s.pams_pin, CASE WHEN b.pams_pin IS NULL THEN CAST(s.score AS BIGINT) ELSE -1 END AS score,
        CASE WHEN b.pams_pin IS NOT NULL THEN 'parcel record incomplete in county data' END AS exclusion_reason,
        'v2' AS score_contract_version FROM scored s LEFT JOIN bare b ON s.pams_pin = b.pams_pin""")
def doors_table(t: Tables):
    t = t.landed()
    from doorlens.functions import dates

    raw = t.v_parcel_raw.select("k", dates.deed_date(F.col("deed_date"), AS_OF).alias("deed_day"),
                                F.col("address").alias("situs"))
    resolved_doors = filters.with_exclusion(t.v_parcel.join(raw, "k"))
    return publish.doors_table(resolved_doors, engine.score(**score_inputs(t))["doors"]).select(
        "pams_pin", F.coalesce("score", F.lit(-1)).cast("bigint").alias("score"), "exclusion_reason", "score_contract_version"
    )


_BARE = """bare AS (SELECT p.pams_pin FROM v_parcel p JOIN v_parcel_raw r ON p.k = r.k
        WHERE (r.deed_date IS NULL OR r.deed_date = '991332') AND p.yr_constr <= 0 AND p.net_value <= 0)"""


@query("x3_published_run", f"""WITH {EVIDENCE_SQL}, {_BARE},
    trail AS (SELECT pams_pin, count(*) AS entries, round(sum(points), 6) AS points FROM evidence GROUP BY pams_pin)
    SELECT s.territory_id, s.pams_pin, v.situs, CASE WHEN b.pams_pin IS NULL THEN CAST(s.score AS BIGINT) END AS score,
        CASE WHEN b.pams_pin IS NOT NULL THEN 'parcel record incomplete in county data' END AS exclusion_reason, 'v2' AS score_contract_version,
        CASE WHEN b.pams_pin IS NULL THEN coalesce(t.entries, 0) ELSE 0 END AS entries, CASE WHEN b.pams_pin IS NULL THEN coalesce(t.points, 0.0) ELSE 0.0 END AS points
    FROM scored s JOIN v_situs v ON s.pams_pin = v.pams_pin LEFT JOIN bare b ON s.pams_pin = b.pams_pin LEFT JOIN trail t ON s.pams_pin = t.pams_pin""")
def published_run(t: Tables):
    """Scored, published and read back: each door with what its published evidence adds up to."""
    from doorlens.functions import dates
    from doorlens.operators import run
    from doorlens.plans.landed import folder

    t = t.landed()
    raw = t.v_parcel_raw.select("k", dates.deed_date(F.col("deed_date"), AS_OF).alias("deed_day"))
    resolved_doors = filters.with_exclusion(t.v_parcel.join(raw, "k").join(t.v_situs.select("pams_pin", "situs"), "pams_pin"))
    tables = run.publish_scored(resolved_doors, score_inputs(t), imagery.imagery_signals(t.v_detection), folder(t, "runs"), "run-1")
    trail = tables["evidence"].groupBy("territory_id", "pams_pin").agg(F.count(F.lit(1)).alias("entries"), F.round(F.sum("points"), 6).alias("points"))
    return tables["doors"].join(trail, DOOR, "left").select(
        *DOOR, "situs", F.col("score").cast("bigint").alias("score"), "exclusion_reason", "score_contract_version",
        F.coalesce("entries", F.lit(0)).alias("entries"), F.coalesce("points", F.lit(0.0)).alias("points"))


@query("w11_roof_extract", f"""WITH {SCORE_SQL} SELECT s.territory_id, CAST(roof_pts AS DOUBLE) AS roof_points, v.situs AS address,
    CAST(roof_when AS STRING) AS roof_installed, CAST(roof_age AS BIGINT) AS roof_age_years, CAST(score AS BIGINT) AS house_score
    FROM scored s JOIN v_situs v ON s.pams_pin = v.pams_pin WHERE roof_pts > 0""")
def roof_extract(t: Tables):
    out = engine.score(**score_inputs(t))
    doors = out["wide"].join(t.v_situs.select("pams_pin", "situs"), "pams_pin")
    return publish.roof_extract(out["evidence"], doors).select(
        "territory_id", F.col("roof_points").cast("double").alias("roof_points"), "address", F.col("roof_installed").cast("string").alias("roof_installed"),
        F.col("roof_age_years").cast("bigint").alias("roof_age_years"), F.col("house_score").cast("bigint").alias("house_score"))


# --- reports ----------------------------------------------------------------------------------------


@query("a17_exclusion_counts", f"""WITH {PROJECT_SQL}, {SALES_FACTS_SQL} SELECT p.territory_id,
    count(*) FILTER (WHERE d.permits > 0 AND d.projects = 0) AS stale_open_neutralized,
    count(*) FILTER (WHERE s.invalid_sales > 0) AS non_arms_length_sales
    FROM v_parcel p LEFT JOIN per_door d ON p.pams_pin = d.pams_pin LEFT JOIN sale_facts s ON p.pams_pin = s.pams_pin
    GROUP BY p.territory_id""")
def exclusion_counts(t: Tables):
    return report.exclusions(engine.score(**score_inputs(t))["evidence"])


_DECILES = ", ".join(f"round(quantile_cont(CAST(score AS DOUBLE), {n / 100}), 6) AS q{n}" for n in range(10, 100, 10))
_SPREADS = ", ".join(f"round({f}(CASE WHEN score IS NOT NULL THEN CAST({c} AS DOUBLE) END), 6) AS {c}_{n}" for c in ("project", "capacity", "fit", "score")
                     for n, f in (("min", "min"), ("max", "max"), ("mean", "avg")))


@query("x11_score_report", f"""WITH miss AS (SELECT territory_id, string_agg(gap || '=' || CAST(n AS STRING), ',' ORDER BY gap)
        AS missing FROM (SELECT territory_id, gap, count(*) AS n FROM ({_GAPS}) AS g GROUP BY 1, 2) AS c GROUP BY 1),
    chips AS (SELECT territory_id, count(*) FILTER (WHERE type = 'mover_invalid_sale') AS non_arms_length_sales,
              count(*) FILTER (WHERE type = 'project_neutralized') AS stale_open_neutralized FROM ({_TRAIL}) AS t GROUP BY 1),
    seen AS (SELECT event_id % 5 AS territory_id, count(*) FILTER (WHERE NOT probe AND actual AND predicted) AS tp,
             count(*) FILTER (WHERE NOT probe AND NOT actual AND predicted) AS fp, count(*) FILTER (WHERE NOT probe AND actual AND NOT predicted) AS fn,
             count(*) FILTER (WHERE probe AND predicted) AS pc, count(*) FILTER (WHERE probe) AS pr FROM v_label GROUP BY 1),
    fresh AS (SELECT territory_id, 'deeds=' || CAST(max(sale_day) AS STRING) AS source_freshness FROM v_sale GROUP BY 1),
    lost AS (SELECT territory_id, count(*) FILTER (WHERE disposition IN ('voided', 'administrative')) AS voided_or_admin,
             count(*) FILTER (WHERE source = 'statewide') AS cross_source_dedup_collapsed FROM v_permit GROUP BY 1)
    SELECT d.territory_id, count(*) AS doors_total, count(score) AS doors_scored, count(*) - count(score) AS doors_unscored,
        round(count(score) / CAST(count(*) AS DOUBLE), 6) AS coverage, {_SPREADS}, {_DECILES},
        max(missing) AS missing, coalesce(max(non_arms_length_sales), 0) AS non_arms_length_sales, coalesce(max(stale_open_neutralized), 0) AS stale_open_neutralized,
        coalesce(max(voided_or_admin), 0) AS voided_or_admin, coalesce(max(cross_source_dedup_collapsed), 0) AS cross_source_dedup_collapsed,
        round(max(CASE WHEN tp + fp = 0 THEN 0.0 ELSE tp / CAST(tp + fp AS DOUBLE) END), 6) AS precision,
        round(max(CASE WHEN tp + fn = 0 THEN 0.0 ELSE tp / CAST(tp + fn AS DOUBLE) END), 6) AS recall,
        round(max(CASE WHEN pr = 0 THEN 0.0 ELSE pc / CAST(pr AS DOUBLE) END), 6) AS hallucination_rate, max(source_freshness) AS source_freshness
    FROM v_door_score d LEFT JOIN miss m ON d.territory_id = m.territory_id LEFT JOIN chips c ON d.territory_id = c.territory_id
    LEFT JOIN seen s ON d.territory_id = s.territory_id AND tp IS NOT NULL LEFT JOIN fresh f ON d.territory_id = f.territory_id
    LEFT JOIN lost l ON d.territory_id = l.territory_id GROUP BY d.territory_id""")
def score_report(t: Tables):
    """The whole report with its optional blocks, every column compared."""
    lines = land(t.derived().v_permit.select("territory_id", "pams_pin", "ordinal", "disposition", "source"), "lines")
    t = t.landed()
    labels = t.v_label.withColumn("territory_id", F.col("event_id") % 5)
    retrieved = t.v_sale.select("territory_id", F.lit("deeds").alias("source"), F.col("sale_day").alias("retrieved"))
    excluded = lines.groupBy("territory_id").agg(
        F.count_if(F.col("disposition").isin("voided", "administrative")).alias("voided_or_admin"),
        F.count_if(F.col("source") == "statewide").alias("cross_source_dedup_collapsed"))
    built = report.score_report(t.v_door_score, trail(lines), t.sql(_GAPS), labels=labels, retrieved=retrieved, excluded=excluded)

    def listed(name: str):
        pairs = F.transform(F.map_entries(name), lambda e: F.concat(e.key, F.lit("="), e.value.cast("string")))
        return F.array_join(pairs, ",")

    plain = ["territory_id", "doors_total", "doors_scored", "doors_unscored", "non_arms_length_sales", "stale_open_neutralized", "voided_or_admin",
             "cross_source_dedup_collapsed"]
    rounded = [c for c in built.columns if c not in (*plain, "missing_signals", "source_freshness")]
    return built.select(*plain, *[F.round(c, 6).alias(c) for c in rounded], listed("missing_signals").alias("missing"), listed("source_freshness").alias("source_freshness"))


@query("x12_identity_findings", """SELECT 'pages' AS artifact, 'body:details.' || CASE k % 6 WHEN 0 THEN 'ownerName' WHEN 1 THEN 'permit_agent' WHEN 3 THEN 'Mailing City'
        ELSE 'is_Resident' END AS path, count(*) AS rows FROM (SELECT * FROM v_parcel WHERE k % 6 IN (0, 1, 3, 5)) AS p GROUP BY 2
    UNION ALL SELECT 'pages', 'body:details.list[].taxpayer_id', count(*) FROM v_parcel
    UNION ALL SELECT 'doors', 'owner.ownership_note', CAST(NULL AS BIGINT) UNION ALL SELECT 'doors', 'owner', CAST(NULL AS BIGINT)
    UNION ALL SELECT 'doors', 'contacts[].mail_addr', CAST(NULL AS BIGINT)""")
def identity_findings(t: Tables):
    """Columns, declared fields and keys of undeclared documents, over two published artifacts."""
    person = F.struct(F.col("pams_pin").alias("name"), F.col("pams_pin").alias("ownership_note"))
    doors = t.v_parcel.select("pams_pin", person.alias("owner"), F.array(F.struct(F.col("pams_pin").alias("mail_addr"))).alias("contacts"))
    return report.identity_findings({"doors": doors, "pages": t.sql(_JSON)}, {"pages": ("body", ["k"])})


_JSON = """SELECT k, '{"pams_pin": "' || pams_pin || '", "details": {"' || CASE k % 6 WHEN 0 THEN 'ownerName'
    WHEN 1 THEN 'permit_agent' WHEN 2 THEN 'reagent' WHEN 3 THEN 'Mailing City' WHEN 4 THEN 'roof' ELSE 'is_Resident' END
    || '": "a: b", "list": [{"taxpayer_id": ' || CAST(k AS STRING) || '}]}}' AS body FROM v_parcel"""


@query("x12_identity_scan", """SELECT 'details.' || CASE k % 6 WHEN 0 THEN 'ownerName' WHEN 1 THEN 'permit_agent' WHEN 3 THEN 'Mailing City'
    ELSE 'is_Resident' END AS path, count(*) AS rows FROM (SELECT * FROM v_parcel WHERE k % 6 IN (0, 1, 3, 5)) AS p GROUP BY 1
    UNION ALL SELECT 'details.list[].taxpayer_id', count(*) FROM v_parcel""")
def identity_scan(t: Tables):
    return documents.identity_paths(t.sql(_JSON), "body", ["k"])


@query("x13_property_history", f"""WITH {ENRICHED_SQL}, n AS (SELECT pams_pin, count(*) AS permits, count(detail) AS details FROM enriched
        GROUP BY pams_pin)
    SELECT p.pams_pin, coalesce(v.collection_status, 'not_collected') AS collection_status, coalesce(n.permits, 0) AS permits,
        coalesce(n.details, 0) AS details
    FROM v_parcel p LEFT JOIN v_portal v ON p.pams_pin = v.pams_pin LEFT JOIN n ON p.pams_pin = n.pams_pin""")
def property_history(t: Tables):
    t = t.landed()
    enriched = history.enrich_applications(t.v_portal_permit, t.v_roof_permit)
    built = history.property_history(t.v_parcel.select(*DOOR), t.v_portal, enriched)
    return built.select(
        "pams_pin", "collection_status", F.size("permits").cast("bigint").alias("permits"),
        F.size(F.filter("permits", lambda p: p.roof_detail.isNotNull())).cast("bigint").alias("details"),
    )


@query("k7_write_property_history", f"""WITH {ENRICHED_SQL}, listed AS (SELECT pams_pin, count(*) AS permits, count(detail) AS details,
        count(*) FILTER (WHERE source_scope <> 'property_page') AS supplements,
        string_agg(CAST(ordinal AS STRING) || ' ' || detail_url, ',' ORDER BY ordinal, detail_url) AS applications FROM enriched GROUP BY pams_pin),
    sums AS (SELECT p.territory_id, count(*) AS properties_total, sum(coalesce(permits, 0)) AS permits_total,
        sum(CASE WHEN v.collection_status = 'collected' THEN p.k % 3 ELSE 0 END) AS inspections_total,
        count(*) FILTER (WHERE v.collection_status = 'collected' AND p.k % 4 = 1) AS violations_total,
        count(*) FILTER (WHERE coalesce(v.collection_status, '') = 'not_collected') AS collection_errors
        FROM v_parcel p LEFT JOIN v_portal v ON p.pams_pin = v.pams_pin LEFT JOIN listed l ON p.pams_pin = l.pams_pin GROUP BY p.territory_id)
    SELECT r.territory_id, r.pams_pin, r.block, r.lot, r.address, {ADDRESS_SQL.replace('k %', 'r.k %')} AS normalized_address,
        coalesce(v.collection_status, 'not_collected') AS collection_status, coalesce(v.assessed_total, '') AS assessed_total,
        r.k % 3 AS inspections, CASE WHEN r.k % 4 = 1 THEN '[{{"kind":"fence"}}]' ELSE '[]' END AS violations, coalesce(l.permits, 0) AS permits,
        coalesce(l.details, 0) AS details, coalesce(l.supplements, 0) AS supplements, coalesce(l.applications, '') AS applications, '{{}}' AS geoareas,
        s.properties_total, CAST(s.permits_total AS BIGINT) AS permits_total, CAST(s.inspections_total AS BIGINT) AS inspections_total,
        s.violations_total, s.collection_errors
    FROM v_parcel p JOIN v_parcel_raw r ON p.k = r.k LEFT JOIN v_portal v ON p.pams_pin = v.pams_pin
        LEFT JOIN listed l ON p.pams_pin = l.pams_pin JOIN sums s ON s.territory_id = p.territory_id""")
def write_property_history(t: Tables):
    """Histories published and read back: each record's fields out of its document, beside its territory's counters."""
    from doorlens.plans.landed import folder

    t = t.landed()
    parcels = t.v_parcel.select("k", *DOOR).join(t.v_parcel_raw.select("k", "block", "lot", "address"), "k")
    seen = F.transform(F.slice(F.array(F.lit(1), F.lit(2)), 1, (F.col("k") % 3).cast("int")), lambda n: F.struct(n.alias("number")))
    broken = F.array(F.struct(F.lit("fence").alias("kind"), F.lit("A. Name").alias("permit_agent")))
    pages = t.v_portal.withColumns({
        "assessed_valuation": F.struct(F.col("assessed_total").alias("total"), F.lit("B. Name").alias("owner")),
        "construction": F.struct(seen.alias("inspections"), F.when(F.col("k") % 4 == 1, broken).otherwise(F.slice(broken, 1, 0)).alias("violations"))})
    errors = t.v_portal.filter("collection_status = 'not_collected'").select(*DOOR, F.lit("no page").alias("error"), F.lit("C. Name").alias("agent"))
    enriched = history.enrich_applications(t.v_portal_permit, t.v_roof_permit)
    published = history.write_histories(parcels, pages, enriched, folder(t, "histories"), "run-1", errors)

    def field(path):
        return F.get_json_object("document", f"$.{path}")

    listed = F.from_json(field("construction.permit_applications"), "array<struct<ordinal:bigint,detail_url:string,source_scope:string,roof_detail:string>>")
    read = published["properties"].withColumn("a", listed)
    each = F.transform("a", lambda e: F.concat(e.ordinal.cast("string"), F.lit(" "), e.detail_url))
    inspections = F.from_json(field("construction.inspections"), "array<struct<number:int>>")
    return read.join(published["summary"], "territory_id").select(
        "territory_id", field("pams_pin").alias("pams_pin"), *[field(c).alias(c) for c in ("block", "lot", "address", "normalized_address", "collection_status")],
        F.coalesce(field("assessed_valuation.total"), F.lit("")).alias("assessed_total"), F.size(inspections).cast("bigint").alias("inspections"),
        field("construction.violations").alias("violations"), F.size("a").cast("bigint").alias("permits"),
        F.size(F.filter("a", lambda e: e.roof_detail.isNotNull())).cast("bigint").alias("details"),
        F.size(F.filter("a", lambda e: e.source_scope == history.SUPPLEMENT)).cast("bigint").alias("supplements"),
        F.array_join(each, ",").alias("applications"), field("geoareas").alias("geoareas"),
        "properties_total", "permits_total", "inspections_total", "violations_total", "collection_errors")


@query("x14_roof_permit_match", f"""WITH {_match_sql()} SELECT ordinal, CASE WHEN n = 1 THEN pin END AS pams_pin,
    CASE WHEN NOT has_detail THEN NULL WHEN (l_partkey % 2 <> 0 AND description LIKE 'roof %') OR l_partkey % 3 = 0
         THEN 'explicit_roof_work' ELSE 'portal_keyword_only' END AS keyword_relevance,
    CASE WHEN n > 1 THEN '{history.REASON_AMBIGUOUS}' WHEN n = 0 THEN '{history.REASON_UNKNOWN}' END AS match_reason FROM matched""")
def roof_permit_match(t: Tables):
    return matched(t).select("ordinal", "pams_pin", "keyword_relevance", "match_reason")


@query("x15_outcome_validation", f"""WITH {OUTCOME_SQL} SELECT event_id, CASE WHEN trim(door_id) = ''
        THEN 'door_id must be a non-empty string' WHEN attempt_time = 'yesterday' THEN 'attempt_time not ISO-8601'
        WHEN score_contract_version = '' THEN 'score_contract_version must be a non-empty string'
        WHEN attempt_score NOT BETWEEN 0 AND 100 THEN 'attempt_score must be an integer 0-100'
        WHEN primary_outcome = 'hung_up' THEN 'unknown primary_outcome' ELSE 'secondary outcome must be a boolean' END AS reason
    FROM v_outcome WHERE event_id NOT IN (SELECT event_id FROM valid)""")
def outcome_validation(t: Tables):
    _, invalid = outcomes.validate_outcomes(t.v_outcome)
    return invalid.select("event_id", "reason")


# --- routes -----------------------------------------------------------------------------------------

_LEG = HAVERSINE_SQL.format(a1="w.lon", b1="w.lat", a2="d.lon", b2="d.lat") + " * 1.3 / (3.0 * 1609.344 / 60.0)"


def _route_sql(excluded: str = "false", version: str = "true") -> str:
    return f"""WITH RECURSIVE doors AS (SELECT * FROM v_route_door WHERE score IS NOT NULL AND lon IS NOT NULL),
    walk AS (
        SELECT route_id, territory_id, CAST(0 AS BIGINT) AS stop, lon, lat, CAST(0 AS DOUBLE) AS elapsed, hours * 60.0 AS budget,
               CAST('' AS VARCHAR) AS pams_pin, CAST(0 AS BIGINT) AS score, CAST(0 AS DOUBLE) AS minutes,
               CAST([] AS VARCHAR[]) AS visited
        FROM v_route_request WHERE {version}
        UNION ALL
        SELECT route_id, territory_id, stop + 1, d_lon, d_lat, elapsed + leg, budget, d_pin, d_score, leg,
               list_append(visited, d_pin)
        FROM (SELECT l.*, row_number() OVER (PARTITION BY route_id ORDER BY CASE WHEN leg = 0 THEN 1e300 ELSE d_score / leg END DESC,
                     d_pin) AS rn
              FROM (SELECT w.*, d.lon AS d_lon, d.lat AS d_lat, d.pams_pin AS d_pin, CAST(d.score AS BIGINT) AS d_score, {_LEG} AS leg
                    FROM walk w JOIN doors d ON w.territory_id = d.territory_id
                    WHERE w.stop < 5 AND NOT list_contains(w.visited, d.pams_pin) AND NOT ({excluded})) AS l
              WHERE elapsed + leg <= budget) AS r WHERE rn = 1)"""


@query("x16_plan_routes", f"""{_route_sql()} SELECT route_id, stop, pams_pin, score, round(minutes, 5) AS walk_minutes FROM walk
    WHERE stop > 0""")
def plan_routes(t: Tables):
    t = t.landed()
    stops = route.plan_routes(t.v_route_request, t.v_route_door)
    return stops.select("route_id", F.col("stop").cast("bigint").alias("stop"), "pams_pin",
                        F.col("score").cast("bigint").alias("score"), F.round("walk_minutes", 5).alias("walk_minutes"))


@query("w10_cumulative_minutes", f"""{_route_sql()} SELECT route_id, stop, round(sum(minutes) OVER (PARTITION BY route_id ORDER BY stop),
    5) AS cumulative_minutes FROM walk WHERE stop > 0""")
def cumulative_minutes(t: Tables):
    t = t.landed()
    return route.plan_routes(t.v_route_request, t.v_route_door).select(
        "route_id", F.col("stop").cast("bigint").alias("stop"), F.round("cumulative_minutes", 5).alias("cumulative_minutes")
    )


@query("a28_mean_route_score", f"""{_route_sql()} SELECT r.route_id, count(w.stop) AS stops, round(coalesce(sum(minutes), 0), 5)
    AS total_minutes, coalesce(round(avg(w.score), 6), -1.0) AS average_score FROM v_route_request r
    LEFT JOIN (SELECT * FROM walk WHERE stop > 0) AS w ON r.route_id = w.route_id GROUP BY r.route_id""")
def mean_route_score(t: Tables):
    t = t.landed()
    stops = route.plan_routes(t.v_route_request, t.v_route_door)
    return route.route_summary(t.v_route_request, stops).select(
        "route_id", "stops", F.round("total_minutes", 5).alias("total_minutes"),
        F.coalesce(F.round("average_score", 6), F.lit(-1.0)).alias("average_score"),
    )


@query("x17_exclude_and_replan", f"""{_route_sql(excluded="d.score >= 90")} SELECT route_id, stop, pams_pin FROM walk WHERE stop > 0""")
def exclude_and_replan(t: Tables):
    t = t.landed()
    stops = route.plan_routes(t.v_route_request, t.v_route_door, exclude=t.v_route_door.filter("score >= 90").select("pams_pin"))
    return stops.select("route_id", F.col("stop").cast("bigint").alias("stop"), "pams_pin")


@query("x17_exclude_per_route", f"""{_route_sql(excluded="(d.score + w.route_id) % 10 = 0")} SELECT route_id, stop, pams_pin FROM walk WHERE stop > 0""")
def exclude_per_route(t: Tables):
    """Each route leaves out doors of its own."""
    t = t.landed()
    dropped = t.v_route_door.join(t.v_route_request.select("route_id", "territory_id"), "territory_id").filter("(score + route_id) % 10 = 0")
    stops = route.plan_routes(t.v_route_request, t.v_route_door, exclude=dropped)
    return stops.select("route_id", F.col("stop").cast("bigint").alias("stop"), "pams_pin")


_SPOKEN = """CASE k % 4 WHEN 0 THEN 'Do you have a pool or anything out back?' WHEN 1 THEN 'How old''s the house, do you know?'
    WHEN 2 THEN 'Who do you usually call when something on the house needs doing?'
    ELSE 'Are you the one who deals with the house stuff, or is that somebody else?' END"""


@query("x16_route_stops", f"""{_route_sql()}, told AS (SELECT w.route_id, w.stop, w.pams_pin, s.address || ', Ramsey NJ' || CASE WHEN r.zip5 = '' THEN '' ELSE ' ' || r.zip5 END AS address,
        w.score, round(w.minutes, 5) AS walk_minutes, round(sum(w.minutes) OVER (PARTITION BY w.route_id ORDER BY w.stop), 5) AS cumulative_minutes,
        CASE s.k % 4 WHEN 0 THEN 'fit_pool' WHEN 1 THEN 'fit_lot' WHEN 2 THEN 'project_active' END AS reason_chip, {_SPOKEN.replace("k %", "s.k %")} AS hook,
        CASE WHEN s.k % 4 = 0 THEN 2 ELSE 0 END AS branches,
        lag(w.lon) OVER (PARTITION BY w.route_id ORDER BY w.stop) AS x1, lag(w.lat) OVER (PARTITION BY w.route_id ORDER BY w.stop) AS y1, w.lon AS x2, w.lat AS y2
    FROM walk w LEFT JOIN v_situs s ON w.pams_pin = s.pams_pin LEFT JOIN v_parcel_raw r ON w.pams_pin = r.pams_pin)
    SELECT route_id, stop, pams_pin, address, score, walk_minutes, cumulative_minutes, reason_chip, hook, branches, round(x1, 9) AS x1, round(y1, 9) AS y1,
        round(x2, 9) AS x2, round(y2, 9) AS y2 FROM told WHERE stop > 0""")
def route_stops(t: Tables):
    """Stops with address, chip, opener and branches, and the line of each leg."""
    t = t.landed()
    kinds = ("fit_pool", "fit_lot", "project_active", "capacity_local_relative_value")
    kind = F.get(F.array(*[F.lit(x) for x in kinds]), (F.col("k") % 4).cast("int"))
    doors = t.v_situs.join(t.v_parcel.select("pams_pin", "lon", "lat"), "pams_pin").withColumn("evidence_type", kind)
    evidence = doors.select("territory_id", "pams_pin", F.col("evidence_type").alias("type"), F.lit(3.0).alias("points"))
    scripts = t.spark.createDataFrame([("pool", "yes", "they have one", "Great."), ("pool", "no", "they have none", "Fair enough.")],
                                      "angle string, branch string, trigger string, line string")
    stops = route.plan_routes(t.v_route_request, t.v_route_door)
    told = route.describe_stops(t.v_route_request, stops, doors, evidence, "Acme Home", scripts)
    at = lambda i, j: F.round(F.get(F.get("path", F.lit(i)), F.lit(j)), 9)
    return told.select(
        "route_id", F.col("stop").cast("bigint").alias("stop"), "pams_pin", "address", F.col("score").cast("bigint").alias("score"),
        F.round("walk_minutes", 5).alias("walk_minutes"), F.round("cumulative_minutes", 5).alias("cumulative_minutes"), "reason_chip",
        F.substring_index("talk_track", " this week. ", -1).alias("hook"), F.coalesce(F.size("branches"), F.lit(0)).alias("branches"),
        at(0, 0).alias("x1"), at(0, 1).alias("y1"), at(1, 0).alias("x2"), at(1, 1).alias("y2"))


@query("x18_stale_contract_route", f"""{_route_sql(version="score_contract_version = 'v2'")} SELECT r.route_id,
    r.score_contract_version <> 'v2' AS refresh_required, count(w.stop) AS stops FROM v_route_request r
    LEFT JOIN (SELECT * FROM walk WHERE stop > 0) AS w ON r.route_id = w.route_id GROUP BY 1, 2""")
def stale_contract_route(t: Tables):
    t = t.landed()
    current, stale = route.current_requests(t.v_route_request)
    stops = route.plan_routes(current, t.v_route_door).groupBy("route_id").agg(F.count(F.lit(1)).alias("stops"))
    answers = current.select("route_id", F.lit(False).alias("refresh_required")).unionByName(
        stale.select("route_id", "refresh_required"))
    return answers.join(stops, "route_id", "left").select("route_id", "refresh_required", F.coalesce("stops", F.lit(0)).alias("stops"))


@query("k6_score_report_json", """SELECT territory_id, count(*) AS doors_total, count(score) AS doors_scored FROM v_door_score
    GROUP BY territory_id""")
def score_report_json(t: Tables):
    built = report.score_report(t.v_door_score, t.sql(_TRAIL), t.sql(_GAPS))
    body = built.select("territory_id", F.to_json(F.struct("*")).alias("body"))
    return body.select(
        "territory_id", *[F.get_json_object("body", f"$.{c}").cast("bigint").alias(c) for c in ("doors_total", "doors_scored")]
    )




# --- sentences, features and the manifest --------------------------------------------------------------


@query("c27_evidence_sentences", f"""WITH {SCORE_SQL} SELECT pams_pin, 'fit_home_age' AS type, 'built ' || CAST(yr AS STRING) || ' — a '
        || CAST(2001 - yr AS STRING) || '-year-old home, an age that supports service fit' AS reason FROM scored WHERE home_pts > 0
    UNION ALL SELECT pams_pin, 'fit_lot', printf('%.2f', acre) || '-acre lot — at least half an acre' FROM scored WHERE lot_pts > 0
    UNION ALL SELECT pams_pin, 'project_neutralized', CAST(permits AS STRING) || ' permit record' || CASE WHEN permits = 1 THEN '' ELSE 's' END
        || ' on file, but none active within 12 months or completed within 24 — no project points under conservative rules'
        FROM scored WHERE permits > 0 AND project = 0
    UNION ALL SELECT pams_pin, 'project_cap_adjustment', 'project category capped at 45' FROM scored WHERE project_raw > 45
    UNION ALL SELECT pams_pin, 'mover_invalid_sale',
        'a transfer was disqualified from mover influence (nominal price, disqualifying code, or invalid/future date)'
        FROM scored WHERE invalid_sales > 0
    UNION ALL SELECT pams_pin, 'rental_registration', 'current verified rental registration (' || CAST(reg AS STRING)
        || ') demotes the door' FROM scored WHERE rent_current
    UNION ALL SELECT pams_pin, 'rental_stale', 'rental registration (' || CAST(reg AS STRING)
        || ') is stale and neutral until reverified' FROM scored WHERE rent_stale""")
def evidence_sentences(t: Tables):
    kinds = ("fit_home_age", "fit_lot", "project_neutralized", "project_cap_adjustment", "mover_invalid_sale",
             "rental_registration", "rental_stale")
    evidence = engine.score(**score_inputs(t))["evidence"]
    return evidence.filter(F.col("type").isin(*kinds)).select("pams_pin", "type", "reason")


def drawn(t: Tables):
    """Parcels with a small box around their middle as the polygon, none where there is no middle."""
    from doorlens.functions import geo  # noqa: F401

    half = 0.0002
    box = spatial.box_polygon(F.col("lon") - half, F.col("lat") - half, F.col("lon") + half, F.col("lat") + half)
    return t.v_parcel.withColumn("polygon", F.when(F.col("lon").isNotNull(), box))


@query("k1_territory_features", """SELECT pams_pin, 'MultiPolygon' AS shape, prop_class, net_value FROM v_parcel
    WHERE lon IS NOT NULL AND prop_class = '2'""")
def territory_features(t: Tables):
    t = t.landed()
    raw = t.v_parcel_raw.select("k", "territory_rank", F.col("address").alias("prop_loc"), "zip5", "deed_date", "sale_price", "sales_code")
    lines = publish.territory_features(filters.of_class(drawn(t).join(raw, "k"))).select("feature")

    def field(path):
        return F.get_json_object("feature", path)

    return lines.select(
        field("$.properties.pams_pin").alias("pams_pin"), field("$.geometry.type").alias("shape"),
        field("$.properties.prop_class").alias("prop_class"), field("$.properties.net_value").cast("double").alias("net_value"),
    )


@query("k2_door_features", f"""WITH chips AS (SELECT pams_pin, count(*) AS n FROM ({_TRAIL}) AS t GROUP BY pams_pin)
    SELECT d.pams_pin, coalesce(CAST(d.score AS BIGINT), -1) AS score, p.lon IS NULL AS no_shape,
        CASE WHEN d.score IS NULL THEN 0 ELSE coalesce(c.n, 0) END AS evidence
    FROM v_door_score d JOIN v_parcel p ON d.pams_pin = p.pams_pin LEFT JOIN chips c ON d.pams_pin = c.pams_pin""")
def door_features(t: Tables):
    t = t.landed()
    nothing = {c: F.lit(None).cast(kind) for c, kind in (
        ("confidence", "string"), ("situs", "string"), ("exclusion_reason", "string"), ("base", "int"), ("mover_eligible", "int"),
        ("days_since_move", "int"), ("mover_strength", "double"), ("mover_lift", "double"), ("rental_modifier", "int"),
        ("adjustment", "double"))}
    doors = t.v_door_score.withColumns(nothing)
    # A feature holds all entries of its door, so they are dealt by door once, and numbered there.
    own = t.sql(_TRAIL).join(doors.filter("score is not null").select(*DOOR), DOOR, "left_semi")
    shown = own.withColumns({
        "seq": (F.row_number().over(Window.partitionBy(*DOOR).orderBy("kind", "ordinal")) - 1).cast("bigint"),
        "reason": F.lit("r"), "source": F.lit(None).cast("string"), "retrieved": F.lit(None).cast("date"),
        "imagery": F.lit(None).cast("string")})
    lines = publish.door_features(doors, shown, drawn(t))
    return lines.select(
        "pams_pin", F.coalesce(F.get_json_object("feature", "$.properties.score").cast("bigint"), F.lit(-1)).alias("score"),
        F.get_json_object("feature", "$.geometry.type").isNull().alias("no_shape"),
        F.size(F.from_json(F.get_json_object("feature", "$.properties.evidence"), "array<string>")).cast("bigint").alias("evidence"),
    )


_MANIFEST_DEEDS = DEED_SQL.replace("parcels AS (", "dparcels AS (").replace("FROM parcels p", "FROM dparcels p")
_COUNTED = ("permits_total", "permits_in_window", "permits_out_of_territory", "permits_unmatched", "permits_matched_municipal")


@query("k5_run_manifest", f"""WITH {ACCOUNT_SQL}, {PLACED_SQL}, {_MANIFEST_DEEDS},
    towns AS (SELECT DISTINCT territory_id, '02' || lpad(CAST(territory_id AS STRING), 2, '0') AS mun FROM v_door_score),
    scored_doors AS (SELECT territory_id, count(*) AS doors_total, count(score) AS doors_scored FROM v_door_score GROUP BY territory_id),
    own_deeds AS (SELECT mun, max(own) AS d FROM dparcels GROUP BY mun),
    sold AS (SELECT mun, max(sale_day) AS d, array_to_string(list_sort(list_distinct(array_agg('sr1a-' || CAST(year(sale_day) AS STRING) || '.txt'))), ' ')
                 AS files FROM v_sale WHERE deed_date <> '' GROUP BY mun),
    landed AS (SELECT DISTINCT pams_pin FROM routed WHERE pams_pin IS NOT NULL),
    homes AS (SELECT d.mun, count(*) FILTER (WHERE {A} - deed_day <= 90) AS moved, count(*) FILTER (WHERE newer) AS newer,
            count(*) FILTER (WHERE coalesce(g.geoid <> 'BG24', false)) AS with_group,
            count(*) FILTER (WHERE l.pams_pin IS NOT NULL OR coalesce(g.geoid <> 'BG24', false)
                OR d.pams_pin IN (SELECT pams_pin FROM v_rental)) AS with_signal
        FROM deeds d LEFT JOIN placed g ON d.pams_pin = g.pams_pin LEFT JOIN landed l ON d.pams_pin = l.pams_pin
        WHERE d.prop_class = '2' GROUP BY d.mun),
    answers AS (SELECT territory_id, count(*) AS total, count(*) FILTER (WHERE signal = 'error') AS lost
        FROM v_response r JOIN v_tile t ON r.image_ref = t.image_ref GROUP BY territory_id),
    framed AS (SELECT territory_id, count(DISTINCT pams_pin) AS doors FROM v_detection WHERE present AND confidence >= 0.6 GROUP BY territory_id)
    SELECT s.territory_id, '{A[6:-1]}' AS as_of, 'v2' AS score_contract_version, doors_total, doors_scored, doors_total - doors_scored AS doors_unscored,
        round(doors_scored / CAST(doors_total AS DOUBLE), 6) AS coverage, CAST(greatest(o.d, sold.d) AS STRING) AS latest_deed_date,
        CAST(sold.d AS STRING) AS latest_sale_date, coalesce(h.moved, 0) AS doors_in_mover_window, CAST(90 AS BIGINT) AS mover_window_days,
        sold.files AS source_files, coalesce(h.newer, 0) AS doors_superseding_modiv, CAST(sold.d AS STRING) AS retrieved_deeds, a.total > 0 AS available,
        a.total AS answers_total, a.lost AS answers_lost, CASE WHEN a.total > 0 THEN coalesce(f.doors, 0) END AS doors_with_imagery,
        CASE WHEN a.lost > 0 THEN 'vision answers lost' ELSE '' END AS degradations, h.with_group AS doors_with_block_group,
        h.with_signal AS doors_with_signal, {', '.join(_COUNTED)}, {RATES_SQL}
    FROM scored_doors s JOIN towns w ON s.territory_id = w.territory_id JOIN totals t ON t.mun = w.mun JOIN counted c ON c.mun = w.mun
        JOIN own_deeds o ON o.mun = w.mun LEFT JOIN sold ON sold.mun = w.mun LEFT JOIN homes h ON h.mun = w.mun
        LEFT JOIN answers a ON a.territory_id = s.territory_id LEFT JOIN framed f ON f.territory_id = s.territory_id""")
def run_manifest(t: Tables):
    """The manifest with every block, each field read back from its JSON."""
    t = t.landed()
    town = F.substring("mun", 3, 2).cast("bigint").alias("territory_id")
    found = resolved(t)
    counts = found["report"].select(town, "*").drop("mun")
    doors = found["doors"]
    vintage = resolve.deed_vintage(t.v_parcel_raw, t.v_sale, doors, AS_OF).select(town, "*").drop("mun")
    newer = doors.groupBy("mun").agg(F.count_if(F.col("deed.source") == resolve.SOURCE_SR1A).alias("doors_superseding_modiv"))
    dated = t.v_sale.filter("deed_date != ''")
    name = F.concat(F.lit("sr1a-"), F.year("sale_day").cast("string"), F.lit(".txt"))
    files = dated.groupBy("mun").agg(F.sort_array(F.collect_set(name)).alias("source_files"))
    register = newer.join(files, "mun", "full").select(town, "source_files", "doors_superseding_modiv")
    retrieved = dated.select(town, F.lit("deeds").alias("source"), F.col("sale_day").alias("retrieved"))
    framed = t.v_detection.filter("present and confidence >= 0.6").groupBy("territory_id").agg(F.count_distinct("pams_pin").alias("doors_with_imagery"))
    answers = t.v_response.join(t.v_tile, "image_ref").groupBy("territory_id").agg(
        F.count(F.lit(1)).alias("answers_total"), F.count_if(F.col("signal") == "error").alias("answers_lost"))
    vision = answers.join(framed, "territory_id", "left").na.fill(0, ["doors_with_imagery"]).withColumns(
        {"available": F.col("answers_total") > 0, "declination_reason": F.lit(None).cast("string")})
    lost = answers.filter("answers_lost > 0").select("territory_id", F.lit("vision answers lost").alias("reason"))
    lines = publish.run_manifest(t.v_door_score, counts, vintage, AS_OF, "2001-06-30T00:00:00Z", "test", degradations=lost,
                                 retrieved=retrieved, vision=vision, register=register)

    def field(path, kind="bigint"):
        return F.get_json_object("manifest", f"$.{path}").cast(kind).alias(path.rsplit(".", 1)[-1])

    def words(path):
        listed = F.from_json(F.get_json_object("manifest", f"$.{path}"), "array<string>")
        return F.array_join(listed, " ").alias(path.rsplit(".", 1)[-1])

    return lines.select(
        "territory_id", field("as_of", "string"), field("score_contract_version", "string"), field("doors_total"), field("doors_scored"),
        field("doors_unscored"), F.round(field("coverage", "double"), 6).alias("coverage"), field("deed_vintage.latest_deed_date", "string"),
        field("deed_vintage.sales_register.latest_sale_date", "string"), field("deed_vintage.doors_in_mover_window"),
        field("deed_vintage.mover_window_days"), words("deed_vintage.sales_register.source_files"),
        field("deed_vintage.sales_register.doors_superseding_modiv"), field("retrieved.deeds", "string").alias("retrieved_deeds"),
        field("vision.available", "boolean"), field("vision.answers_total"), field("vision.answers_lost"), field("vision.doors_with_imagery"),
        words("degradations"), field("resolve.doors_with_block_group"), field("resolve.doors_with_signal"),
        *[field(f"resolve.{c}") for c in _COUNTED], *[F.round(field(f"resolve.{c}", "double"), 6).alias(c) for c in RATES],
    )


@query("s16_label_rules", """SELECT event_id, actual, predicted, probe FROM v_label WHERE NOT (probe AND actual)""")
def label_rules(t: Tables):
    from doorlens.sources.readers import label_reason

    return t.v_label.withColumn("reason", label_reason()).filter("reason is null").select("event_id", "actual", "predicted", "probe")
