"""The score of every door: three capped categories, the mover blend, the rental modifier.

The door facts are one wide row; points are column arithmetic on it. Evidence is the
same arithmetic written out as rows, so its points add up to the unrounded score.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doorlens.functions import dates, text
from doorlens.operators.imagery import CONFIDENCE_FLOOR
from doorlens.operators.ordering import count_below
from doorlens.scoring import facts
from doorlens.scoring.facts import DOOR
from doorlens.session import hot_joins_split, land

# Points, caps and bands of the contract.
CONTRACT = "v2"
PROJECT_POINTS, PROJECT_CAP = 15, 45
CAPACITY_CAP = 25
FIT_CAP = 48
ACS_THRESHOLD, ACS_POINTS = 0.35, 5
LOT_ACRES, LOT_POINTS = 0.5, 5
POOL_POINTS, SOLAR_POINTS, DECLINE_POINTS = 8, 5, 8
RENTAL_POINTS = -25
MIN_COMPARABLES = 10
RATIO_BANDS = ((1.5, 10), (1.2, 7))
PERCENTILE_BANDS = ((90, 10), (75, 7), (50, 3))
ROOF_BANDS = ((20, 12), (15, 8), (10, 4))
HOME_BANDS = ((75, 10), (50, 8), (30, 5))
GAPS = (
    "acs_missing", "assessed_value_missing", "imagery_missing", "local_comparables_insufficient",
    "rental_data_missing", "sdl_page_unavailable",
)
# The order entries stand in within a door.
EVIDENCE_ORDER = (
    "project_active", "project_completed", "project_cap_adjustment", "project_neutralized",
    "capacity_local_relative_value", "capacity_territory_percentile", "capacity_acs_dual_income_prior",
    "capacity_cap_adjustment", "fit_roof_age", "fit_home_age", "fit_condition_superseded", "fit_condition_decline",
    "fit_pool", "fit_solar", "fit_lot", "fit_cap_adjustment", "mover_invalid_sale", "mover_recency",
    "rental_registration", "rental_stale",
)


def banded(value: Column, bands) -> Column:
    rule = None
    for floor, points in bands:
        rule = F.when(value >= floor, points) if rule is None else rule.when(value >= floor, points)
    return F.coalesce(rule, F.lit(0))


def mover_strength(days: Column) -> Column:
    """90 up to day 90, then an exponential fall to 0 at a year."""
    t = (days - 90) / F.lit(275.0)
    floor = F.exp(F.lit(-2.0))
    fading = F.lit(90.0) * (F.exp(t * -2.0) - floor) / (F.lit(1.0) - floor)
    return (
        F.when(days.isNull() | (days < 0) | (days >= 365), F.lit(0.0)).when(days <= 90, F.lit(90.0)).otherwise(fading)
    )


def blend(base: Column, strength: Column) -> Column:
    return base + strength / 90.0 * (F.lit(90.0) + base / 8.0 - base)


def local_ratio(assessed: Column, median: Column) -> Column:
    return F.when(median == 0, F.lit(0.0)).otherwise(assessed / median)


def local_points(ratio: Column) -> Column:
    return F.when(ratio >= 1.5, 10).when(ratio >= 1.2, 7).when(ratio > 1.0, 3).otherwise(0)


def plural(count: Column) -> Column:
    return F.when(count == 1, F.lit("")).otherwise(F.lit("s"))


def _flag(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(False))


def _count(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(0))


def door_facts(
    doors: DataFrame, sales: DataFrame, classified: DataFrame, comparables: DataFrame, values: DataFrame,
    rental: DataFrame, observed: DataFrame,
) -> DataFrame:
    """All facts of a door on one row. The joins share the door key."""
    ranks = facts.value_ranks(values)
    totals = ranks.groupBy("territory_id").agg(F.max("total").alias("value_total"))
    # Comparables exclude the subject and the value list includes it, so an assessed value the
    # list lacks still gets its rank from the nearest listed value below.
    return (
        doors.join(facts.permit_facts(classified), DOOR, "left")
        .join(facts.sale_facts(sales, doors.select(*DOOR, "as_of")), DOOR, "left")
        .join(facts.comparable_facts(comparables), DOOR, "left")
        .join(facts.rental_facts(rental), DOOR, "left")
        .join(observed, DOOR, "left")
        .join(totals, "territory_id", "left")
        .join(door_ranks(doors, ranks), DOOR, "left")
    )


def door_ranks(doors: DataFrame, ranks: DataFrame) -> DataFrame:
    """(door, value_below, value_equal) by merging the doors' values into the ranked histogram."""
    asked = doors.filter("assessed_value is not null").select("territory_id", F.col("assessed_value").alias("value"))
    marks = ranks.select("territory_id", "value", "equal").unionByName(
        asked.distinct().select("territory_id", "value", F.lit(0).cast("bigint").alias("equal"))
    ).groupBy("territory_id", "value").agg(F.sum("equal").alias("equal"))
    from doorlens.operators.ordering import value_bucket

    placed = count_below(
        marks.withColumn("_bucket", value_bucket(F.col("value"))), ["territory_id"], ["_bucket", "value"], "equal",
        "value_below",
    ).select("territory_id", F.col("value").alias("assessed_value"), "value_below", F.col("equal").alias("value_equal"))
    return doors.select(*DOOR, "assessed_value").join(placed, ["territory_id", "assessed_value"]).drop("assessed_value")


def score_doors(wide: DataFrame) -> DataFrame:
    """Points, categories, blend, rounding, gaps and confidence as columns on the fact row."""
    c, lit = F.col, F.lit
    w = wide

    def add(**columns):
        nonlocal w
        w = w.withColumns(columns)

    has_value = c("assessed_value").isNotNull()
    enough = _count("comps") >= MIN_COMPARABLES
    add(
        project_raw=(_count("projects") * PROJECT_POINTS).cast("int"),
        ratio=F.when(has_value & enough, local_ratio(c("assessed_value"), c("comp_median"))),
        percentile=F.when(
            has_value & (_count("value_total") > 0),
            facts.midrank_percentile(c("value_below"), c("value_equal"), c("value_total")),
        ),
        acs_points=F.when(c("dual_income_pct") >= ACS_THRESHOLD, ACS_POINTS).otherwise(0),
        roof_age=dates.whole_years(c("roof_when"), c("as_of")),
        home_age=F.when(
            (c("construction_year") > 0) & (c("construction_year") <= F.year("as_of")),
            F.year("as_of") - c("construction_year"),
        ),
        decline_seen=c("imagery_available") & (_count("decline_confidence") >= CONFIDENCE_FLOOR),
        pool_seen=c("imagery_available") & (_count("pool_confidence") >= CONFIDENCE_FLOOR),
        solar_seen=c("imagery_available") & (_count("solar_confidence") >= CONFIDENCE_FLOOR),
    )
    add(
        local_points=F.coalesce(local_points(c("ratio")), lit(0)),
        percentile_points=banded(c("percentile"), PERCENTILE_BANDS),
        roof_points=banded(c("roof_age"), ROOF_BANDS),
        home_points=banded(c("home_age"), HOME_BANDS),
        decline_points=F.when(c("decline_seen") & (_count("superseding") == 0), DECLINE_POINTS).otherwise(0),
        pool_points=F.when(c("pool_seen") | (_count("pool_permits") > 0), POOL_POINTS).otherwise(0),
        solar_points=F.when(c("solar_seen") | (_count("solar_permits") > 0), SOLAR_POINTS).otherwise(0),
        lot_points=F.when(c("lot_acres") >= LOT_ACRES, LOT_POINTS).otherwise(0),
    )
    add(
        capacity_raw=c("local_points") + c("percentile_points") + c("acs_points"),
        fit_raw=c("roof_points") + c("home_points") + c("decline_points") + c("pool_points") + c("solar_points")
        + c("lot_points"),
    )
    add(
        project=F.least(c("project_raw"), lit(PROJECT_CAP)), capacity=F.least(c("capacity_raw"), lit(CAPACITY_CAP)),
        fit=F.least(c("fit_raw"), lit(FIT_CAP)), days_since_move=F.datediff("as_of", "last_sale"),
    )
    add(base=c("project") + c("capacity") + c("fit"), mover_strength=mover_strength(c("days_since_move")))
    current = F.when(c("last_sale").isNotNull(), c("last_registration") >= c("last_sale")).otherwise(
        c("last_registration") >= dates.years_back(c("as_of"), 2)
    )
    add(
        mover_eligible=c("last_sale").isNotNull(),
        mover_lift=blend(c("base").cast("double"), c("mover_strength")) - c("base"),
        rental_current=c("rental_available") & F.coalesce(current, lit(False)),
        rental_stale=c("rental_available") & ~F.coalesce(current, lit(True)),
    )
    add(rental_modifier=F.when(c("rental_current"), RENTAL_POINTS).otherwise(0))
    add(pre_rounding=blend(c("base").cast("double"), c("mover_strength")) + c("rental_modifier"))
    add(score=text.round_half_up(F.least(F.greatest(c("pre_rounding"), lit(0.0)), lit(100.0))).cast("int"))
    gaps = F.array_compact(F.array(
        F.when(c("dual_income_pct").isNull(), "acs_missing"),
        F.when(~has_value, "assessed_value_missing"),
        F.when(~c("imagery_available"), "imagery_missing"),
        F.when(has_value & ~enough, "local_comparables_insufficient"),
        F.when(~c("rental_available"), "rental_data_missing"),
        F.when(~c("sdl_page_available"), "sdl_page_unavailable"),
    ))
    add(adjustment=c("score") - c("pre_rounding"), data_gaps=gaps)
    add(confidence=F.when(F.size("data_gaps") >= 2, "low").otherwise("normal"),
        score_contract_version=lit(CONTRACT))
    return w


def fixed_evidence(scored: DataFrame) -> DataFrame:
    """Every entry but the single projects: at most eighteen a door, built on the row and exploded."""
    c, lit = F.col, F.lit

    def entry(kind, points, reason, source, when):
        return F.when(
            when,
            F.struct(
                lit(EVIDENCE_ORDER.index(kind)).alias("type_order"), lit(kind).alias("type"),
                points.cast("double").alias("points"), reason.alias("reason"),
                (source if source is not None else lit(None)).cast("string").alias("source"),
            ),
        )

    def cap(kind, name, label, limit):
        return entry(kind, c(name) - c(f"{name}_raw"), lit(f"{label} category capped at {limit}"), None,
                     c(f"{name}_raw") > limit)

    def source(prefix):
        return facts.permit_source(_flag(f"{prefix}_portal"), _flag(f"{prefix}_statewide"))

    def dollars(value):
        return F.concat(lit("$"), F.format_number(value, 0))

    def years(age):
        return F.concat(age.cast("string"), lit(" year"), plural(age))

    roof_day = c("roof_when").cast("string")
    roof_reason = (
        F.when(c("roof_points") > 0, F.concat(
            lit("latest completed roof installation was "), roof_day, lit(" — "), years(c("roof_age")),
            lit(" old, old enough to need service")))
        .when(c("roof_when").isNotNull(), F.concat(
            lit("roof installed "), roof_day, lit(" — "), years(c("roof_age")), lit(" old, younger than 10 years")))
        .otherwise(F.concat(
            c("roof_records").cast("string"), lit(" roof-related permit record"), plural(c("roof_records")),
            lit(" on file ("), facts.briefs(c("roof_briefs"), c("roof_records"), facts.BRIEF_LIMIT),
            lit("), but none establish a completed installation age")))
    )

    def feature(name, label, suffix):
        by_permit = _count(f"{name}_permits") > 0
        listed = facts.briefs(F.array(c(f"{name}_first")), c(f"{name}_permits"), 1)
        opening = F.concat(lit(f"{label} established by a completed permit ("), listed, lit(")"))
        seen = c(f"{name}_seen")
        reason = (
            F.when(by_permit & seen, F.concat(opening, lit(f" and confirmed in aerial imagery{suffix}")))
            .when(by_permit, F.concat(opening, lit(suffix)))
            .otherwise(lit(f"{label} visible in aerial imagery{suffix}"))
        )
        origin = F.concat_ws(
            " + ", F.when(by_permit, source(name)), F.when(seen, facts.SOURCE_IMAGERY)
        )
        return reason, origin

    pool_reason, pool_source = feature("pool", "pool", " — a standing maintenance commitment")
    solar_reason, solar_source = feature("solar", "solar panels", "")
    registered = c("last_registration").cast("string")
    entries = [
        cap("project_cap_adjustment", "project", "project", PROJECT_CAP),
        entry("project_neutralized", lit(0), F.concat(
            c("permits").cast("string"), lit(" permit record"), plural(c("permits")),
            lit(" on file, but none active within 12 months or completed within 24 — no project points under "
                "conservative rules")), source("any"), (_count("permits") > 0) & (c("project") == 0)),
        entry("capacity_local_relative_value", c("local_points"), F.concat(
            lit("assessed at "), dollars(c("assessed_value")), lit(", "), F.format_string("%.2f", c("ratio")),
            lit("× the "), dollars(c("comp_median")), lit(" median of the nearest "), c("comps").cast("string"),
            lit(" single-family comparables")), lit(facts.SOURCE_MODIV), c("local_points") > 0),
        entry("capacity_territory_percentile", c("percentile_points"), F.concat(
            lit("assessed value sits at the "), F.format_string("%.0f", c("percentile")), lit("th percentile of the "),
            c("value_total").cast("string"), lit(" territory single-family properties")), lit(facts.SOURCE_MODIV),
            c("percentile_points") > 0),
        entry("capacity_acs_dual_income_prior", c("acs_points"), F.concat(
            F.format_string("%.0f%%", c("dual_income_pct") * 100.0),
            lit(" of this block group's households are dual-income (at or above the 35% prior; a neighborhood-level "
                "prior, not a household claim)")), lit(facts.SOURCE_ACS), c("acs_points") > 0),
        cap("capacity_cap_adjustment", "capacity", "capacity", CAPACITY_CAP),
        entry("fit_roof_age", c("roof_points"), roof_reason,
              F.when(c("roof_when").isNotNull(), source("install")).otherwise(source("roof")),
              c("roof_when").isNotNull() | (_count("roof_records") > 0)),
        entry("fit_home_age", c("home_points"), F.concat(
            lit("built "), c("construction_year").cast("string"), lit(" — a "), c("home_age").cast("string"),
            lit("-year-old home, an age that supports service fit")), lit(facts.SOURCE_MODIV), c("home_points") > 0),
        entry("fit_condition_superseded", lit(0), F.concat(
            lit("exterior-condition decline observation superseded by a later completed exterior permit ("),
            facts.briefs(c("exterior_briefs"), c("superseding"), facts.BRIEF_LIMIT), lit(")")),
            F.concat(lit(f"{facts.SOURCE_IMAGERY} + "), source("superseding")),
            c("decline_seen") & (_count("superseding") > 0)),
        entry("fit_condition_decline", c("decline_points"), lit(
            "verified historical exterior-condition decline between the 2015 and 2020 imagery vintages"),
            lit(facts.SOURCE_IMAGERY), c("decline_points") > 0),
        entry("fit_pool", c("pool_points"), pool_reason, pool_source, c("pool_points") > 0),
        entry("fit_solar", c("solar_points"), solar_reason, solar_source, c("solar_points") > 0),
        entry("fit_lot", c("lot_points"), F.concat(
            F.format_string("%.2f", c("lot_acres")), lit("-acre lot — at least half an acre")),
            lit(facts.SOURCE_MODIV), c("lot_points") > 0),
        cap("fit_cap_adjustment", "fit", "property-fit", FIT_CAP),
        entry("mover_invalid_sale", lit(0), lit(
            "a transfer was disqualified from mover influence (nominal price, disqualifying code, or invalid/future "
            "date)"), facts.sale_source(_flag("invalid_sr1a"), _flag("invalid_modiv"), _flag("invalid_sdl")),
            _count("invalid_sales") > 0),
        entry("mover_recency", c("mover_lift"), F.concat(
            lit("home changed hands "), c("days_since_move").cast("string"), lit(" days ago ("),
            c("last_sale").cast("string"), lit(
                ") in a market sale — new owners are the likeliest to start projects, so the score gets a large lift "
                "that fades out over the first year")),
            facts.sale_source(*[c("last_sale_source").eqNullSafe(s) for s in ("SR1A", "MODIV", "SDL")]),
            c("mover_lift") > 0),
        entry("rental_registration", c("rental_modifier"), F.concat(
            lit("current verified rental registration ("), registered, lit(") demotes the door")),
            lit(facts.SOURCE_RENTAL), c("rental_current")),
        entry("rental_stale", lit(0), F.concat(
            lit("rental registration ("), registered, lit(") is stale and neutral until reverified")),
            lit(facts.SOURCE_RENTAL), c("rental_stale")),
    ]
    return scored.select(
        *DOOR, "as_of", (c("project_raw") / PROJECT_POINTS).cast("bigint").alias("_projects"),
        F.posexplode(F.array_compact(F.array(*entries))).alias("_place", "e"),
    ).select(*DOOR, "as_of", (c("_projects") + c("_place")).alias("seq"), "e.type", "e.points", "e.reason", "e.source")


def project_evidence(classified: DataFrame) -> DataFrame:
    """One entry per counted project, numbered in permit order without one window per door."""
    counted = classified.filter("active or completed").withColumns({
        "_high": F.shiftright("ordinal", 40), "_mid": F.shiftright("ordinal", 20), "_one": F.lit(1),
    })
    placed = count_below(counted, DOOR, ["_high", "_mid", "ordinal"], "_one", "seq")
    kind = F.when(F.col("active"), "project_active").otherwise("project_completed")
    reason = F.when(
        F.col("active"),
        F.concat(F.lit("open municipal project with activity in the last 12 months: "), F.col("brief")),
    ).otherwise(
        F.concat(F.lit("project completed "), F.col("completed_on").cast("string"), F.lit(", within 24 months: "),
                 F.col("brief"))
    )
    return placed.select(
        *DOOR, "as_of", F.col("seq").cast("bigint").alias("seq"), kind.alias("type"),
        F.lit(float(PROJECT_POINTS)).alias("points"), reason.alias("reason"),
        facts.permit_source(F.col("from_portal"), F.col("from_statewide")).alias("source"),
    )


def evidence_rows(scored: DataFrame, classified: DataFrame) -> DataFrame:
    every = project_evidence(classified).unionByName(fixed_evidence(scored))
    return every.select(
        *DOOR, "seq", F.substring_index("type", "_", 1).alias("category"), "type", "points", "reason", "source",
        F.when(F.col("source").isNotNull(), F.col("as_of")).alias("retrieved"),
    )


def gap_rows(scored: DataFrame) -> DataFrame:
    return scored.select(*DOOR, F.explode("data_gaps").alias("gap"))


RESULT = (
    *DOOR, "score", "confidence", "score_contract_version", "project", "capacity", "fit", "base", "mover_eligible",
    "days_since_move", "mover_strength", "mover_lift", "rental_modifier", "pre_rounding", "adjustment", "data_gaps",
)


def score(
    doors: DataFrame, sales: DataFrame, permits: DataFrame, comparables: DataFrame, values: DataFrame,
    rental: DataFrame, observed: DataFrame, land_facts: bool = True,
) -> dict[str, DataFrame]:
    """Doors, evidence and gaps.

    The classified permits and the fact row of each door are written once, because every output
    is derived from them; `land_facts=False` keeps the whole job lazy.

    `doors` holds territory_id, pams_pin, as_of, assessed_value, construction_year, lot_acres, dual_income_pct,
    sdl_page_available, rental_available and imagery_available, one row a door.
    """
    classified = facts.classify_permits(permits, doors.select(*DOOR, "as_of"), fields=facts.PERMIT_FIELDS).select(*facts.CLASSIFIED)
    if land_facts:
        # A door with very many permits is split among tasks, for one more dealing of the rows.
        with hot_joins_split(classified.sparkSession):
            classified = land(classified, "classified_permits")
    wide = door_facts(doors, sales, classified, comparables, values, rental, observed)
    scored = score_doors(land(wide, "door_facts") if land_facts else wide)
    return {
        "doors": scored.select(*RESULT), "wide": scored, "evidence": evidence_rows(scored, classified),
        "gaps": gap_rows(scored),
    }
