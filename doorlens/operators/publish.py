"""Published tables, the run manifest and the pieces a reader shows."""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from doorlens.functions import dates, text
from doorlens.operators.filters import EXCLUSION_REASON, UNSPEAKABLE
from doorlens.sources.readers import stale_versions

# Published columns and the identity name patterns no table may carry.
DOOR_COLUMNS = (
    "pams_pin", "score", "confidence", "situs", "exclusion_reason", "score_contract_version", "project", "capacity",
    "fit", "base", "mover_eligible", "days_since_move", "mover_strength", "mover_lift", "rental_modifier", "adjustment",
)
EVIDENCE_COLUMNS = ("pams_pin", "seq", "type", "points", "reason", "source", "retrieved", "imagery")
TERRITORY_PROPERTIES = (
    "pams_pin", "prop_class", "prop_loc", "zip5", "block", "lot", "deed_date", "sale_price", "sales_code", "yr_constr",
    "net_value", "calc_acre",
)
IDENTITY_PATTERNS = (
    r"owner", r"mailing", r"mail_addr", r"\bagent\b|_agent|agent_", r"applicant", r"taxpayer", r"occupant", r"resident",
)
CONTRACT = "v2"


def doors_table(resolved: DataFrame, scored: DataFrame) -> DataFrame:
    """Every resolved door once; an unscored one has a reason and NULLs. Columns are named one by one.

    `resolved` has territory_id, pams_pin, situs and exclusion_reason.
    """
    marked = resolved.select("territory_id", "pams_pin", "situs", "exclusion_reason")
    points = scored.withColumn("mover_eligible", F.col("mover_eligible").cast("int"))
    joined = marked.join(points, ["territory_id", "pams_pin"], "left")
    hidden = F.col("exclusion_reason").isNotNull()
    plain = ("pams_pin", "situs", "exclusion_reason", "score_contract_version")
    columns = [
        F.col(c) if c in ("pams_pin", "situs") else F.when(~hidden, F.col(c)).alias(c) for c in DOOR_COLUMNS if c not in plain[2:]
    ]
    return joined.select(
        "territory_id", *columns,
        F.when(hidden | F.col("score").isNull(), F.coalesce("exclusion_reason", F.lit(EXCLUSION_REASON)))
        .alias("exclusion_reason"),
        F.lit(CONTRACT).alias("score_contract_version"),
    ).select("territory_id", *DOOR_COLUMNS)


def evidence_table(evidence: DataFrame, doors: DataFrame) -> DataFrame:
    """Evidence of scored doors only."""
    shown = doors.filter("score is not null").select("territory_id", "pams_pin")
    rows = evidence if "imagery" in evidence.columns else evidence.withColumn("imagery", F.lit(None).cast("string"))
    return rows.join(shown, ["territory_id", "pams_pin"], "left_semi").select("territory_id", *EVIDENCE_COLUMNS)


def door_features(doors: DataFrame, evidence: DataFrame, geometry: DataFrame, gaps: DataFrame | None = None) -> DataFrame:
    """One GeoJSON feature per door as a JSON line; a door without a polygon keeps a null geometry.

    The evidence table is the form to work on; a feature repeats a door's entries in order, as the
    format asks for them inside the feature.
    """
    line = F.struct("seq", "type", "points", "reason", "source", "retrieved", "imagery")
    lists = evidence.groupBy("territory_id", "pams_pin").agg(F.sort_array(F.collect_list(line)).alias("evidence"))
    joined = doors.join(lists, ["territory_id", "pams_pin"], "left").join(
        geometry.select("territory_id", "pams_pin", "polygon"), ["territory_id", "pams_pin"], "left"
    )
    if gaps is not None:
        joined = joined.join(
            gaps.groupBy("territory_id", "pams_pin").agg(F.sort_array(F.collect_set("gap")).alias("data_gaps")),
            ["territory_id", "pams_pin"], "left",
        )
    else:
        joined = joined.withColumn("data_gaps", F.lit(None).cast("array<string>"))
    scored = F.col("score").isNotNull()
    properties = F.struct(
        F.col("pams_pin").alias("PAMS_PIN"), "score", "confidence",
        F.transform(F.coalesce("evidence", F.array().cast("array<struct<seq:bigint,type:string,points:double,"
                    "reason:string,source:string,retrieved:date,imagery:string>>")), lambda e: F.struct(
            e.type.alias("type"), e.points.alias("points"), e.reason.alias("reason"), e.source.alias("source"),
            e.retrieved.alias("retrieved"), e.imagery.alias("imagery"))).alias("evidence"),
        "situs", "exclusion_reason", "score_contract_version",
        F.when(scored, F.struct("project", "capacity", "fit")).alias("categories"), "base",
        F.when(scored, F.struct(F.col("mover_eligible").cast("boolean").alias("eligible"), "days_since_move",
                                F.col("mover_strength").alias("strength"))).alias("mover"),
        "mover_lift", "rental_modifier", "adjustment",
        F.when(scored, F.transform(F.coalesce("data_gaps", F.array().cast("array<string>")),
                                   lambda g: F.struct(g.alias("type")))).alias("data_gaps"),
    )
    shape = F.when(F.col("polygon").isNotNull(), F.struct(F.lit("MultiPolygon").alias("type"), F.col("polygon").alias("coordinates")))
    feature = F.struct(F.lit("Feature").alias("type"), shape.alias("geometry"), properties.alias("properties"))
    return joined.select(
        "territory_id", "pams_pin", F.to_json(feature, {"ignoreNullFields": "false"}).alias("feature"),
    )


def territory_features(parcels: DataFrame) -> DataFrame:
    """GeoJSON lines of the territory's drawn parcels, with their rank for the order of the file."""
    shape = F.struct(F.lit("MultiPolygon").alias("type"), F.col("polygon").alias("coordinates"))
    properties = F.struct(*TERRITORY_PROPERTIES)
    feature = F.struct(F.lit("Feature").alias("type"), shape.alias("geometry"), properties.alias("properties"))
    return parcels.filter("polygon is not null").select(
        "territory_id", "territory_rank", F.to_json(feature, {"ignoreNullFields": "false"}).alias("feature")
    )


def write_tables(doors: DataFrame, evidence: DataFrame, root: str) -> None:
    """Replaces what was published before; nothing is appended.

    Rows are brought together by territory first, so a territory is a few files and not one per task;
    the rebalance splits a large territory over several tasks.
    """
    for name, table in (("doors", doors), ("evidence", evidence)):
        table.hint("rebalance", "territory_id").write.mode("overwrite").partitionBy("territory_id").parquet(f"{root}/{name}")


def publish_run(tables: dict[str, DataFrame], root: str, run_id: str) -> None:
    """Publishes all tables of a run as one: they are written under a folder of the run, and then one pointer row names it.

    A reader follows the newest pointer, so it sees the run before or this one, whole. A run that stops between its tables
    leaves no pointer. Nothing published is overwritten; a repeated run id replaces what an interrupted attempt left.
    """
    names = sorted(tables)
    for name in names:
        table = tables[name]
        if "territory_id" in table.columns:
            table.hint("rebalance", "territory_id").write.mode("overwrite").partitionBy("territory_id").parquet(f"{root}/runs/{run_id}/{name}")
        else:
            table.write.mode("overwrite").parquet(f"{root}/runs/{run_id}/{name}")
    spark = tables[names[0]].sparkSession
    number = _newest(spark, root)
    pointer = spark.createDataFrame([(run_id, names, 1 if number is None else number["number"] + 1)], "run_id string, tables array<string>, number long")
    pointer.coalesce(1).write.mode("append").parquet(f"{root}/pointers")


def _newest(spark: SparkSession, root: str):
    """The newest pointer row, or None before the first publish."""
    try:
        pointers = spark.read.schema("run_id string, tables array<string>, number long").parquet(f"{root}/pointers")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return pointers.orderBy(F.desc("number"), F.desc("run_id")).first()


def read_run(spark: SparkSession, root: str, needed: tuple[str, ...] = ("doors", "evidence")) -> dict[str, DataFrame]:
    """The tables of the run published last. Every needed one has to be there, and doors of the current contract only."""
    newest = _newest(spark, root)
    if newest is None:
        raise ValueError(f"nothing is published under {root}")
    lacking = [name for name in needed if name not in newest["tables"]]
    if lacking:
        raise ValueError(f"run {newest['run_id']} lacks {', '.join(lacking)}")
    tables = {name: spark.read.parquet(f"{root}/runs/{newest['run_id']}/{name}") for name in newest["tables"]}
    if "doors" in tables and not stale_versions(tables["doors"], CONTRACT).isEmpty():
        raise ValueError(f"published rows of another score contract than {CONTRACT}")
    return tables


def coverage(doors: DataFrame, spend: DataFrame | None = None, by: str = "territory_id") -> DataFrame:
    """Totals, coverage and cost per scored door; 0.0 over nothing. `spend` is (by, usd)."""
    counts = doors.groupBy(by).agg(
        F.count(F.lit(1)).alias("doors_total"), F.count_if(F.col("score").isNotNull()).alias("doors_scored")
    )
    counts = counts.withColumn("doors_unscored", F.col("doors_total") - F.col("doors_scored")).withColumn(
        "coverage", text.safe_rate(F.col("doors_scored"), F.col("doors_total"))
    )
    if spend is None:
        return counts
    paid = spend.groupBy(by).agg(F.sum("usd").alias("cost_usd"))
    return counts.join(paid, by, "left").withColumn("cost_usd", F.coalesce("cost_usd", F.lit(0.0))).withColumn(
        "cost_per_door", text.safe_rate(F.col("cost_usd"), F.col("doors_scored"))
    )


def run_manifest(
    doors: DataFrame, report: DataFrame, vintage: DataFrame, as_of, run_at: str, code_version: str,
    spend: DataFrame | None = None, degradations: DataFrame | None = None, by: str = "territory_id",
    retrieved: DataFrame | None = None, vision: DataFrame | None = None, register: DataFrame | None = None,
) -> DataFrame:
    """One JSON line per territory: inputs, coverage, vintages, resolve numbers and what was lost.

    `report` and `vintage` are keyed by `by`. `degradations` holds (reason), a handful of rows by nature, or (by, reason), which
    stay with their territory. Optional blocks: `retrieved` (by, source, retrieved) gives the last day of each source; `vision`
    (by, available, declination_reason, answers_total, answers_lost, doors_with_imagery) says what became of the answers, null for
    a territory without a row; `register` (by, source_files, doors_superseding_modiv) adds the sales register to the deed
    vintage, which then holds the window movers are counted in.
    """
    from doorlens.operators.report import freshness
    from doorlens.operators.resolve import MOVER_WINDOW_DAYS

    base = coverage(doors, spend, by)
    joined = base.join(report.drop("doors_total", "coverage"), by, "left").join(vintage, by, "left")
    no_words = F.array().cast("array<string>")
    lost = no_words
    if degradations is not None and by in degradations.columns:
        reasons = degradations.groupBy(by).agg(F.sort_array(F.collect_set("reason")).alias("_lost"))
        joined, lost = joined.join(reasons, by, "left"), F.coalesce("_lost", no_words)
    elif degradations is not None:
        lost = degradations.agg(F.sort_array(F.collect_set("reason"))).scalar()
    resolve_names = [c for c in report.columns if c not in (by, "doors_total", "coverage")]
    aged = [c for c in vintage.columns if c != by]
    deeds = [F.col(c) for c in aged]
    if register is not None:
        joined = joined.join(register.select(by, "source_files", "doors_superseding_modiv"), by, "left")
        sold = F.col("latest_sale_date") if "latest_sale_date" in aged else F.lit(None).cast("date")
        deeds = [F.col(c) for c in aged if c != "latest_sale_date"] + [
            F.lit(MOVER_WINDOW_DAYS).alias("mover_window_days"),
            F.struct(sold.alias("latest_sale_date"), F.coalesce("source_files", no_words).alias("source_files"),
                     F.coalesce("doors_superseding_modiv", F.lit(0)).alias("doors_superseding_modiv")).alias("sales_register"),
        ]
    blocks = []
    if retrieved is not None:
        joined = joined.join(freshness(retrieved, (by,)).withColumnRenamed("source_freshness", "retrieved"), by, "left")
        blocks.append(F.col("retrieved"))
    if vision is not None:
        facts = F.struct("available", "declination_reason", "answers_total", "answers_lost", "doors_with_imagery")
        joined = joined.join(vision.select(by, facts.alias("vision")), by, "left")
        blocks.append(F.col("vision"))
    body = F.struct(
        F.lit(run_at).alias("run_at"), dates.as_of_column(as_of).alias("as_of"), F.lit(CONTRACT).alias("score_contract_version"),
        F.lit(code_version).alias("code_version"), F.lit(0.35).alias("acs_dual_income_threshold"),
        *[F.col(c) for c in base.columns if c != by], F.struct(*deeds).alias("deed_vintage"), *blocks,
        lost.alias("degradations"), F.struct(*[F.col(c) for c in resolve_names]).alias("resolve"),
    )
    return joined.select(by, F.to_json(body, {"ignoreNullFields": "false"}).alias("manifest"))


def rounded_breakdown(doors: DataFrame) -> DataFrame:
    """Whole-number terms that still add up to the score: the adjustment is re-derived from them."""
    raw = F.coalesce("base", F.lit(0)) + F.coalesce("mover_lift", F.lit(0.0)) + F.coalesce("rental_modifier", F.lit(0))
    shown = {
        "shown_base": text.round_half_up(F.coalesce("base", F.lit(0)).cast("double")),
        "shown_lift": text.round_half_up(F.coalesce("mover_lift", F.lit(0.0))),
        "shown_rental": text.round_half_up(F.coalesce("rental_modifier", F.lit(0)).cast("double")),
    }
    return doors.withColumns(shown).withColumn(
        "shown_adjustment", F.col("score") - F.col("shown_base") - F.col("shown_lift") - F.col("shown_rental")
    ).withColumn("clamp", F.when(raw < 0, "floor").when(raw > 100, "ceiling"))


def reason_chips(evidence: DataFrame) -> DataFrame:
    """The one speakable entry type per door: most points, then the earlier name."""
    spoken = evidence.filter(~F.col("type").isin(*UNSPEAKABLE))
    return spoken.groupBy("territory_id", "pams_pin").agg(
        F.min_by("type", F.struct((-F.col("points")).alias("p"), F.col("type").alias("t"))).alias("reason_chip")
    )


def roof_extract(evidence: DataFrame, doors: DataFrame) -> DataFrame:
    """Doors that earned roof points with the facts behind them; a reader sorts by points, most first, and address."""
    aged = evidence.filter("type = 'fit_roof_age' and points > 0").select(
        "territory_id", "pams_pin", F.col("points").alias("roof_points")
    )
    facts = doors.select("territory_id", "pams_pin", F.col("situs").alias("address"),
                         F.col("roof_when").alias("roof_installed"), F.col("roof_age").alias("roof_age_years"),
                         F.col("score").alias("house_score"))
    return aged.join(facts, ["territory_id", "pams_pin"]).select(
        "territory_id", "roof_points", "address", "roof_installed", "roof_age_years", "house_score"
    )


# --- identity scan -----------------------------------------------------------------------------


def _is_identity(name: str) -> bool:
    return any(re.search(pattern, name, re.IGNORECASE) for pattern in IDENTITY_PATTERNS)


def schema_findings(table: str, schema: T.StructType) -> list[str]:
    """Every field path of a schema whose name looks like a personal identity."""
    found: list[str] = []

    def walk(node, path):
        if isinstance(node, T.StructType):
            for field in node.fields:
                here = f"{path}.{field.name}"
                if _is_identity(field.name):
                    found.append(here)
                walk(field.dataType, here)
        elif isinstance(node, T.ArrayType):
            walk(node.elementType, f"{path}[]")
        elif isinstance(node, T.MapType):
            walk(node.valueType, f"{path}{{}}")

    walk(schema, table)
    return sorted(found)
