"""Model answers about image tiles: parsing, the row contract, provenance, and door signals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doorlens.functions import geo
from doorlens.functions.dates import strip

# Fixed values.
GRADES = ("poor", "fair", "good", "excellent")
SIGNALS = ("pool", "solar", "condition_poor", "condition_fair", "condition_good", "condition_excellent")
CONFIDENCE_FLOOR = 0.60
SCORED_VINTAGES = ("2015", "2020")
REASON_ENVELOPE = "response was not a {'detections': [...]} JSON object"
REASON_NOT_OBJECT = "detection entry was not an object"
REASON_NOT_IN_BATCH = "detection names an image_ref that was not in this batch"
REASON_SIGNAL = "unknown vision signal"
REASON_PRESENT = "present must be a bool"
REASON_CONFIDENCE = "confidence must be a number within [0, 1]"
REASON_BLANK = "pams_pin, image_ref and capture_date must be non-blank"


def tile_manifest(doors: DataFrame, vintages=geo.VINTAGES, pixels: int = 640) -> DataFrame:
    """One frame per door with a position and vintage. The vintages are a literal array, so no join."""
    placed = doors.filter("lon is not null and lat is not null")
    return placed.select(
        "territory_id", "pams_pin", "lon", "lat",
        F.explode(F.array(*[F.lit(v) for v in vintages])).alias("vintage"),
    ).select(
        "territory_id", "pams_pin", "vintage",
        geo.tile_ref(F.col("lon"), F.col("lat"), F.col("vintage"), pixels).alias("image_ref"),
        F.concat(F.col("vintage").cast("string"), F.lit("-01-01")).alias("capture_date"),
    )


def unseen_tiles(tiles: DataFrame, seen: DataFrame, prompt_version: str) -> DataFrame:
    """Tiles no answer was banked for under this prompt; an empty answer counts as seen."""
    banked = seen.filter(F.col("prompt_version") == prompt_version).select("image_ref").distinct()
    return tiles.join(banked, "image_ref", "left_anti")


def _fence_free(answer):
    """The answer without one Markdown fence around it; the patterns only run where there is one."""
    body = strip(F.coalesce(answer, F.lit("")))
    inner = F.regexp_replace(F.regexp_replace(body, r"^```[^\n]*\n?", ""), r"\n\s*```[^\n]*$", "")
    inner = F.when(strip(inner).startswith("```"), F.lit("")).otherwise(inner)
    return F.when(body.startswith("```"), strip(inner)).otherwise(body)


def parse_answers(responses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, failures): one row per listed detection; an answer that is no envelope is one failure."""
    parsed = responses.withColumn("_doc", F.try_parse_json(_fence_free(F.col("response")))).withColumn(
        "_list", F.try_variant_get("_doc", "$.detections", "array<variant>")
    )
    failures = parsed.filter("_list is null").select(
        "batch_id", "ordinal", F.lit(None).cast("string").alias("image_ref"), F.lit(REASON_ENVELOPE).alias("reason"),
        F.col("response").alias("raw"),
    )
    rows = parsed.filter("_list is not null").select(
        "batch_id", "ordinal", F.col("response").alias("raw"), F.posexplode("_list").alias("row_number", "_row")
    )

    def kind(path):
        return F.schema_of_variant(F.try_variant_get("_row", path, "variant"))

    return rows.select(
        "batch_id", "ordinal", "row_number", "raw",
        F.schema_of_variant("_row").startswith("OBJECT").alias("is_object"),
        F.when(kind("$.image_ref") == "STRING", F.try_variant_get("_row", "$.image_ref", "string")).alias("image_ref"),
        F.when(kind("$.signal") == "STRING", F.try_variant_get("_row", "$.signal", "string")).alias("signal"),
        F.when(kind("$.present") == "BOOLEAN", F.try_variant_get("_row", "$.present", "boolean")).alias("present"),
        F.when(
            kind("$.confidence").rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"),
            F.try_variant_get("_row", "$.confidence", "double"),
        ).alias("confidence"),
    ), failures


def contract_reason(df: DataFrame):
    """Why a detection row breaks the contract; NULL when it holds."""
    c = F.col

    def blank(name):
        return F.coalesce(F.trim(name), F.lit("")) == ""

    return (
        F.when(blank("pams_pin") | blank("image_ref") | blank("capture_date"), REASON_BLANK)
        .when(c("signal").isNull() | ~c("signal").isin(*SIGNALS), REASON_SIGNAL)
        .when(c("present").isNull(), REASON_PRESENT)
        .when(c("confidence").isNull() | F.isnan("confidence") | ~c("confidence").between(0.0, 1.0), REASON_CONFIDENCE)
    )


def detections_from(responses: DataFrame, tiles: DataFrame, batches: DataFrame | None = None):
    """(valid, quarantine). Pin and date come from the tile; a frame that was not sent is a made-up claim.

    `batches` (batch_id, image_ref) says which frames went out together; without it any tile counts.
    """
    rows, failures = parse_answers(responses)
    frames = tiles.select("image_ref", "territory_id", "pams_pin", "capture_date")
    if batches is not None:
        frames = batches.select("batch_id", "image_ref").distinct().join(frames, "image_ref")
        joined = rows.join(frames, ["batch_id", "image_ref"], "left")
    else:
        joined = rows.join(frames, "image_ref", "left")
    checked = joined.withColumn(
        "reason",
        F.when(~F.col("is_object"), REASON_NOT_OBJECT).when(F.col("pams_pin").isNull(), REASON_NOT_IN_BATCH)
        .otherwise(contract_reason(joined)),
    )
    valid = checked.filter("reason is null").select(
        "batch_id", "ordinal", "row_number", "territory_id", "pams_pin", "image_ref", "capture_date", "signal", "present",
        "confidence",
    )
    bad = checked.filter("reason is not null").select("batch_id", "ordinal", "image_ref", "reason", "raw")
    return valid, failures.unionByName(bad)


def condition_declined(before, after):
    """Both grades known and the later one worse."""
    scale = F.array(*[F.lit(g) for g in GRADES])
    old, new = F.array_position(scale, before), F.array_position(scale, after)
    return F.coalesce((old > 0) & (new > 0) & (new < old), F.lit(False))


def imagery_signals(detections: DataFrame, floor: float = CONFIDENCE_FLOOR, order=("ordinal",)) -> DataFrame:
    """One row per door: last claims at or above the floor, condition per vintage, and the frames.

    Every value is a max_by over the input order, so a door with very many claims is combined
    on the map side.
    """
    kept = detections.filter(F.col("confidence") >= floor)
    rank = F.struct(*[F.col(c) for c in order])
    grade = F.regexp_extract("signal", "^condition_(.*)$", 1)
    vintage = F.substring("capture_date", 1, 4)
    frame = F.struct("image_ref", "confidence", "capture_date")
    is_grade = (grade != "") & F.col("present") & vintage.isin(*SCORED_VINTAGES)
    # The newest capture wins; among equals the first seen.
    numeric = [-F.col(c) for c in order]
    newest = F.struct(F.col("capture_date"), *numeric)

    def last(value, where):
        return F.max_by(F.when(where, value), F.when(where, rank))

    columns = []
    for kind in ("pool", "solar"):
        here = F.col("signal") == kind
        columns.append(F.coalesce(last(F.col("present"), here), F.lit(False)).alias(kind))
        columns.append(last(frame, here & F.col("present")).alias(f"{kind}_frame"))
    for v in SCORED_VINTAGES:
        columns.append(last(grade, is_grade & (vintage == v)).alias(f"condition_{v}"))
    columns.append(F.max_by(F.when(is_grade, frame), F.when(is_grade, newest)).alias("condition_frame"))
    signals = kept.groupBy("territory_id", "pams_pin").agg(*columns)
    return signals.withColumn("declined", condition_declined(F.col("condition_2015"), F.col("condition_2020")))


def complete_frame(frame):
    """The frame with its corner numbers, or NULL unless every part is there."""
    box = geo.ref_bbox(frame["image_ref"])
    whole = box.isNotNull() & frame["confidence"].isNotNull() & frame["capture_date"].isNotNull()
    return F.when(
        whole,
        F.struct(
            box.alias("bbox"), frame["capture_date"].alias("capture_date"), frame["image_ref"].alias("image_url"),
            frame["confidence"].alias("model_confidence"),
        ),
    )


def observations(signals: DataFrame) -> DataFrame:
    """Per door the confidence of each established kind, NULL where there is none; 1.0 without a complete frame."""
    def confidence(present, frame):
        return F.when(present, F.coalesce(complete_frame(F.col(frame))["model_confidence"], F.lit(1.0)))

    return signals.select(
        "territory_id", "pams_pin",
        confidence(F.col("pool"), "pool_frame").alias("pool_confidence"),
        confidence(F.col("solar"), "solar_frame").alias("solar_confidence"),
        confidence(F.col("declined"), "condition_frame").alias("decline_confidence"),
    )


# Which frame re-opens which evidence type.
FRAME_OF = {"fit_pool": "pool_frame", "fit_solar": "solar_frame", "fit_condition_decline": "condition_frame"}


def attach_frames(evidence: DataFrame, signals: DataFrame) -> DataFrame:
    """Adds `imagery` JSON to imagery-derived evidence whose frame is complete."""
    frames = signals.select("territory_id", "pams_pin", *FRAME_OF.values())
    pick = None
    for kind, frame in FRAME_OF.items():
        cell = F.to_json(complete_frame(F.col(frame)))
        pick = F.when(F.col("type") == kind, cell) if pick is None else pick.when(F.col("type") == kind, cell)
    return (
        evidence.join(frames, ["territory_id", "pams_pin"], "left").withColumn("imagery", pick).drop(*FRAME_OF.values())
    )


def vision_metrics(labels: DataFrame, by=()) -> DataFrame:
    """Precision and recall over ordinary rows, false claims over probe rows; 0.0 over nothing."""
    from doorlens.functions.text import safe_rate

    plain = ~F.col("probe")
    counts = labels.groupBy(*by).agg(
        F.count_if(plain & F.col("actual") & F.col("predicted")).alias("tp"),
        F.count_if(plain & ~F.col("actual") & F.col("predicted")).alias("fp"),
        F.count_if(plain & F.col("actual") & ~F.col("predicted")).alias("fn"),
        F.count_if(plain & ~F.col("actual") & ~F.col("predicted")).alias("tn"),
        F.count_if(F.col("probe") & F.col("predicted")).alias("probe_claims"),
        F.count_if("probe").alias("probe_rows"),
    )
    return (
        counts.withColumn("precision", safe_rate(F.col("tp"), F.col("tp") + F.col("fp")))
        .withColumn("recall", safe_rate(F.col("tp"), F.col("tp") + F.col("fn")))
        .withColumn("hallucination_rate", safe_rate(F.col("probe_claims"), F.col("probe_rows")))
    )
