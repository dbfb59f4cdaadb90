"""One project list per door out of the portal, the roof search and the statewide feed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doorlens.functions import dates, text
from doorlens.operators.ordering import tie_break

FIELDS = (
    "description", "work_type", "disposition", "issue_date", "statewide_issue_date", "completion_date",
    "last_activity_date",
)


def portal_projects(applications: DataFrame) -> DataFrame:
    """Portal applications grouped by municipal record.

    The last base record stands for the group; without one, the first amendment does.
    Amendments are counted into it. Blank ids are dropped. Among records of one `ordinal` their content decides.
    """
    issue, close = dates.us_date(F.col("issue_date")), dates.us_date(F.col("close_date"))
    number = text.blank_to_null(F.col("permit_number"))
    if "control_number" in applications.columns:
        number = F.coalesce(number, text.blank_to_null(F.col("control_number")))
    disposition = text.portal_disposition(F.col("status"))
    rows = applications.select(
        "territory_id", "pams_pin", number.alias("municipal_id"), "ordinal",
        text.is_amendment(F.col("work_type")).alias("amends"),
        F.struct(
            F.col("work_description").alias("description"), F.col("work_type").alias("work_type"),
            disposition.alias("disposition"), issue.alias("issue_date"),
            F.when(disposition == "completed", close).alias("completion_date"),
        ).alias("record"),
        tie_break([F.col(c) for c in ("work_description", "work_type", "status", "issue_date", "close_date")]).alias("tie"),
    ).filter("municipal_id is not null")
    base_last = F.struct(~F.col("amends"), F.when(F.col("amends"), -F.col("ordinal")).otherwise(F.col("ordinal")), "tie")
    return rows.groupBy("territory_id", "pams_pin", "municipal_id").agg(
        F.max_by("record", base_last).alias("r"),
        F.count_if("amends").alias("amendments"),
        F.min("ordinal").alias("first_seen"),
    ).select("territory_id", "pams_pin", "municipal_id", "r.*", "amendments", "first_seen")


def drop_same_day_statewide(statewide: DataFrame, portal: DataFrame, roof: DataFrame) -> DataFrame:
    """Statewide permits without a portal or roof permit of the same door and issue day; undated ones stay."""
    def days(df, day):
        return df.select("territory_id", "pams_pin", day.alias("issue_date"))

    known = days(portal, dates.us_date(F.col("issue_date"))).unionByName(days(roof, F.col("issue_date"))).distinct()
    return statewide.join(known, ["territory_id", "pams_pin", "issue_date"], "left_anti")


def coalesce_permits(
    applications: DataFrame, roof: DataFrame, statewide: DataFrame, drop_same_day: bool = True
) -> DataFrame:
    """All three sources as one row per (door, municipal id).

    One grouping does the work of both outer joins: the portal record leads, the first roof
    record fills its blanks, the statewide record fills lifecycle gaps and is named as a source.
    Where several rows of one source share an `ordinal`, their content decides.
    """
    if drop_same_day:
        statewide = drop_same_day_statewide(statewide, applications, roof)
    key = ["territory_id", "pams_pin", "municipal_id"]
    shape = "struct<description:string,work_type:string,disposition:string,issue_date:date," \
            "completion_date:date,statewide_issue_date:date,last_activity_date:date>"

    def rows(df, source, ordinal, **fields):
        names = ("description", "work_type", "disposition", "issue_date", "completion_date", "statewide_issue_date",
                 "last_activity_date")
        record = F.struct(*[fields.get(n, F.lit(None)).alias(n) for n in names]).cast(shape)
        extra = fields.get("amendments", F.lit(None)).cast("bigint").alias("amendments")
        tie = tie_break([fields[n] for n in names if n in fields]).alias("tie")
        return df.select(*key, F.lit(source).alias("origin"), ordinal.cast("bigint").alias("ordinal"), tie,
                         record.alias("record"), extra)

    projects = portal_projects(applications)
    merged = (
        rows(projects, 0, F.col("first_seen"), amendments=F.col("amendments"),
             **{n: F.col(n) for n in ("description", "work_type", "disposition", "issue_date", "completion_date")})
        .unionByName(rows(
            roof.filter("municipal_id != ''"), 1, F.col("ordinal"),
            **{n: F.col(n) for n in ("description", "work_type", "disposition", "issue_date")}))
        .unionByName(rows(
            statewide.filter("municipal_id != ''"), 2, F.col("ordinal"), description=F.col("description"),
            statewide_issue_date=F.col("issue_date"), completion_date=F.col("completion_date")))
    )

    order = F.struct("ordinal", "tie")

    def of(origin, value):
        return F.min_by(F.when(F.col("origin") == origin, value), F.when(F.col("origin") == origin, order))

    # Several roof rows of one id fill one another's blanks in order, so each field has its own first.
    def first_roof(name):
        value = F.col(f"record.{name}")
        there = (F.col("origin") == 1) & (value.isNotNull() if name == "issue_date" else F.coalesce(value, F.lit("")) != "")
        return F.min_by(F.when(there, value), F.when(there, order)).alias(f"roof_{name}")

    def first_statewide(name):
        value = F.col(f"record.{name}")
        there = (F.col("origin") == 2) & value.isNotNull()
        return F.min_by(F.when(there, value), F.when(there, order)).alias(f"state_{name}")

    grouped = merged.groupBy(*key).agg(
        of(0, F.col("record")).alias("portal"),
        F.max("amendments").alias("amendments"),
        F.bool_or(F.col("origin") < 2).alias("has_portal"), F.bool_or(F.col("origin") == 2).alias("has_statewide"),
        *[first_roof(n) for n in ("description", "work_type", "disposition", "issue_date")],
        *[first_statewide(n) for n in ("disposition", "statewide_issue_date", "completion_date", "last_activity_date")],
        of(2, F.col("record.description")).alias("state_description"),
        F.min(F.struct("origin", "ordinal")).alias("seen"),
    )

    def filled(name):
        own = text.blank_to_null(F.col(f"portal.{name}")) if name != "issue_date" else F.col(f"portal.{name}")
        return F.coalesce(own, F.col(f"roof_{name}"))

    return grouped.select(
        *key,
        F.when(F.col("has_portal"), filled("description")).otherwise(F.col("state_description")).alias("description"),
        filled("work_type").alias("work_type"),
        F.coalesce(filled("disposition"), F.col("state_disposition")).alias("disposition"),
        filled("issue_date").alias("issue_date"),
        F.col("state_statewide_issue_date").alias("statewide_issue_date"),
        F.coalesce(F.col("portal.completion_date"), F.col("state_completion_date")).alias("completion_date"),
        F.col("state_last_activity_date").alias("last_activity_date"),
        F.col("has_portal").alias("from_portal"), F.col("has_statewide").alias("from_statewide"),
        F.coalesce("amendments", F.lit(0)).alias("amendments"),
        # Portal records first, then roof-only, then statewide-only, each in input order.
        F.col("seen.origin").alias("origin"), F.col("seen.ordinal").alias("ordinal"),
    )


def dedupe_permits(
    permits: DataFrame, by=("territory_id", "pams_pin"), clock: DataFrame | None = None, fields: Sequence[str] | None = None
) -> DataFrame:
    """One record per municipal id: the first, unless a later portal record replaces a non-portal one.

    The place in the order stays that of the first record seen. Among records of one `ordinal` their content decides.
    `clock` (by, as_of) adds its day and drops records of doors it does not list; it is met before the grouping, so that one dealing
    of the rows by door serves both. `fields` are the columns wanted of a record, all by default.
    """
    key = [*by, "dedupe_key"]
    keyed = permits.withColumn(
        "dedupe_key", F.coalesce(text.blank_to_null(F.col("municipal_id")), F.col("permit_id"))
    )
    rest = [c for c in keyed.columns if c not in key and c != "ordinal"]
    content = [F.col(f.name) for f in keyed.schema.fields if f.name in rest and "map<" not in f.dataType.simpleString()]
    rest = [c for c in rest if fields is None or c in fields]
    keyed = keyed.select(*key, *rest, "ordinal", tie_break(content).alias("_tie"))
    if clock is not None:
        keyed, rest = keyed.join(clock.select(*by, "as_of"), list(by)), [*rest, "as_of"]
    choice = F.struct(F.when(F.col("from_portal"), 0).otherwise(1), F.col("ordinal"), F.col("_tie"))
    return keyed.groupBy(*key).agg(
        F.min_by(F.struct(*rest), choice).alias("r"), F.min("ordinal").alias("ordinal")
    ).select(*key, "r.*", "ordinal")
