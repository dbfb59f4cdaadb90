"""Per-door facts out of permits, sales, comparables, values and rental listings.

Each source is reduced to one row per door by combinable aggregates keyed by the door,
so the later joins line up on the same key and a door with very many records costs no
single task more than its share.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from doorlens.functions import dates, text
from doorlens.operators.ordering import medians, ranked_histogram
from doorlens.operators.permits import dedupe_permits

DOOR = ["territory_id", "pams_pin"]
BRIEF_LIMIT = 3

# Attribution lines.
SOURCE_MODIV = "NJ MOD-IV parcel record"
SOURCE_SR1A = "NJ SR1A sales register"
SOURCE_STATEWIDE = "NJ DCA construction permits (Socrata)"
SOURCE_PORTAL = "Ramsey municipal permits (SDL portal)"
SOURCE_PORTAL_SALE = "Ramsey municipal property page (SDL portal)"
SOURCE_ACS = "US Census ACS 5-year estimates, block group"
SOURCE_RENTAL = "municipal rental registration list"
SOURCE_IMAGERY = "NJ aerial orthoimagery"


# What the flags of a permit are worked out of, and what is read of a permit once they are.
PERMIT_FIELDS = (
    "description", "work_type", "disposition", "issue_date", "completion_date", "last_activity_date", "from_portal", "from_statewide",
)
CLASSIFIED = (
    *DOOR, "as_of", "ordinal", "brief", "completed_on", "active", "completed", "is_roof", "is_install", "supersedes", "is_pool", "is_solar",
    "from_portal", "from_statewide",
)


def permit_source(portal, statewide):
    """The sources named once each, portal first; the portal when none is known."""
    both = F.concat_ws(" + ", F.when(portal, SOURCE_PORTAL), F.when(statewide, SOURCE_STATEWIDE))
    return F.when(both != "", both).otherwise(F.lit(SOURCE_PORTAL))


def sale_source(register, parcel, portal):
    names = F.concat_ws(
        " + ", F.when(register, SOURCE_SR1A), F.when(parcel, SOURCE_MODIV), F.when(portal, SOURCE_PORTAL_SALE)
    )
    return F.when(names != "", names).otherwise(F.lit(SOURCE_MODIV))


def permit_brief(description="description", work_type="work_type", issue="issue_date"):
    what = F.coalesce(
        text.blank_to_null(F.col(description)), text.blank_to_null(F.col(work_type)), F.lit("permit")
    )
    return F.concat(F.trim(what), F.coalesce(F.concat(F.lit(", issued "), F.col(issue).cast("string")), F.lit("")))


def briefs(first, count, limit: int):
    """`first` briefs joined, and how many more there are."""
    listed = F.array_join(first, "; ")
    return F.when(count > limit, F.concat(listed, F.lit("; and "), (count - limit).cast("string"), F.lit(" more"))) \
        .otherwise(listed)


# --- permits -----------------------------------------------------------------------


def completion_day(disposition, completion, issue):
    """The completion day of a completed permit, its issue day when no other is displayed."""
    return F.when(F.lower(disposition) == "completed", F.coalesce(completion, issue))


def is_active(disposition, last_activity, issue, as_of):
    """No disposition, and some activity within the last twelve months."""
    start = dates.years_back(as_of, 1)
    recent = F.coalesce(last_activity.between(start, as_of), F.lit(False)) | F.coalesce(
        issue.between(start, as_of), F.lit(False)
    )
    return F.coalesce(disposition, F.lit("")).eqNullSafe("") & recent


def classify_permits(permits: DataFrame, clock: DataFrame | None, as_of=None, fields: Sequence[str] | None = None) -> DataFrame:
    """Deduplicated permits with the flags every category reads. `fields` are the columns of a record that are kept, all by default."""
    unique = dedupe_permits(permits, clock=clock, fields=fields)
    if clock is None:
        unique = unique.withColumn("as_of", dates.as_of_column(as_of))
    c, day = F.col, F.col("as_of")
    state = F.lower(F.coalesce("disposition", F.lit("")))
    done = completion_day(c("disposition"), c("completion_date"), c("issue_date"))
    qualifies = ~state.isin(*text.NON_QUALIFYING)
    active = is_active(c("disposition"), c("last_activity_date"), c("issue_date"), day)
    recent = F.coalesce(c("completed_on").between(dates.years_back(day, 2), day), F.lit(False))
    return (
        unique.withColumn("completed_on", done)
        .withColumn("active", qualifies & active)
        .withColumn("completed", qualifies & ~active & recent)
        .withColumn("brief", permit_brief())
        .withColumn("is_roof", text.is_roof_record(c("description")))
        .withColumn("is_install", text.is_roof_install(c("description")))
        .withColumn("supersedes", text.is_exterior(c("description")) & F.coalesce(
            c("completed_on") > F.lit(dt.date(2020, 12, 31)), F.lit(False)))
        .withColumn("is_pool", F.lower("description").contains("pool") & c("completed_on").isNotNull())
        .withColumn("is_solar", F.lower("description").contains("solar") & c("completed_on").isNotNull())
    )


def permit_facts(classified: DataFrame) -> DataFrame:
    """One row per door that has permits."""
    c = F.col

    def flag(name):
        return F.coalesce(c(name), F.lit(False))

    def sources(prefix, where):
        return [
            F.bool_or(where & c("from_portal")).alias(f"{prefix}_portal"),
            F.bool_or(where & c("from_statewide")).alias(f"{prefix}_statewide"),
        ]

    everything = F.lit(True)
    dated = flag("is_install") & F.coalesce(c("completed_on") <= c("as_of"), F.lit(False))
    facts = classified.groupBy(*DOOR).agg(
        F.count(F.lit(1)).alias("permits"),
        F.count_if(flag("active") | flag("completed")).alias("projects"),
        *sources("any", everything),
        F.count_if("is_roof").alias("roof_records"), *sources("roof", flag("is_roof")),
        F.max(F.when(dated, c("completed_on"))).alias("roof_when"), *sources("install", flag("is_install")),
        F.count_if("supersedes").alias("superseding"), *sources("superseding", flag("supersedes")),
        F.count_if(flag("is_pool")).alias("pool_permits"), *sources("pool", flag("is_pool")),
        F.count_if(flag("is_solar")).alias("solar_permits"), *sources("solar", flag("is_solar")),
        F.min_by(F.when(flag("is_pool"), c("brief")), F.when(flag("is_pool"), c("ordinal"))).alias("pool_first"),
        F.min_by(F.when(flag("is_solar"), c("brief")), F.when(flag("is_solar"), c("ordinal"))).alias("solar_first"),
    )
    # The first three briefs of two kinds. The limit is applied before the shuffle too.
    kinds = classified.select(
        *DOOR, "ordinal", "brief",
        F.explode(F.filter(
            F.array(F.when(flag("is_roof"), "roof"), F.when(flag("supersedes"), "exterior")), lambda k: k.isNotNull()
        )).alias("kind"),
    )
    place = F.row_number().over(Window.partitionBy(*DOOR, "kind").orderBy("ordinal"))
    listed = kinds.withColumn("_n", place).filter(F.col("_n") <= BRIEF_LIMIT)

    def first(kind):
        picked = F.sort_array(F.collect_list(F.when(F.col("kind") == kind, F.struct("ordinal", "brief"))))
        return F.transform(picked, lambda s: s.brief).alias(f"{kind}_briefs")

    return facts.join(listed.groupBy(*DOOR).agg(first("roof"), first("exterior")), DOOR, "left")


# --- sales, rental, values -------------------------------------------------------------


def mover_valid(price, code, day, as_of):
    return F.coalesce((price > 100) & (F.trim(F.coalesce(code, F.lit(""))) == "") & (day <= as_of), F.lit(False))


def sale_facts(sales: DataFrame, clock: DataFrame | None, as_of=None) -> DataFrame:
    """Latest valid sale with its attribution, and which sources hold an invalid one."""
    dated = sales.join(clock, DOOR) if clock is not None else sales.withColumn("as_of", dates.as_of_column(as_of))
    rows = dated.withColumn(
        "valid", mover_valid(F.col("sale_price"), F.col("sales_code"), F.col("sale_day"), F.col("as_of"))
    )

    def invalid(name):
        return F.bool_or(~F.col("valid") & (F.coalesce("source", F.lit("")) == name)).alias(f"invalid_{name.lower()}")

    rank = F.when(F.col("valid"), F.struct(F.col("sale_day"), -F.col("ordinal")))
    return rows.groupBy(*DOOR).agg(
        F.max(F.when(F.col("valid"), F.col("sale_day"))).alias("last_sale"),
        F.max_by(F.when(F.col("valid"), F.col("source")), rank).alias("last_sale_source"),
        F.count_if(~F.col("valid")).alias("invalid_sales"),
        invalid("SR1A"), invalid("MODIV"), invalid("SDL"),
    )


def rental_facts(registry: DataFrame) -> DataFrame:
    return registry.groupBy(*DOOR).agg(F.max("reg_date").alias("last_registration"))


def comparable_facts(comparables: DataFrame) -> DataFrame:
    """Count and median of the comparables of each door; at most 20 rows a door by construction."""
    return comparables.filter("value is not null").groupBy(*DOOR).agg(
        F.count(F.lit(1)).alias("comps"), F.median("value").alias("comp_median")
    )


def value_ranks(values: DataFrame) -> DataFrame:
    """(territory_id, value, below, equal, total) of the territory's assessed values."""
    return ranked_histogram(values, ["territory_id"], "value").select(
        "territory_id", "value", "below", F.col("n").alias("equal"), "total"
    )


def midrank_percentile(below, equal, total):
    return (below + equal * F.lit(0.5)) / total * F.lit(100.0)


def territory_median(parcels: DataFrame) -> DataFrame:
    """Median assessed value of valued class-2 parcels per territory, 0.0 where there are none."""
    every = parcels.select("territory_id").distinct()
    valued = parcels.filter("prop_class = '2' and net_value > 0")
    found = medians(valued, ["territory_id"], "net_value", "median_value").select("territory_id", "median_value")
    return every.join(found, "territory_id", "left").withColumn("median_value", F.coalesce("median_value", F.lit(0.0)))


# --- source precedence -------------------------------------------------------------------


def assessed_value(net_value, portal_total, portal_exact):
    """The assessment roll when above zero, else the portal figure of an exactly matched page."""
    return F.coalesce(F.when(net_value > 0, net_value), F.when(portal_exact, text.money(portal_total)))


def preferred_sales(register: DataFrame, parcels: DataFrame, portal: DataFrame, as_of) -> DataFrame:
    """All register sales of a door, else the parcel's own transfer, else the portal's displayed sale."""
    day = dates.deed_date(F.col("deed_date"), as_of)
    columns = [*DOOR, "ordinal", "source", "sale_day", "sale_price", "sales_code"]
    first = register.select(
        *DOOR, "ordinal", F.lit("SR1A").alias("source"), day.alias("sale_day"), "sale_price",
        F.coalesce("nu_code", F.lit("")).alias("sales_code"), F.lit(1).alias("rank"),
    )
    second = parcels.select(
        *DOOR, F.lit(0).cast("bigint").alias("ordinal"), F.lit("MODIV").alias("source"), day.alias("sale_day"),
        "sale_price", F.coalesce("sales_code", F.lit("")).alias("sales_code"), F.lit(2).alias("rank"),
    ).filter("sale_price > 0")
    third = portal.filter("collection_status = 'collected'").select(
        *DOOR, F.lit(0).cast("bigint").alias("ordinal"), F.lit("SDL").alias("source"),
        dates.us_date(F.col("last_sale_date")).alias("sale_day"),
        text.money(F.col("last_sale_price")).alias("sale_price"), F.lit("").alias("sales_code"), F.lit(3).alias("rank"),
    ).filter("sale_price > 0")
    every = first.unionByName(second).unionByName(third).filter("sale_day is not null")
    best = every.groupBy(*DOOR).agg(F.min("rank").alias("rank"))
    return every.join(best, [*DOOR, "rank"], "left_semi").select(*columns)
