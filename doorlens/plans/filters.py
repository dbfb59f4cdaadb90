"""Row filters (F)."""

from __future__ import annotations

from pyspark.sql import functions as F

from doorlens.functions import dates, keys, text
from doorlens.operators import filters, resolve
from doorlens.operators.spatial import valid_single_family
from doorlens.plans.analogs import AS_OF, AS_OF_SQL, Tables
from doorlens.plans.registry import query
from doorlens.scoring import facts

A = AS_OF_SQL
ROOF = "description LIKE '%roof%' OR description LIKE '%reroof%' OR description LIKE '%reshingle%'"


def as_text(name):
    return F.col(name).cast("string").alias(name)


@query("f1_class_filter", "SELECT pams_pin, prop_class FROM v_parcel WHERE prop_class = '2'")
def class_filter(t: Tables):
    return filters.of_class(t.v_parcel).select("pams_pin", "prop_class")


@query("f2_valid_single_family", """SELECT territory_id, count(*) AS homes, round(sum(net_value), 2) AS total FROM v_parcel
    WHERE prop_class = '2' AND net_value > 0 AND lon IS NOT NULL GROUP BY territory_id""")
def single_family(t: Tables):
    return valid_single_family(t.v_parcel).groupBy("territory_id").agg(
        F.count(F.lit(1)).alias("homes"), F.round(F.sum("net_value"), 2).alias("total")
    )


@query("f3_permits_within", f"""SELECT record_id, CAST(permit_date AS STRING) AS permit_date FROM v_permit_raw
    WHERE permit_date >= {A} - 730 AND permit_date <= {A}""")
def permits_within(t: Tables):
    return resolve.permits_within(t.v_permit_raw, AS_OF).select("record_id", as_text("permit_date"))


@query("f4_sales_within", f"""SELECT ordinal FROM v_sale
    WHERE deed_date <> '' AND sale_day <= {A} AND sale_day >= {A} - 90""")
def sales_within(t: Tables):
    return resolve.sales_within(t.v_sale, AS_OF, 90).select("ordinal")


@query("f5_mover_valid_sale", f"""SELECT ordinal FROM v_sale
    WHERE sale_price > 100 AND nu_code = '' AND sale_day <= {A}""")
def mover_valid_sale(t: Tables):
    return t.v_sale.filter(
        facts.mover_valid(F.col("sale_price"), F.col("nu_code"), F.col("sale_day"), F.lit(AS_OF))
    ).select("ordinal")


@query("f6_permit_active", f"""SELECT ordinal FROM v_permit
    WHERE disposition IS NULL AND issue_date BETWEEN DATE '2000-06-30' AND {A}""")
def permit_active(t: Tables):
    nothing = F.lit(None).cast("date")
    return t.v_permit.filter(
        facts.is_active(F.col("disposition"), nothing, F.col("issue_date"), F.lit(AS_OF))
    ).select("ordinal")


@query("f7_permit_completed", f"""SELECT ordinal, CAST(coalesce(completion_date, issue_date) AS STRING) AS completed_on
    FROM v_permit WHERE disposition = 'completed'
      AND coalesce(completion_date, issue_date) BETWEEN DATE '1999-06-30' AND {A}""")
def permit_completed(t: Tables):
    day = facts.completion_day(F.col("disposition"), F.col("completion_date"), F.col("issue_date"))
    end = F.lit(AS_OF)
    return t.v_permit.withColumn("completed_on", day).filter(
        F.col("completed_on").between(dates.years_back(end, 2), end)
    ).select("ordinal", as_text("completed_on"))


@query("f8_qualifying_disposition", """SELECT ordinal, disposition FROM v_permit
    WHERE disposition IS NULL OR disposition NOT IN ('voided', 'abandoned', 'denied', 'expired', 'administrative')""")
def qualifying_disposition(t: Tables):
    state = F.lower(F.coalesce("disposition", F.lit("")))
    return t.v_permit.filter(~state.isin(*text.NON_QUALIFYING)).select("ordinal", "disposition")


@query("f9_roof_flags", f"""SELECT ordinal, ({ROOF}) AS is_roof,
       (({ROOF}) AND description LIKE '%replacement%'
        AND description NOT LIKE '%repair%' AND description NOT LIKE '%solar%') AS is_install
    FROM v_permit""")
def roof_flags(t: Tables):
    return t.v_permit.select(
        "ordinal", text.is_roof_record(F.col("description")).alias("is_roof"),
        text.is_roof_install(F.col("description")).alias("is_install"),
    )


@query("f10_exterior_scope", """SELECT ordinal FROM v_permit
    WHERE (description LIKE '%roof%' OR description LIKE '%siding%' OR description LIKE '%window%')
      AND disposition = 'completed' AND coalesce(completion_date, issue_date) > DATE '2000-12-31'""")
def exterior_scope(t: Tables):
    day = facts.completion_day(F.col("disposition"), F.col("completion_date"), F.col("issue_date"))
    return t.v_permit.filter(text.is_exterior(F.col("description")) & (day > F.lit("2000-12-31").cast("date"))).select(
        "ordinal"
    )


@query("f11_confidence_floor", """SELECT signal, count(*) AS kept FROM v_detection WHERE confidence >= 0.6
    GROUP BY signal""")
def confidence_floor(t: Tables):
    return t.v_detection.filter(F.col("confidence") >= 0.60).groupBy("signal").agg(F.count(F.lit(1)).alias("kept"))


@query("f12_score_range", """SELECT pams_pin, coalesce(score, -1) AS score FROM v_door_score
    WHERE score BETWEEN 20 AND 60 OR score IS NULL""")
def score_range(t: Tables):
    return filters.score_range(t.v_door_score, 20, 60, True).select(
        "pams_pin", F.coalesce("score", F.lit(-1)).alias("score")
    )


@query("f13_exclusion_reason", """SELECT p.pams_pin, 'parcel record incomplete in county data' AS exclusion_reason
    FROM v_parcel p JOIN v_parcel_raw r ON p.k = r.k
    WHERE (r.deed_date IS NULL OR r.deed_date = '991332') AND p.yr_constr <= 0 AND p.net_value <= 0""")
def exclusion_reason(t: Tables):
    raw = t.v_parcel_raw.select("k", dates.deed_date(F.col("deed_date"), AS_OF).alias("deed_day"))
    return filters.with_exclusion(t.v_parcel.join(raw, "k")).filter("exclusion_reason is not null").select(
        "pams_pin", "exclusion_reason"
    )


@query("f14_placeholder", """SELECT record_id FROM v_permit_raw WHERE ltrim(trim(block), '0') = ''
    OR ltrim(trim(lot), '0') = ''""")
def placeholder(t: Tables):
    return keys.with_parcel_keys(t.v_permit_raw).filter("is_placeholder").select("record_id")


@query("f15_routable", "SELECT pams_pin FROM v_route_door WHERE score IS NOT NULL AND lon IS NOT NULL")
def routable(t: Tables):
    return filters.routable(t.v_route_door).select("pams_pin")
