"""Operators that read or write files: each query writes the public format from the given tables, then reads it back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doorlens.operators import documents, history, publish, spatial
from doorlens.operators.ordering import first_per_key
from doorlens.plans.analogs import AS_OF, AS_OF_SQL, Tables
from doorlens.plans.registry import query
from doorlens.session import ensure_checkpoint_dir
from doorlens.sources import filesets, layout, readers

#: Features on one service page.
PAGE = 40


def folder(t: Tables, name: str) -> str:
    return f"{ensure_checkpoint_dir(t.spark)}/{name}-{uuid.uuid4().hex}"


def write_documents(t: Tables, documents: DataFrame, name: str) -> str:
    """One file per row of JSON text, as a service leaves its pages."""
    path = folder(t, name)
    documents.write.option("maxRecordsPerFile", 1).text(path)
    return path


def paged(rows: DataFrame, order: str, feature, key: str = "features") -> DataFrame:
    """Rows as pages of PAGE features; the first feature of a page also stands, again, at the end of the page before."""
    page = F.floor(F.col(order) / PAGE)
    twice = F.when((F.col(order) % PAGE == 0) & (page > 0), F.array(page, page - 1)).otherwise(F.array(page))
    spread = rows.select(F.explode(twice).alias("page"), F.col(order).alias("at"), feature.alias("f"))
    return spread.groupBy("page").agg(F.sort_array(F.collect_list(F.struct("at", "f"))).alias("all")).select(
        F.to_json(F.struct(F.transform("all", lambda x: x["f"]).alias(key)), {"ignoreNullFields": "false"}))


def square(x, y, half: float = 0.0001):
    return spatial.box_polygon(x - half, y - half, x + half, y + half)


@query("s1_read_parcels", """SELECT pams_pin, mun, prop_class, block, lot, net_value, yr_constr, round(lon, 6) AS lon, round(lat, 6) AS lat
    FROM v_parcel""")
def read_parcels(t: Tables):
    text = {"OBJECTID": "k", "PAMS_PIN": "pams_pin", "PCL_MUN": "mun", "PCLBLOCK": "block", "PCLLOT": "lot", "PROP_CLASS": "prop_class",
            "NET_VALUE": "net_value", "YR_CONSTR": "yr_constr", "OWNER_NAME": "pams_pin"}
    properties = F.struct(*[F.col(c).cast("string").alias(name) for name, c in text.items()])
    shape = F.when(F.col("lon").isNotNull(), F.struct(F.lit("MultiPolygon").alias("type"), square(F.col("lon"), F.col("lat")).alias("coordinates")))
    path = write_documents(t, paged(t.v_parcel, "k", F.struct(properties.alias("properties"), shape.alias("geometry"))), "parcels")
    return readers.read_parcels(t.spark, path).select(
        "pams_pin", "mun", "prop_class", "block", "lot", "net_value", "yr_constr", F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"))


@query("s11_read_boundaries", """SELECT p.pams_pin, arg_min(b.geoid, b.ordinal) AS geoid FROM v_parcel p JOIN v_block_group b
    ON p.lon BETWEEN b.min_x AND b.max_x AND p.lat BETWEEN b.min_y AND b.max_y GROUP BY p.pams_pin""")
def read_boundaries(t: Tables):
    box = spatial.box_polygon(*[F.col(c) for c in ("min_x", "min_y", "max_x", "max_y")])[0]
    feature = F.struct(F.struct(F.col("geoid").alias("GEOID")).alias("properties"),
                       F.struct(F.lit("Polygon").alias("type"), box.alias("coordinates")).alias("geometry"))
    path = write_documents(t, paged(t.v_block_group, "ordinal", feature), "boundaries")
    placed = spatial.locate(t.v_parcel.drop("geoid"), readers.read_boundaries(t.spark, path), ["territory_id", "pams_pin"])
    return placed.filter("geoid is not null").select("pams_pin", "geoid")


_ACS_NAMES = ("B23007_001E", "B23007_004E", "B23007_015E", "B23007_026E", "B19013_001E", "state", "county", "tract", "block group")


@query("s8_read_acs", """SELECT '34003' || lpad(geoid, 6, '0') || '1' AS geoid,
    round(CASE WHEN couples = 'N/A' THEN NULL ELSE (try_cast(both_a AS DOUBLE) + try_cast(both_b AS DOUBLE) + try_cast(both_c AS DOUBLE)) / 1000.0 END, 6)
        AS dual_income_pct,
    CASE WHEN income LIKE '-%' THEN NULL ELSE CAST(income AS DOUBLE) END AS median_hh_income FROM v_acs""")
def read_acs(t: Tables):
    cells = F.array("couples", "both_a", "both_b", "both_c", "income", F.lit("34"), F.lit("003"), F.lpad("geoid", 6, "0"), F.lit("1"))
    # One file per five block groups; every file names its columns, and the first row of a file is listed twice with a blank before.
    files = t.v_acs.groupBy(F.floor(F.col("geoid").cast("int") / 5)).agg(F.collect_list(cells).alias("rows"))
    blank = F.transform(F.get("rows", F.lit(0)), lambda x: x)
    stale = F.concat(F.array(*[F.lit("") for _ in range(5)]), F.slice(blank, 6, 4))
    table = F.concat(F.array(F.array(*[F.lit(n) for n in _ACS_NAMES])), F.array(stale), F.col("rows"))
    path = write_documents(t, files.select(F.to_json(table)), "census")
    return readers.read_acs(t.spark, path).withColumn("dual_income_pct", F.round("dual_income_pct", 6))


@query("s12_read_portal_history", """WITH n AS (SELECT pams_pin, count(*) AS permits, min(permit_number) AS first_number FROM v_portal_permit GROUP BY pams_pin)
    SELECT v.pams_pin, v.collection_status, v.assessed_total, CASE WHEN collection_status = 'collected' THEN coalesce(n.permits, 0) ELSE 0 END AS permits,
        CASE WHEN collection_status = 'collected' THEN n.first_number END AS first_number
    FROM v_portal v LEFT JOIN n ON v.pams_pin = n.pams_pin""")
def read_portal_history(t: Tables):
    permit = F.struct("permit_number", "work_type", "work_description", "status", "issue_date", "close_date", "detail_url")
    listed = t.v_portal_permit.groupBy("pams_pin").agg(F.collect_list(permit).alias("permit_applications"))
    pages = t.v_portal.join(listed, "pams_pin", "left")
    record = F.struct(
        "pams_pin", "collection_status", F.struct(F.lit("secret").alias("owner")).alias("identity"),
        F.struct(F.col("assessed_total").alias("total")).alias("assessed_valuation"),
        F.struct("last_sale_date", "last_sale_price").alias("property_details"), F.struct("permit_applications").alias("construction"))
    path = write_documents(t, paged(pages.withColumn("record", record), "k", F.col("record"), "properties"), "portal")
    # A page's first property stands on the page before as well: the reader keeps both rows, the pin tells them apart.
    read = readers.read_portal_history(t.spark, path).dropDuplicates(["pams_pin"])
    counted = readers.portal_applications(read).groupBy("pams_pin").agg(
        F.count(F.lit(1)).alias("permits"), F.min("permit_number").alias("first_number"))
    return read.join(counted, "pams_pin", "left").select(
        "pams_pin", "collection_status", F.col("assessed_valuation.total").alias("assessed_total"), F.coalesce("permits", F.lit(0)).alias("permits"), "first_number")


@query("s13_read_roof_permits", """SELECT pams_pin, municipal_id, description, disposition, CAST(issue_date AS STRING) AS issue_date, detail_url
    FROM v_roof_permit""")
def read_roof_permits(t: Tables):
    day = F.concat_ws("/", F.month("issue_date"), F.dayofmonth("issue_date"), F.year("issue_date"))
    late = F.col("ordinal") % 3 == 0  # the description only on the detail page, the number only as control number
    record = F.struct(
        F.when(~late, F.col("municipal_id")).alias("permit_number"), F.col("municipal_id").alias("control_number"), "work_type",
        F.when(late, F.lit("  ")).otherwise(F.col("description")).alias("work_description"),
        F.when(F.col("disposition") == "completed", F.lit("Closed with Date")).otherwise(F.lit("Finals Passed")).alias("status"),
        F.when(F.col("issue_date").isNotNull(), day).alias("issue_date"), "detail_url",
        F.struct(F.col("description").alias("comments")).alias("detail_page"))
    each = t.v_roof_permit.groupBy("pams_pin").agg(F.collect_list(record).alias("permits"))
    properties = each.select(F.pmod(F.xxhash64("pams_pin"), F.lit(16)).alias("page"), F.struct("pams_pin", "permits").alias("p"))
    pages = properties.groupBy("page").agg(F.collect_list("p").alias("properties")).select(F.to_json(F.struct("properties")))
    return readers.read_roof_permits(t.spark, write_documents(t, pages, "roof")).select(
        "pams_pin", "municipal_id", "description", "disposition", F.col("issue_date").cast("string").alias("issue_date"), "detail_url")


@query("s18_optional_source", """SELECT 'rental' AS source, CAST(NULL AS STRING) AS reason, count(*) AS rows FROM v_rental
    UNION ALL SELECT 'imagery', 'not collected', CAST(0 AS BIGINT)""")
def optional_source(t: Tables):
    parts = []
    for source, df in (("rental", t.v_rental), ("imagery", None)):
        rows, lost = readers.optional_source(t.spark, df, "pams_pin string", source, "not collected")
        counted = rows.agg(F.count(F.lit(1)).alias("rows")).withColumn("source", F.lit(source))
        parts.append(counted.join(lost, "source", "left").select("source", "reason", "rows"))
    return parts[0].unionByName(parts[1])


@query("s19_without_private_fields", """SELECT k, '{"k":' || CAST(k AS STRING) || ',"page":{"lot":"' || lot || '","people":[{"role":"r"},{"role":"s"}],"more":{"roof":"'
    || block || '"}}}' AS body FROM v_parcel""")
def without_private_fields(t: Tables):
    people = F.array(F.struct(F.lit("x").alias("Owner"), F.lit("r").alias("role")), F.struct(F.lit("y").alias("Owner"), F.lit("s").alias("role")))
    page = F.struct(F.col("pams_pin").alias("mailing_address"), "lot", people.alias("people"),
                    F.create_map(F.lit("Permit_Agent"), F.col("lot"), F.lit("roof"), F.col("block")).alias("more"))
    snapshot = history.without_private(t.v_parcel.select("k", page.alias("page"), F.lit("z").alias("AGENT")))
    return snapshot.select("k", F.to_json(F.struct(*[F.col(c) for c in snapshot.columns])).alias("body"))


def _rows(t: Tables, contract: str = "v2", factor: int = 1) -> tuple[DataFrame, DataFrame]:
    """Doors and evidence to publish, each with a column that no table may carry."""
    d = t.v_door_score
    plain = {"confidence": "string", "exclusion_reason": "string", "mover_eligible": "int", "days_since_move": "int", "mover_strength": "double",
             "mover_lift": "double", "rental_modifier": "int", "adjustment": "double", "base": "int", "situs": "string"}
    doors = d.withColumns({c: F.lit(None).cast(kind) for c, kind in plain.items()}).withColumn("score", F.col("score") * factor).withColumn(
        "owner_name", F.lit("secret"))
    entry = F.explode(F.array(*[F.struct(F.lit(i).cast("bigint").alias("seq"), F.lit(f"{c}_part").alias("type"), (F.col(c) * factor).cast("double").alias("points"))
                                for i, c in enumerate(("project", "capacity", "fit"))]))
    evidence = d.select("territory_id", "pams_pin", entry.alias("e")).select(
        "territory_id", "pams_pin", "e.*", F.lit("r").alias("reason"), F.lit("s").alias("source"), F.lit(None).cast("date").alias("retrieved"),
        F.lit("secret").alias("agent"))
    return doors, evidence


_ENTRIES = """SELECT pams_pin, CAST(0 AS BIGINT) AS seq, 'project_part' AS type, CAST(project AS DOUBLE) AS points, score FROM v_door_score
    UNION ALL SELECT pams_pin, 1, 'capacity_part', CAST(capacity AS DOUBLE), score FROM v_door_score
    UNION ALL SELECT pams_pin, 2, 'fit_part', CAST(fit AS DOUBLE), score FROM v_door_score"""


@query("f17_published_columns", f"""SELECT pams_pin, seq, type, points, 'r' AS reason, 's' AS source, CAST(NULL AS STRING) AS retrieved, CAST(NULL AS STRING) AS imagery
    FROM ({_ENTRIES}) AS e WHERE score IS NOT NULL""")
def published_columns(t: Tables):
    doors, evidence = _rows(t.landed())
    table = publish.evidence_table(evidence, publish.doors_table(doors.withColumn("exclusion_reason", F.lit(None).cast("string")), doors.drop("situs", "exclusion_reason")))
    return table.drop("territory_id").withColumn("retrieved", F.col("retrieved").cast("string"))


def _published(t: Tables, factor: int = 1) -> dict[str, DataFrame]:
    doors, evidence = _rows(t, factor=factor)
    shown = doors.filter("score is not null").withColumn("score_contract_version", F.lit("v2")).select("territory_id", *publish.DOOR_COLUMNS)
    return {"doors": shown, "evidence": publish.evidence_table(evidence, shown)}


@query("k8_replace_published", f"""SELECT d.pams_pin, d.score, count(*) AS entries, sum(e.points) AS points
    FROM v_door_score d JOIN ({_ENTRIES}) AS e ON d.pams_pin = e.pams_pin WHERE d.score IS NOT NULL GROUP BY d.pams_pin, d.score""")
def replace_published(t: Tables):
    """Published twice, other numbers first, and a third time in part; what is read back is the second run alone."""
    t = t.landed()
    root = folder(t, "published")
    for factor in (2, 1):
        publish.publish_run(_published(t, factor), root, f"run-{factor}")
    # A third run stops after its doors: nothing points at it.
    _published(t, 3)["doors"].write.parquet(f"{root}/runs/run-3/doors")
    doors, evidence = publish.read_run(t.spark, root).values()
    sums = evidence.groupBy("pams_pin").agg(F.count(F.lit(1)).alias("entries"), F.sum("points").alias("points"))
    return doors.join(sums, "pams_pin").select("pams_pin", "score", "entries", "points")


@query("s17_published_read_back", """SELECT territory_id, situs_key, min(pams_pin) AS pams_pin FROM (
        SELECT d.territory_id, d.pams_pin, upper(split_part(s.situs, ',', 1)) AS situs_key
        FROM v_door_score d JOIN v_situs s ON d.pams_pin = s.pams_pin WHERE d.score IS NOT NULL) AS x GROUP BY territory_id, situs_key""")
def published_read_back(t: Tables):
    """Both tables of the published run, and its address index: the first door of each address."""
    t = t.landed()
    root = folder(t, "published")
    tables = _published(t)
    situs = t.v_situs.select("pams_pin", F.col("situs").alias("situs_"))
    tables["doors"] = tables["doors"].join(situs, "pams_pin").withColumn("situs", F.col("situs_")).drop("situs_")
    publish.publish_run(tables, root, "run-1")
    doors = publish.read_run(t.spark, root)["doors"].withColumn("situs_key", F.upper(F.substring_index("situs", ",", 1)))
    return first_per_key(doors.select("territory_id", "situs_key", "pams_pin"), ["territory_id", "situs_key"], ["pams_pin"])


def permit_layout(t: Tables) -> str:
    """Permits landed by town and year."""
    root = folder(t, "permits-by-town")
    layout.land_by_town_and_year(t.landed().v_permit.select("mun", "municipal_id", "ordinal", "issue_date", "cost"), root)
    return root


@query("s4_pushed_filters", f"""SELECT municipal_id, ordinal, CAST(issue_date AS STRING) AS issue_date, cost FROM v_permit
    WHERE mun = '0203' AND issue_date >= {AS_OF_SQL} - 730""")
def pushed_filters(t: Tables):
    """One town's window out of the landed layout: its town and years are the only folders opened."""
    rows = layout.read_window(t.spark, permit_layout(t), AS_OF, 730, ["0203"])
    return rows.select("municipal_id", "ordinal", F.col("issue_date").cast("string").alias("issue_date"), "cost")


@query("s4_window_of_towns", f"""SELECT mun, count(*) AS permits, sum(ordinal) AS ordinals FROM v_permit JOIN v_town w ON mun = '02' || lpad(CAST(w.territory_id AS STRING), 2, '0')
    WHERE w.town LIKE 'Town%' AND issue_date >= {AS_OF_SQL} - 365 GROUP BY mun""")
def window_of_towns(t: Tables):
    """Towns given as a table: the scan is pruned at run time."""
    towns = t.landed().v_town.filter("town like 'Town%'").select(F.concat(F.lit("02"), F.lpad(F.col("territory_id").cast("string"), 2, "0")).alias("mun"))
    rows = layout.read_window(t.spark, permit_layout(t), AS_OF, 365, towns)
    # Ordinals have fourteen digits: those of a large town add up beyond a bigint.
    return rows.groupBy("mun").agg(F.count(F.lit(1)).alias("permits"), F.sum(F.col("ordinal").cast("decimal(38,0)")).alias("ordinals"))


#: Years asked for: the sales end before the last one, and one year's file is cut off.
_YEARS = [(f"{year}.txt", str(year)) for year in range(1994, 2002)]
_BROKEN = 1997


def yearly_sales(t: Tables) -> str:
    """Sales lines as one entry per year; the lines of one year are too short, rows without a day stand in the first year."""
    days = t.v_sale.select(F.col("ordinal").alias("o"), F.coalesce(F.year("sale_day"), F.lit(1994)).alias("year"))
    line = F.when(F.col("year") == _BROKEN, F.left("line", F.lit(100))).otherwise(F.col("line"))
    root = folder(t, "sales-by-year")
    t.v_sr1a_line.join(days, F.col("ordinal") == F.col("o")).select(F.concat(F.col("year").cast("string"), F.lit(".txt")).alias("file"), line.alias("line")).write.partitionBy(
        "file").text(root)
    return root


_YEARLY = """SELECT l.ordinal, l.line, s.deed_date, s.mun, extract(year FROM coalesce(s.sale_day, DATE '1994-01-01')) AS y FROM v_sr1a_line l JOIN v_sale s ON l.ordinal = s.ordinal"""


@query("u1_union_yearly_sales", f"""SELECT CAST(y AS STRING) || '.txt' AS entry, mun, trim(deed_date) AS deed_date, count(*) AS sales FROM ({_YEARLY}) AS x
    WHERE length(line) = 663 AND y <> {_BROKEN} GROUP BY 1, 2, 3""")
def union_yearly_sales(t: Tables):
    sales, _ = filesets.read_sales_files(t.spark, yearly_sales(t.landed()), _YEARS)
    return sales.groupBy("entry", "mun", "deed_date").agg(F.count(F.lit(1)).alias("sales"))


@query("s7_yearly_files", f"""WITH held AS (SELECT y, CASE WHEN y = {_BROKEN} THEN 0 ELSE count(*) FILTER (WHERE length(line) = 663) END AS n FROM ({_YEARLY}) AS x GROUP BY y)
    SELECT CAST(e.y AS STRING) || '.txt' AS name, CAST(e.y AS STRING) AS key, coalesce(n, 0) AS rows,
        CASE WHEN n IS NULL THEN 'no such file' WHEN n = 0 THEN 'nothing readable in it' END AS reason
    FROM (SELECT unnest(range(1994, 2002)) AS y) AS e LEFT JOIN held ON e.y = held.y""")
def yearly_files(t: Tables):
    """What was asked for, and what became of it: one year is absent, one broken, the others are kept."""
    _, found = filesets.read_sales_files(t.spark, yearly_sales(t.landed()), _YEARS)
    return found.drop("bytes")


@query("s3_read_permit_pages", """SELECT record_id, block, lot, CAST(permit_date AS STRING) AS permit_date, coalesce(cost, 0.0) AS cost FROM v_permit_raw""")
def read_permit_pages(t: Tables):
    """Pages of a permit service, one of them cut off in the middle: its rows are lost alone, and named by `file_faults`."""
    record = F.struct(F.col("record_id").alias("recordid"), "block", "lot", F.concat(F.col("permit_date").cast("string"), F.lit("T00:00:00")).alias("permitdate"),
                      F.lit("x").alias("permittype"), F.col("cost").cast("string").alias("constcost"), F.lit("secret").alias("contractor"))
    rows = t.landed().v_permit_raw.select(F.pmod(F.xxhash64("record_id"), F.lit(64)).alias("page"), record.alias("r"))
    pages = rows.withColumn("part", F.floor(F.rand(7) * 4)).groupBy("page", "part").agg(F.collect_list("r").alias("all")).select(F.to_json("all"))
    torn = t.spark.createDataFrame([('[{"recordid": "1", "blo',)], "value string")
    permits, faults = filesets.read_permit_pages(t.spark, write_documents(t, pages.unionByName(torn.toDF(*pages.columns)), "permit-pages"))
    # The torn page is the one fault there may be.
    sound = faults.agg((F.count(F.lit(1)) == 1).alias("one")).filter("one")
    return permits.join(F.broadcast(sound), F.lit(True)).select("record_id", "block", "lot", F.col("permit_date").cast("string").alias("permit_date"), "cost")


#: Ids that share a label file: a larger table has more files, not larger ones.
_LABEL_IDS = 2500


def label_files(rows: DataFrame) -> DataFrame:
    """Labels (event_id, text) as one JSON list per file."""
    filed = rows.groupBy(F.floor(F.col("event_id") / _LABEL_IDS).alias("file"))
    return filed.agg(F.concat(F.lit("["), F.array_join(F.collect_list("text"), ","), F.lit("]")).alias("value")).select("value")


@query("s16_read_labels", """SELECT CASE WHEN probe AND actual THEN 'a probe row cannot be actual' WHEN event_id % 11 = 0 THEN 'flag is not a boolean' END AS reason,
        count(*) AS rows, count(*) FILTER (WHERE actual) AS actual FROM v_label GROUP BY 1
    UNION ALL SELECT 'malformed file', 1, 0""")
def read_labels(t: Tables):
    """A folder of label files; one is no JSON, some flags are words."""
    flag = lambda name: F.when(F.col(name), F.lit("true")).otherwise(F.lit("false"))
    predicted = F.when((F.col("event_id") % 11 == 0) & ~(F.col("probe") & F.col("actual")), F.lit('"yes"')).otherwise(flag("predicted"))
    text = F.concat(F.lit('{"pams_pin": "p", "image_ref": "'), F.col("image_ref"), F.lit('", "signal": "pool", "actual": '), flag("actual"),
                    F.lit(', "predicted": '), predicted, F.lit(', "probe": '), flag("probe"), F.lit("}"))
    files = label_files(t.landed().v_label.select("event_id", text.alias("text")))
    torn = t.spark.createDataFrame([("not a label file",)], "value string")
    labels, rejects = readers.read_labels(t.spark, write_documents(t, files.unionByName(torn), "labels"))
    good = labels.agg(F.count(F.lit(1)).alias("rows"), F.count_if("actual").alias("actual")).withColumn("reason", F.lit(None).cast("string"))
    bad = rejects.groupBy("reason").agg(F.count(F.lit(1)).alias("rows"))
    seen = t.landed().v_label.filter("probe and actual").agg(F.count(F.lit(1)).alias("actual")).withColumn("reason", F.lit("a probe row cannot be actual"))
    words = t.landed().v_label.filter("event_id % 11 = 0 and not (probe and actual) and actual").agg(F.count(F.lit(1)).alias("actual")).withColumn(
        "reason", F.lit("flag is not a boolean"))
    bad = bad.join(seen.unionByName(words), "reason", "left").withColumn("actual", F.coalesce("actual", F.lit(0)))
    return good.select("reason", "rows", "actual").unionByName(bad.select("reason", "rows", "actual"))


@query("s19_undeclared_json", """SELECT k, '{"k":' || CAST(k AS STRING) || ',"page":{"lot":"' || lot || '","more":[{"roof":"' || block || '"},' || CAST(k % 5 AS STRING)
    || ',[]],"people":[{"role":"r"},{}]}}' AS body FROM v_parcel""")
def undeclared_json(t: Tables):
    """Private keys leave documents whose shape is not declared anywhere."""
    body = F.concat(
        F.lit('{"page": {"people": [{"Owner": "x", "role": "r"}, {"AGENT": {"role": [1, 2]}}], "mailing": null, "lot": "'), F.col("lot"),
        F.lit('", "more": [{"Permit_Agent": 1, "roof": "'), F.col("block"), F.lit('"}, '), (F.col("k") % 5).cast("string"),
        F.lit(', []]}, "MAILING_ADDRESS": "'), F.col("pams_pin"), F.lit('", "k": '), F.col("k").cast("string"), F.lit("}"))
    return documents.without_keys(t.landed().v_parcel.select("k", body.alias("body")), "body", ["k"])
