"""Readers over small landed files in the public formats."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from doorlens.functions import dates, keys, text
from doorlens.sources import readers

BOX = [[[-74.0, 41.0], [-73.9, 41.0], [-73.9, 41.1], [-74.0, 41.1], [-74.0, 41.0]]]


def write(path, payload):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(payload if isinstance(payload, str) else json.dumps(payload), encoding="utf-8")
    return str(path)


def feature(oid, **props):
    return {"type": "Feature", "properties": {"OBJECTID": oid, **props}, "geometry": props.pop("_g", {"type": "Polygon", "coordinates": BOX})}


def test_parcels(spark, tmp_path):
    one = feature(1, PAMS_PIN="0248_1_2", PCL_MUN="0248", PCLBLOCK=" 1", PCLLOT="2", PCLQCODE=" C01 ", PROP_CLASS="2",
                  NET_VALUE=500000, CALC_ACRE="0.25", DEED_DATE=" 260701 ", YR_CONSTR=None, SALE_PRICE="", OWNER_NAME="X")
    two = feature(2, PAMS_PIN="0248_1_3", PROP_CLASS="15C", NET_VALUE="n/a", DEED_DATE="  ")
    two["geometry"] = {"type": "MultiPolygon", "coordinates": [BOX]}
    three = feature(3, PAMS_PIN="0248_1_4")
    three["geometry"] = None
    write(tmp_path / "p" / "1.json", {"type": "FeatureCollection", "features": [one, two]})
    write(tmp_path / "p" / "2.json", {"type": "FeatureCollection", "features": [two, three]})
    df = readers.read_parcels(spark, str(tmp_path / "p"))
    assert not any("owner" in c.lower() for c in df.columns)
    rows = {r.pams_pin: r for r in df.collect()}
    assert len(rows) == 3 and df.count() == 3
    a, b, c = rows["0248_1_2"], rows["0248_1_3"], rows["0248_1_4"]
    assert (a.block, a.qualifier, a.deed_date, a.yr_constr, a.sale_price, a.net_value) == (" 1", "C01", "260701", 0, 0.0, 500000.0)
    assert (round(a.lon, 9), round(a.lat, 9)) == (-73.95, 41.05) == (round(b.lon, 9), round(b.lat, 9))
    assert b.net_value == 0.0 and b.deed_date is None and c.lon is None and c.prop_loc == ""


def test_permits(spark, tmp_path):
    rows = [{"recordid": "r1", "block": "1", "lot": "2", "permitdate": "2026-01-02T00:00:00.000", "permittypedesc": " New ",
             "permittype": "N", "constcost": "1200", "contractor": "Somebody"},
            {"recordid": "r2", "permitdate": "soon", "permittypedesc": " ", "permittype": " ALT ", "constcost": "free"}]
    got = {r.record_id: r for r in readers.read_permits(spark, write(tmp_path / "x" / "p.json", rows)).collect()}
    assert "contractor" not in got["r1"].asDict()
    assert (got["r1"].permit_date, got["r1"].type, got["r1"].cost) == (dt.date(2026, 1, 2), "New", 1200.0)
    assert (got["r2"].permit_date, got["r2"].type, got["r2"].cost, got["r2"].block) == (None, "ALT", 0.0, "")


def sales_line(**fields):
    line = [" "] * readers.SALES_WIDTH
    for name, value in fields.items():
        start, end = readers.SALES_SLICES[name]
        line[start:end] = f"{value:<{end - start}}"
    line[110:297] = "OWNER NAME AND STREET".ljust(187)
    return "".join(line)


def test_sales(spark, tmp_path):
    good = sales_line(county="02", district="48", deed_date="260701", block="00022", block_suffix="01", lot="00000",
                      reported_price="000000001", verified_price="000000000", year_built="1950", prop_loc="CAFÉ LANE")
    other = sales_line(county="01", district="01", deed_date="260701")
    path = tmp_path / "s" / "2026.txt"
    path.parent.mkdir()
    path.write_bytes(("\r\n".join([good, other, good[:-1], ""])).encode("latin-1"))
    every = readers.read_sales(spark, [str(path)])
    assert every.count() == 2
    row = readers.read_sales(spark, [str(path)], muns=["0248"]).first()
    assert (row.mun, row.block, row.lot, row.sale_price, row.year_built) == ("0248", "22.01", "0", 1.0, 1950)
    assert row.prop_loc == "CAFÉ LANE"
    assert "OWNER" not in str(row)
    assert readers.sales_years(dt.date(2026, 1, 10), 90) == [2026, 2025]
    assert readers.sales_paths("d", dt.date(2026, 1, 10), 90) == [(2026, "d/2026-ytd.txt"), (2025, "d/2025.txt")]


def test_census_table(spark, tmp_path):
    names = ["B19013_001E", "B23007_001E", "B23007_004E", "B23007_015E", "B23007_026E", "state", "county", "tract", "block group"]
    table = [names, ["90000", "100", "20", "10", "5", "34", "003", "0001", "1"],
             ["-666666666", "100", "20", "10", "", "34", "003", "0001", "2"], ["too", "short"],
             ["1", "0", "1", "1", "1", "34", "003", "0001", "3"], ["91000", "100", "40", "0", "0", "34", "003", "0001", "1"]]
    got = {r.geoid: r for r in readers.read_acs(spark, write(tmp_path / "a" / "acs.json", table)).collect()}
    assert set(got) == {"3400300011", "3400300012", "3400300013"}
    assert (got["3400300011"].dual_income_pct, got["3400300011"].median_hh_income) == (0.4, 91000.0)
    assert got["3400300012"].dual_income_pct is None and got["3400300012"].median_hh_income is None
    assert got["3400300013"].dual_income_pct is None


def test_boundaries(spark, tmp_path):
    rows = [feature(1, GEOID="b"), feature(2, GEOID=None), feature(3, GEOID="a")]
    bad = feature(4, GEOID="empty")
    bad["geometry"] = {"type": "Polygon", "coordinates": []}
    path = write(tmp_path / "b" / "1.json", {"features": [*rows, bad]})
    got = readers.read_boundaries(spark, path).orderBy("ordinal").collect()
    assert [r.geoid for r in got] == ["b", "a"]


def test_portal_history_and_roof(spark, tmp_path):
    pages = {"properties": [
        {"pams_pin": "p1", "collection_status": "collected", "owner": {"name": "X"}, "construction": {"permit_applications": [
            {"permit_number": "", "control_number": "C1", "work_type": "Alteration", "status": "Closed with Date",
             "issue_date": "4/20/2023", "close_date": "5/1/2023", "permit_agent": "Y"}], "inspections": [], "violations": []}},
        {"pams_pin": "p2", "collection_status": "failed"}]}
    history = readers.read_portal_history(spark, write(tmp_path / "h" / "h.json", pages))
    assert "owner" not in str(history.schema) and "agent" not in str(history.schema)
    from doorlens.operators.permits import portal_projects

    apps = readers.portal_applications(history.withColumn("territory_id", F.lit(1)))
    row = portal_projects(apps).first()
    assert (row.municipal_id, row.disposition, row.issue_date, row.completion_date) == (
        "C1", "completed", dt.date(2023, 4, 20), dt.date(2023, 5, 1))
    doors = spark.createDataFrame([("p1",), ("p2",), ("p3",)], "pams_pin string")
    state = {r.pams_pin: r.sdl_page_available for r in readers.with_page_state(doors, history).collect()}
    assert state == {"p1": True, "p2": False, "p3": False}
    assert all(r.sdl_page_available for r in readers.with_page_state(doors, None).collect())
    assert readers.read_portal_history(spark, None) is None

    roof = {"properties": [{"pams_pin": "p1", "permits": [
        {"permit_number": "R1", "work_description": " ", "detail_page": {"comments": "RE-ROOF"}, "status": "CA and Close Date Issued",
         "issue_date": "01/02/2010"}, {"permit_number": "", "control_number": ""}]}]}
    got = readers.read_roof_permits(spark, write(tmp_path / "r" / "r.json", roof)).collect()
    assert [(r.municipal_id, r.description, r.disposition, r.issue_date) for r in got] == [
        ("R1", "RE-ROOF", "completed", dt.date(2010, 1, 2))]


def test_labels(spark, tmp_path):
    base = {"pams_pin": "p", "image_ref": "i", "signal": "pool"}
    write(tmp_path / "l" / "a.json", [{**base, "actual": True, "predicted": False}, {**base, "actual": True, "predicted": True, "probe": True}])
    write(tmp_path / "l" / "b.json", [{**base, "actual": "yes", "predicted": True}, {**base, "actual": False, "predicted": True, "probe": True}])
    write(tmp_path / "l" / "c.json", "{not json")
    labels, rejects = readers.read_labels(spark, str(tmp_path / "l"))
    assert sorted((r.actual, r.predicted, r.probe) for r in labels.collect()) == [(False, True, True), (True, False, False)]
    assert sorted((r.file, r.reason) for r in rejects.collect()) == [
        ("a.json", "a probe row cannot be actual"), ("b.json", "flag is not a boolean"), ("c.json", "malformed file")]


def test_optional_and_required_sources(spark):
    rows, lost = readers.optional_source(spark, None, "geoid string", "acs", "no key")
    assert rows.count() == 0 and rows.columns == ["geoid"]
    assert [tuple(r) for r in lost.collect()] == [("acs", "no key")]
    same, none = readers.optional_source(spark, rows, "geoid string", "acs", "no key")
    assert same is rows and none.count() == 0
    with pytest.raises(ValueError):
        readers.required_source(None, "parcels")


def test_stale_published_tables_are_refused(spark, tmp_path):
    doors = spark.createDataFrame([("p", "v2"), ("q", "v1")], "pams_pin string, score_contract_version string")
    doors.write.parquet(str(tmp_path / "doors"))
    doors.filter("pams_pin = 'p'").write.parquet(str(tmp_path / "fresh"))
    with pytest.raises(ValueError):
        readers.read_published(spark, str(tmp_path / "doors"), str(tmp_path / "doors"))
    assert readers.read_published(spark, str(tmp_path / "fresh"), str(tmp_path / "doors"))[0].count() == 1


# --- rules on odd values ---------------------------------------------------------------------


def column(spark, rule, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.x for r in df.select("i", rule(F.col("v")).alias("x")).orderBy("i").collect()]


def test_key_components(spark):
    given = ["0248", " 0 0 7 ", "15.0", "15.50", "15.", "4.02", "4.2", "0", "000", "", None, "00.5", ".5", "12a", "0A1"]
    assert column(spark, keys.key_component, given) == [
        "248", "7", "15", "15.5", "15", "4.02", "4.2", "0", "0", "", "", "0.5", "0.5", "12A", "A1"]


def test_address_keys(spark):
    given = ["12 Oak St., Apt 3B", "12 OAK STREET", " 12  oak st ", "5 Court Street #2", "9 UNIT RD", "", None, "7 Main"]
    assert column(spark, keys.address_key, given) == [
        "12 OAK ST", "12 OAK ST", "12 OAK ST", "5 COURT ST", "9", "", "", "7 MAIN"]
    portal = ["12 Oak St - Bank", "Bank - 12 Oak St", "12-14 North Main Turnpike, Ramsey NJ 07446", "3 OAK ST RAMSEY"]
    assert column(spark, keys.portal_address_key, portal) == [
        "12 OAK ST", "BANK 12 OAK ST", "12 14 N MAIN TPK", "3 OAK ST"]
    assert column(spark, keys.spoken_street, ["1 FAWN HILL RD, Ramsey NJ", "O'NEIL LN", "5-7 5TH AVE", "", None]) == [
        "Fawn Hill Rd", "O'Neil Ln", "5Th Ave", "this block", "this block"]
    assert column(spark, keys.map_street, ["68 SNYDER AVENUE, Ramsey NJ", "SNYDER", "1-3  Elm  Street , X"]) == [
        "SNYDER AVE", None, "ELM ST"]


def test_dates(spark):
    as_of = dt.date(2026, 8, 18)
    got = column(spark, lambda c: dates.deed_date(c, as_of), ["260701", "270101", "280101", " 991332", "2026-02-30", "2026-02-28", "x", None])
    assert got == [dt.date(2026, 7, 1), dt.date(2027, 1, 1), dt.date(1928, 1, 1), None, None, dt.date(2026, 2, 28), None, None]
    assert column(spark, dates.us_date, ["3/1/2026", "13/1/2026", " 03/01/2026 ", "", None]) == [
        dt.date(2026, 3, 1), None, dt.date(2026, 3, 1), None, None]
    leap = spark.range(1).select(
        dates.whole_years(F.lit("2020-02-29").cast("date"), F.lit("2023-02-28").cast("date")).alias("a"),
        dates.years_back(F.lit("2024-02-29").cast("date"), 1).alias("b")).first()
    assert (leap.a, leap.b) == (2, dt.date(2023, 2, 28))


def test_money_and_status(spark):
    assert column(spark, text.money, ["$600,000", "30910", "$", "", None, "about -5.50 or so"]) == [
        600000.0, 30910.0, None, None, None, -5.5]
    assert column(spark, text.portal_disposition, ["CO/CCO and Close Date Issued", "Closed with Date", "Certificate (TCO) Issued",
                                                   "STALE", "Permit Denied", "", None]) == [
        "completed", "completed", None, "expired", "denied", None, None]


def test_rows_without_key_stay_and_first_page_wins(spark):
    rows = [("a", 0, "1", "x"), ("a", 1, None, "y"), ("b", 0, "1", "late"), ("b", 1, None, "z"), ("b", 2, None, "z")]
    got = readers.union_pages(spark.createDataFrame(rows, "page string, ordinal int, OBJECTID string, v string"))
    assert sorted((r.OBJECTID or "", r.v) for r in got.collect()) == [("", "y"), ("", "z"), ("", "z"), ("1", "x")]


def test_a_broken_page_stops_the_job_or_is_named(spark, tmp_path):
    folder = tmp_path / "pages"
    folder.mkdir()
    page = {"features": [{"properties": {"PAMS_PIN": "p", "PCLBLOCK": "1", "PCLLOT": "2"}, "geometry": None}]}
    (folder / "1.json").write_text(json.dumps(page))
    (folder / "2.json").write_text('{"features": [{"properties": {"PAMS_PIN"')
    with pytest.raises(Exception):
        readers.read_parcels(spark, str(folder)).collect()
    assert [r.pams_pin for r in readers.read_parcels(spark, str(folder), strict=False).collect()] == ["p"]
    assert [tuple(r) for r in readers.file_faults(spark, str(folder)).collect()] == [("2.json", "malformed file")]
