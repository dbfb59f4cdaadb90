"""Landed files: pruned layout, ledgers of incomplete sets, publishing by pointer."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from doorlens.operators import publish, spatial
from doorlens.sources import filesets, layout, readers

PERMITS = "mun string, id long, issue_date date"


def permits(spark):
    rows = [(f"02{m:02d}", 100 * m + y, dt.date(2020 + y % 6, 1 + y % 12, 5)) for m in range(8) for y in range(60)] + [("0201", 9999, None)]
    return rows, spark.createDataFrame(rows, PERMITS)


def test_a_window_opens_its_folders_only(spark, tmp_path):
    rows, df = permits(spark)
    layout.land_by_town_and_year(df, str(tmp_path / "p"))
    as_of = dt.date(2025, 6, 1)
    window = layout.read_window(spark, str(tmp_path / "p"), as_of, 400, ["0203", "0205"])
    first = as_of - dt.timedelta(days=400)
    assert {r.id for r in window.collect()} == {i for m, i, d in rows if m in ("0203", "0205") and d and d >= first}
    plan = window._jdf.queryExecution().executedPlan().toString()
    scan = next(line for line in plan.splitlines() if "PartitionFilters" in line)
    filters = scan.split("PartitionFilters: [")[1].split("]")[0]
    assert "mun" in filters and "year" in filters
    assert "GreaterThanOrEqual(issue_date" in scan.split("PushedFilters: [")[1]
    # Whatever stands in other folders is never opened.
    opened = [f"mun={m}/year={y}" for m in ("0203", "0205") for y in (2024, 2025)]
    for path in (tmp_path / "p").rglob("*.parquet"):
        if not any(part in str(path) for part in opened):
            path.write_bytes(b"no parquet")
    assert {r.id for r in window.collect()} == {i for m, i, d in rows if m in ("0203", "0205") and d and d >= first}


def test_a_table_of_towns_prunes_at_run_time(spark, tmp_path):
    rows, df = permits(spark)
    layout.land_by_town_and_year(df, str(tmp_path / "p"))
    spark.createDataFrame([("0203", "chosen"), ("0204", "not")], "mun string, why string").write.parquet(str(tmp_path / "towns"))
    towns = spark.read.parquet(str(tmp_path / "towns")).filter("why = 'chosen'")
    window = layout.read_window(spark, str(tmp_path / "p"), dt.date(2025, 6, 1), 400, towns)
    assert "dynamicpruning" in window._jdf.queryExecution().executedPlan().toString()
    assert {r.id for r in window.collect()} == {i for m, i, d in rows if m == "0203" and d and d >= dt.date(2024, 4, 27)}


def test_incomplete_yearly_files(spark, tmp_path):
    line = "0248" + " " * 30 + "   " + "000500000" + "000000000" + "X" * 283 + "250103" + "250110" + "00012    00003    " + "Y" * 295
    assert len(line) == readers.SALES_WIDTH
    (tmp_path / "2026-ytd.txt").write_bytes((line + "\n" + line.replace("0248", "0250", 1) + "\n").encode("latin-1"))
    (tmp_path / "2025.txt").write_bytes(b"<html>not the file</html>\n")
    (tmp_path / "2019.txt").write_bytes((line + "\n").encode())
    names = filesets.sales_entries(dt.date(2026, 2, 1), 90) + [("2024.txt", "2024")]
    sales, found = filesets.read_sales_files(spark, str(tmp_path), names, muns=["0248"])
    assert [(r.entry, r.mun) for r in sales.collect()] == [("2026-ytd.txt", "0248")]
    assert sorted((r.name, r.key, r.rows, r.reason) for r in found.collect()) == [
        ("2024.txt", "2024", 0, filesets.MISSING), ("2025.txt", "2025", 0, filesets.UNREADABLE), ("2026-ytd.txt", "2026", 2, None)]


def test_a_torn_page_is_named(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"recordid": "1", "permitdate": "2025-01-02T00:00", "constcost": "x", "contractor": "c"}]')
    (tmp_path / "b.json").write_text('[{"recordid": "2"')
    rows, faults = filesets.read_permit_pages(spark, str(tmp_path))
    assert [(r.record_id, r.permit_date, r.cost) for r in rows.collect()] == [("1", dt.date(2025, 1, 2), 0.0)]
    assert [(r.source, r.reason) for r in faults.collect()] == [("b.json", "malformed file")]


def _run(spark, score, version="v2"):
    doors = spark.createDataFrame([(1, "p", score, version)], "territory_id int, pams_pin string, score int, score_contract_version string")
    return {"doors": doors, "evidence": spark.createDataFrame([(1, "p", float(score))], "territory_id int, pams_pin string, points double")}


def test_a_run_is_seen_whole_or_not_at_all(spark, tmp_path):
    root = str(tmp_path / "out")
    with pytest.raises(ValueError, match="nothing is published"):
        publish.read_run(spark, root)
    publish.publish_run(_run(spark, 5), root, "a")
    held = publish.read_run(spark, root)
    publish.publish_run(_run(spark, 7), root, "b")
    # Stopped between its tables: the doors are written, the evidence is not.
    broken = _run(spark, 9)
    broken["evidence"] = broken["evidence"].withColumn("points", F.raise_error(F.lit("lost")).cast("double"))
    with pytest.raises(Exception, match="lost"):
        publish.publish_run(broken, root, "c")
    assert [r.score for r in publish.read_run(spark, root)["doors"].collect()] == [7]
    assert [r.points for r in publish.read_run(spark, root)["evidence"].collect()] == [7.0]
    assert [r.score for r in held["doors"].collect()] == [5]  # a reader of the run before is not disturbed
    publish.publish_run(_run(spark, 9), root, "c")
    assert [r.score for r in publish.read_run(spark, root)["doors"].collect()] == [9]
    publish.publish_run(_run(spark, 1, "v1"), root, "d")
    with pytest.raises(ValueError, match="another score contract"):
        publish.read_run(spark, root)
    with pytest.raises(ValueError, match="lacks"):
        publish.publish_run({"doors": _run(spark, 1)["doors"]}, root, "e") or publish.read_run(spark, root)


def test_a_large_target_in_one_hot_territory(spark):
    """Ties at one spot, a target in the middle of them, a third of all parcels in one territory: as a plain sort."""
    rows = [(1, f"p{(i * 7919) % 3000:05d}", "2", -74.0 + (0.0 if 900 <= i < 2100 else i * 1e-5), 41.0) for i in range(3000)]
    rows += [(2 + i % 3, f"q{i:04d}", "2", -74.0 + i * 1e-4, 41.01) for i in range(300)] + [(1, "x", "4A", -74.0, 41.0), (1, "y", "2", None, 41.0)]
    anchors = [(1, -74.0, 41.0, 1500), (2, -74.0, 41.0, 5), (3, -74.0, 41.0, 0), (4, -74.0, 41.0, 10_000)]
    df = spark.createDataFrame(rows, "territory_id int, pams_pin string, prop_class string, lon double, lat double")
    got = spatial.select_territory(df, spark.createDataFrame(anchors, "territory_id int, anchor_lon double, anchor_lat double, target int"))
    ranked = {t: [r.pams_pin for r in sorted((r for r in got.collect() if r.territory_id == t), key=lambda r: r.territory_rank)] for t in (1, 2, 3, 4)}
    spot = sorted(p for t, p, c, lon, _ in rows if t == 1 and c == "2" and lon == -74.0)
    assert ranked[1][:1201] == spot and len(ranked[1]) == 1500 and len(set(ranked[1])) == 1500
    assert len(ranked[2]) == 5 and ranked[3] == [] and len(ranked[4]) == 100
