"""Registered queries against their SQL in DuckDB on the smallest data. `ALL_QUERIES=1` runs every one."""

import os

import pytest

from doorlens.plans import registry
from doorlens.plans.analogs import TABLES

SF = "/root/testdata/sf0.001"
duckdb = pytest.importorskip("duckdb")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test data not present")

SOME = (
    "a2_permit_accounting", "a10_midrank_percentile", "a15_deciles", "a22_detection_signals", "a24_band_lift",
    "c2_normalize_address", "c3_parcel_key", "f9_roof_flags", "j2_permit_address_fallback", "j6_deed_merge",
    "j7_point_in_polygon", "j10_nearest_comparables", "j14_statewide_coalesce", "j17_integrity_violations",
    "j23_suggest_doors", "n2_prune_spurs", "n3_components", "n4_shortest_paths", "s1_read_parcels", "s12_read_portal_history", "k8_replace_published", "s5_read_sr1a", "s15_detection_contract",
    "w1_select_territory", "w4_evidence_sequence", "x1_resolve_doors", "x3_score_doors", "x12_identity_scan",
    "x16_plan_routes",
)


@pytest.fixture(scope="module")
def con():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"create view {table} as select * from '{SF}/{table}.parquet'")
    return connection


def names():
    return sorted(registry.all_queries()) if os.environ.get("ALL_QUERIES") else SOME


@pytest.mark.parametrize("name", names())
def test_query(spark, con, name):
    from tools.compare import compare

    status, got, want, _, note = compare(spark, con, SF, name, registry.all_queries()[name], registry.all_sql().get(name))
    assert status in ("ok", "rows"), f"{status}: {got} rows against {want} {note}"


def test_every_query_has_sql():
    assert set(registry.all_queries()) == set(registry.all_sql())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 150


def test_pages_of_block_9999(spark, con, tmp_path):
    """Customer 79998 stands in block 9999, the block once written on pages that were to be wrong."""
    from tools.compare import compare

    rows = spark.read.parquet(f"{SF}/customer.parquet")
    moved = rows.withColumn("c_custkey", rows.c_custkey + 79_998)
    moved.coalesce(1).write.parquet(str(tmp_path / "customer.parquet"))
    spark.read.parquet(f"{SF}/nation.parquet").coalesce(1).write.parquet(str(tmp_path / "nation.parquet"))
    for table in ("customer", "nation"):
        con.execute(f"create or replace view {table} as select * from '{tmp_path}/{table}.parquet/*.parquet'")
    name = "j17_integrity_violations"
    status, got, want, _, note = compare(spark, con, str(tmp_path), name, registry.all_queries()[name], registry.all_sql()[name])
    for table in ("customer", "nation"):
        con.execute(f"create or replace view {table} as select * from '{SF}/{table}.parquet'")
    assert status == "ok", f"{got} rows against {want} {note}"


def test_ordinals_beyond_a_bigint(spark, con, tmp_path):
    """Two ordinals of this size already add up to more than a bigint holds."""
    import shutil

    from tools.compare import compare

    for table, key in (("orders", "o_orderkey"), ("lineitem", "l_orderkey")):
        rows = spark.read.parquet(f"{SF}/{table}.parquet")
        rows.withColumn(key, rows[key] + 800_000_000_000).coalesce(1).write.parquet(str(tmp_path / f"{table}.parquet"))
        con.execute(f"create or replace view {table} as select * from '{tmp_path}/{table}.parquet/*.parquet'")
    for table in ("customer", "nation", "part"):
        shutil.copy(f"{SF}/{table}.parquet", tmp_path / f"{table}.parquet")
    name = "s4_window_of_towns"
    try:
        status, got, want, _, note = compare(spark, con, str(tmp_path), name, registry.all_queries()[name], registry.all_sql()[name])
    finally:
        for table in ("orders", "lineitem"):
            con.execute(f"create or replace view {table} as select * from '{SF}/{table}.parquet'")
    assert status == "ok", f"{got} rows against {want} {note}"
