"""Records that share an ordinal: what is picked depends on the records, not on the order they arrive in."""

import pytest

from doorlens.operators import history, permits

DOOR = (1, "p1")
APPS = "territory_id long, pams_pin string, permit_number string, ordinal long, work_type string, work_description string, status string, " \
       "issue_date string, close_date string, detail_url string"
ROOF = "territory_id long, pams_pin string, municipal_id string, ordinal long, description string, work_type string, disposition string, " \
       "issue_date date, detail_url string"
STATE = "territory_id long, pams_pin string, municipal_id string, ordinal long, description string, issue_date date, completion_date date"
SCORER = "territory_id long, pams_pin string, permit_id string, municipal_id string, description string, from_portal boolean, ordinal long"


def both_ways(spark, rows, schema):
    return [spark.createDataFrame(r, schema).coalesce(1) for r in (rows, rows[::-1])]


def same(frames):
    one, two = (sorted(map(str, f.collect())) for f in frames)
    assert one and one == two


@pytest.mark.parametrize("kind", ["Alteration", "Amendment"])
def test_portal_projects(spark, kind):
    rows = [(*DOOR, "a", 7, kind, f"work {i}", "STALE", "1/1/2000", "", "u") for i in range(6)]
    same(map(permits.portal_projects, both_ways(spark, rows, APPS)))


def test_coalesced_permits(spark):
    none = spark.createDataFrame([], APPS)
    roof = both_ways(spark, [(*DOOR, "a", 7, f"roof {i}", "w", None, None, "u") for i in range(6)], ROOF)
    state = both_ways(spark, [(*DOOR, "b", 7, f"state {i}", None, None) for i in range(6)], STATE)
    same(permits.coalesce_permits(none, r, s) for r, s in zip(roof, state))


def test_scorer_dedupe(spark):
    rows = [(*DOOR, "7", "a", f"roof {i}", False, 7) for i in range(6)]
    same(map(permits.dedupe_permits, both_ways(spark, rows, SCORER)))


def test_roof_details(spark):
    apps = spark.createDataFrame([(*DOOR, "a", 1, "w", "d", "STALE", "1/1/2000", "", "u")], APPS)
    roof = both_ways(spark, [(*DOOR, "a", 7, f"roof {i}", "w", None, None, "u") for i in range(6)], ROOF)
    same(history.enrich_applications(apps, r).filter("source_scope = 'property_page'") for r in roof)
