"""How often rows are dealt anew: plans are read with broadcasts off, as on tables too large to send."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from doorlens.operators import route, spatial
from doorlens.plans import registry
from doorlens.plans.analogs import SPARK_VIEWS, VIEWS, Tables, with_views
from doorlens.scoring import facts
from doorlens.session import hot_joins_split

SF = "/root/testdata/sf0.001"
data = pytest.mark.skipif(not os.path.isdir(SF), reason="test data not present")
AS_PLANNED = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}


@pytest.fixture
def planned(spark):
    before = {name: spark.conf.get(name) for name in AS_PLANNED}
    for name, value in AS_PLANNED.items():
        spark.conf.set(name, value)
    yield spark
    for name, value in before.items():
        spark.conf.set(name, value)


def dealings(df, of):
    """The shuffles on the way from the leaf whose text holds `of` to the result."""
    def down(node, passed):
        passed += node.nodeName() == "Exchange"
        children = node.children()
        if children.isEmpty():
            return [passed] if of in node.toString() else []
        return [n for i in range(children.size()) for n in down(children.apply(i), passed)]

    return max(down(df._jdf.queryExecution().executedPlan(), 0), default=0)


@data
@pytest.mark.parametrize("name", SPARK_VIEWS)
def test_view_for_spark_has_the_same_rows(spark, name):
    t = Tables(spark, SF)
    given = with_views(f"SELECT * FROM {name}")
    sources = ", ".join(f"{x} AS (SELECT * FROM parquet.`{SF}/{x}.parquet`)" for x in ("customer", "nation", "orders", "lineitem", "part"))
    want, got = spark.sql(f"WITH {sources}, {given[5:]}"), t.view(name)
    assert got.schema == want.schema and VIEWS[name] != SPARK_VIEWS[name]
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty() and not got.isEmpty()


@data
def test_lines_are_dealt_twice(planned):
    assert dealings(Tables(planned, SF).v_permit, "l_orderkey") == 2


@data
def test_report_derives_permits_once(spark):
    assert "lineitem" not in registry.all_queries()["x11_score_report"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()


def test_classified_permits_are_dealt_once(planned):
    """One dealing by door serves the doors' clock and the grouping by municipal id; the columns read of a record are all that is kept."""
    lines = planned.range(20).selectExpr(
        "1L AS territory_id", "concat('p', id % 3) AS pams_pin", "cast(id AS string) AS permit_id", "concat('m', id % 7) AS municipal_id",
        "concat('roof ', id) AS description", "cast(null AS string) AS work_type", "'completed' AS disposition", "DATE '2000-01-01' AS issue_date",
        "DATE '2000-02-01' AS completion_date", "cast(null AS date) AS last_activity_date", "id % 2 = 0 AS from_portal", "id % 2 = 1 AS from_statewide",
        "id AS ordinal")
    clock = planned.createDataFrame([(1, "p0"), (1, "p1"), (1, "p9")], "territory_id long, pams_pin string").withColumn(
        "as_of", F.lit("2001-06-30").cast("date"))
    found = facts.classify_permits(lines, clock, fields=facts.PERMIT_FIELDS).select(*facts.CLASSIFIED)
    assert dealings(found, "Range") == 1
    whole = facts.classify_permits(lines, None, dt.date(2001, 6, 30)).filter("pams_pin != 'p2'").select(*facts.CLASSIFIED)
    assert sorted(map(str, found.collect())) == sorted(map(str, whole.collect())) and found.count() == 14


def test_neighbours_carry_what_is_read_of_them(spark):
    """The value comes with the neighbour: nothing is looked up by pin, and the answer is not dealt anew by coordinates."""
    homes = spark.range(60).selectExpr("id % 2 AS territory_id", "concat('h', id) AS pams_pin", "'2' AS prop_class", "id * 10.0D AS net_value",
                                       "-74.0D + id % 7 / 100D AS lon", "41.0D + id % 5 / 100D AS lat")
    near = spatial.nearest_comparables(homes, 3)
    assert "net_value" not in near._jdf.queryExecution().optimizedPlan().toString()
    value = {r.pams_pin: r.net_value for r in homes.collect()}
    rows = near.collect()
    assert len(rows) == 180 and all(r.value == value[r.comp_pin] for r in rows)


def test_hot_joins_are_split_only_inside(spark):
    name = "spark.sql.adaptive.forceOptimizeSkewedJoin"
    before = spark.conf.get(name)
    with pytest.raises(ZeroDivisionError), hot_joins_split(spark):
        assert spark.conf.get(name) == "true"
        1 / 0
    assert spark.conf.get(name) == before


@data
def test_feature_entries_are_dealt_once_after_permits(planned):
    """Two dealings make the permits, one brings a door's entries together."""
    assert dealings(registry.all_queries()["k2_door_features"](planned, SF), "l_orderkey") == 3


@pytest.fixture
def sending(planned):
    """Small sides are sent, and a plan shows whole paths."""
    planned.conf.set("spark.sql.autoBroadcastJoinThreshold", "10m")
    planned.conf.set("spark.sql.maxMetadataStringLength", "2000")
    yield planned
    planned.conf.unset("spark.sql.maxMetadataStringLength")


def sent_from(df, of):
    """Whether the plan broadcasts rows of the file whose path holds `of`, not counting what is summed up before."""
    def down(node, inside):
        inside = (inside or node.nodeName() == "BroadcastExchange") and "Aggregate" not in node.nodeName()
        children = node.children()
        if children.isEmpty():
            return inside and of in node.toString()
        return any(down(children.apply(i), inside) for i in range(children.size()))

    return down(df._jdf.queryExecution().executedPlan(), False)


def test_a_round_of_routes_sends_neither_doors_nor_cells(sending, monkeypatch, tmp_path):
    """Doors are under the broadcast limit here, so they would be sent in every round if Spark took what a round brings for larger."""
    doors = sending.range(5000).selectExpr("id % 2 AS territory_id", "concat('d', id) AS pams_pin", "id % 101 AS score",
                                          "-74.0D + id % 23 / 10000D AS lon", "41.0D + id % 29 / 10000D AS lat")
    requests = sending.createDataFrame([(1, 0, -74.0, 41.0, 1.0, 2), (2, 1, -73.999, 41.001, 1.0, 2)],
                                       "route_id long, territory_id long, lon double, lat double, hours double, max_doors int")
    requests.write.parquet(str(tmp_path / "requests"))
    plans = []
    for name in ("land", "cut_lineage"):
        if write := getattr(route, name, None):
            monkeypatch.setattr(route, name, lambda df, *to, write=write: plans.append(df) or write(df, *to))
    stops = route.plan_routes(sending.read.parquet(str(tmp_path / "requests")), doors)
    assert sorted((r.route_id, r.stop) for r in stops.collect()) == [(i, n) for i in (1, 2) for n in (1, 2)]
    assert len(plans) > 3
    assert [name for df in plans for name in ("route-doors", "route-cells") if sent_from(df, name)] == []
