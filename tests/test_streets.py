"""Street segments against parcels, by brute force over all pairs."""

import math
import random

import pytest
from pyspark.sql import functions as F

from doorlens.functions import keys
from doorlens.operators import streets
from doorlens.plans import registry

SEGMENTS = "id long, area long, x1 double, y1 double, x2 double, y2 double"


def meets(p, q):
    def turn(ax, ay, bx, by, cx, cy):
        return (bx - ax) * (cy - ay) - (by - ay) * (cx - ax)

    if max(p[0], p[2]) < min(q[0], q[2]) or max(q[0], q[2]) < min(p[0], p[2]) or max(p[1], p[3]) < min(q[1], q[3]) or max(q[1], q[3]) < min(p[1], p[3]):
        return False
    return turn(*p, *q[:2]) * turn(*p, *q[2:]) <= 0 and turn(*q, *p[:2]) * turn(*q, *p[2:]) <= 0


def gap(x, y, q):
    vx, vy = q[2] - q[0], q[3] - q[1]
    size = vx * vx + vy * vy
    t = min(max(((x - q[0]) * vx + (y - q[1]) * vy) / size, 0), 1) if size else 0
    return math.hypot(x - q[0] - t * vx, y - q[1] - t * vy)


def holds(rings, x, y):
    cuts = 0
    for ring in rings:
        for (ax, ay), (bx, by) in zip(ring, ring[1:]):
            cuts += (ax > x) != (bx > x) and y < ay + (by - ay) * (x - ax) / (bx - ax)
    return cuts % 2 == 1


def star(rng, cx, cy, size, corners):
    """A ring around a middle, its corners at whole multiples of 1/8."""
    at = [2 * math.pi * i / corners for i in range(corners)]
    ring = [[round(8 * (cx + size * rng.uniform(0.4, 1) * f(a))) / 8 for f in (math.cos, math.sin)] for a in at]
    return [*ring, ring[0]]


def test_crossing_and_clearance_equal_brute_force(spark):
    rng = random.Random(8)
    lots = [(a, [[star(rng, rng.uniform(0, 400), rng.uniform(0, 400), rng.choice([3, 8, 20]), rng.randrange(3, 9))]]) for a in (1, 2) for _ in range(60)]
    # A block with a yard inside it, a street in the yard, and one polygon given twice.
    lots.append((1, [[[[500.0, 500.0], [700.0, 500.0], [700.0, 700.0], [500.0, 700.0], [500.0, 500.0]],
                      [[540.0, 540.0], [660.0, 540.0], [660.0, 660.0], [540.0, 660.0], [540.0, 540.0]]]]))
    lots += [lots[0], (1, None), (2, [])]
    rows = [(i, 1 + i % 2, *[round(8 * rng.uniform(0, 420)) / 8 for _ in range(2)]) for i in range(900)]
    rows = [(i, a, x, y, x + round(8 * rng.uniform(-45, 45)) / 8, y + round(8 * rng.uniform(-45, 45)) / 8) for i, a, x, y in rows]
    rows += [(900, 1, 590.0, 590.0, 610.0, 600.0), (901, 1, 510.0, 510.0, 520.0, 520.0), (902, 1, 530.0, 600.0, 570.0, 600.0), (903, 3, 0.0, 0.0, 1.0, 1.0),
             (904, 1, 480.0, 500.0, 500.0, 500.0), (905, 1, 545.0, 545.0, 545.0, 545.0), (906, 1, 0.0, 0.0, 61.0, 0.0)]
    parcels = spark.createDataFrame(lots, "area long, polygon array<array<array<array<double>>>>")
    got = streets.segments_among_parcels(spark.createDataFrame(rows, SEGMENTS), parcels, ["area"]).collect()
    shapes = {a: [rings for b, polygons in lots if b == a for rings in polygons or []] for a in (1, 2, 3)}
    want = {}
    for i, a, *s in rows:
        if math.hypot(s[2] - s[0], s[3] - s[1]) > 60:
            continue
        x, y = (s[0] + s[2]) / 2, (s[1] + s[3]) / 2
        edges = [(*p, *q) for rings in shapes[a] for ring in rings for p, q in zip(ring, ring[1:])]
        inside = any(holds(rings, x, y) for rings in shapes[a])
        near = 0.0 if inside else min((gap(x, y, e) for e in edges), default=math.inf)
        want[i] = (inside or any(meets(s, e) for e in edges), round(near, 6) if near <= 30 else None)
    found = {r.id: (r.crosses, None if r.clearance_m is None else round(r.clearance_m, 6)) for r in got}
    assert found == want
    assert found[900] == (False, None) and found[901][0] and found[902][0] and found[903] == (False, None) and found[904][0] and not found[905][0]
    assert sum(c for c, _ in want.values()) > 60 and sum(not c and m is not None for c, m in want.values()) > 100


def test_edges_keep_the_shortest_of_a_pair(spark):
    lots = [(1, [[[[0.0, 5.0], [40.0, 5.0], [40.0, 9.0], [0.0, 9.0], [0.0, 5.0]]]])]
    rows = [(1, 1, 0.0, 0.0, 20.0, 0.0), (2, 1, 20.1, 0.1, 0.0, 0.0), (3, 1, 20.0, 0.0, 20.0, 6.0), (4, 1, 0.0, -40.0, 10.0, -40.0), (5, 1, 0.1, 0.0, 0.0, 0.1)]
    parcels = spark.createDataFrame(lots, "area long, polygon array<array<array<array<double>>>>")
    got = streets.street_edges(spark.createDataFrame(rows, SEGMENTS), parcels, ["area"]).collect()
    assert [(r.area, tuple(r.src), tuple(r.dst), r.metres) for r in got] == [(1, (0, 0), (40, 0), 20.0)]


def test_street_before_a_unit(spark):
    given = ["7 OAK STREET #2, X", "7 Court Street  #2 , X", "7 OAK ST. #2, X", "7 #2, X", "7 OAK AVENUE, X", "7 OAK STREET #2"]
    rows = spark.createDataFrame([(i, s) for i, s in enumerate(given)], "i int, s string").orderBy("i")
    got = rows.select(keys.map_street(F.col("s")).alias("a"), keys.map_street(F.col("s"), True).alias("b")).collect()
    assert [r.a for r in got] == ["OAK STREET #2", "COURT STREET #2", "OAK ST. #2", "#2", "OAK AVE", None]
    assert [r.b for r in got] == ["OAK ST #2", "COURT ST #2", "OAK ST. #2", "#2", "OAK AVE", None]


def test_listed_streets_with_units_equal_the_sql(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    spark.range(25000).selectExpr("id AS c_custkey", "1.5D AS c_acctbal", "'BUILDING' AS c_mktsegment", "CAST(id % 25 AS INT) AS c_nationkey").coalesce(1) \
        .write.parquet(f"{tmp_path}/customer.parquet")
    spark.range(25).selectExpr("CAST(id AS INT) AS n_nationkey", "CAST(id % 5 AS INT) AS n_regionkey").coalesce(1).write.parquet(f"{tmp_path}/nation.parquet")
    con = duckdb.connect()
    for table in ("customer", "nation"):
        con.execute(f"create view {table} as select * from '{tmp_path}/{table}.parquet/*.parquet'")
    want = con.execute(registry.all_sql()["a32_doors_per_street"]).fetchall()
    got = registry.all_queries()["a32_doors_per_street"](spark, str(tmp_path)).select("territory_id", "street", "doors").collect()
    assert sorted(map(tuple, got)) == sorted(want) and any("#2" in street for _, street, _ in want)
