"""Nearest neighbours and containment against plain comparison, on shapes that would break a naive grid."""

import math
import random

import pytest
from pyspark.sql import functions as F

from doorlens.functions import geo
from doorlens.operators import graph, spatial
from doorlens.operators.ordering import count_below, medians, quantiles, top_per_key


def brute(points, k):
    out = {}
    for g, pin, lon, lat in points:
        near = []
        for g2, other, lon2, lat2 in points:
            if g2 != g or other == pin:
                continue
            mean = math.radians((lat + lat2) / 2)
            dx, dy = math.radians(lon2 - lon) * math.cos(mean), math.radians(lat2 - lat)
            near.append((math.sqrt(dx * dx + dy * dy) * 6371000.0, other))
        out[(g, pin)] = [p for _, p in sorted(near)[:k]]
    return out


def layouts():
    rnd = random.Random(7)
    one_spot = [("a", f"s{i:03d}", -74.0, 41.0) for i in range(120)] + [
        ("a", f"t{i:03d}", -74.0 + rnd.random() / 50, 41.0 + rnd.random() / 50) for i in range(40)]
    town_and_farms = [("b", f"d{i:03d}", -74.0 + rnd.random() / 5000, 41.0 + rnd.random() / 5000) for i in range(200)] + [
        ("b", f"f{i:02d}", -74.0 + rnd.random() * 2, 41.0 + rnd.random() * 2) for i in range(15)]
    few = [("c", f"x{i}", -74.0 + i / 1024, 41.0) for i in range(4)] + [("d", "alone", -74.0, 41.0)]
    north = [("e", f"n{i:03d}", 20 + rnd.random() * 3, 69.0 + rnd.random()) for i in range(150)]
    # A third of a wide territory inside a few millimetres, all at different spots.
    packed = [("f", f"q{i:03d}", -74.0 + rnd.random() * 1e-7, 41.0 + rnd.random() * 1e-7) for i in range(260)] + [
        ("f", f"r{i:03d}", -75.0 + rnd.random() * 4, 40.0 + rnd.random() * 4) for i in range(80)] + [
        ("f", f"e{i}", -74.0 - 1e-6 * i, 41.0) for i in range(1, 9)]
    return one_spot + town_and_farms + few + north + packed


@pytest.fixture(scope="module")
def points(spark):
    rows = layouts()
    return rows, spark.createDataFrame(rows, "territory_id string, pams_pin string, lon double, lat double")


@pytest.mark.parametrize("k", [1, 5, 20])
def test_nearest_equals_full_comparison(points, k):
    rows, df = points
    got = {}
    for r in spatial.nearest_neighbours(df.repartition(5), df.orderBy(F.rand(3)), k).collect():
        got.setdefault((r.territory_id, r.pams_pin), {})[r["rank"]] = r.neighbour
    want = brute(rows, k)
    for key, expected in want.items():
        ranked = [got.get(key, {})[i] for i in sorted(got.get(key, {}))]
        assert len(ranked) == len(expected)
        assert ranked == expected, key


def test_candidates_of_another_kind(spark):
    places = spark.createDataFrame([("t", 1, -74.0, 41.0), ("t", 2, -73.9, 41.0)], "territory_id string, id long, lon double, lat double")
    asked = spark.createDataFrame([("t", "far", -80.0, 45.0), ("t", "near", -73.91, 41.0)],
                                  "territory_id string, pams_pin string, lon double, lat double")
    found = {r.pams_pin: r.node for r in graph.nearest_nodes(asked, places, "pams_pin").collect()}
    assert found == {"far": 1, "near": 2}


def polygon(*rings):
    return [[[list(map(float, p)) for p in ring] for ring in rings]]


SQUARE = [(0, 0), (4, 0), (4, 4), (0, 4), (0, 0)]
HOLE = [(1, 1), (3, 1), (3, 3), (1, 3), (1, 1)]
L_SHAPE = [(0, 0), (6, 0), (6, 1), (1, 1), (1, 6), (0, 6), (0, 0)]
PTYPE = "array<array<array<array<double>>>>"


def test_containment_edges_holes_and_order(spark):
    shapes = spark.createDataFrame(
        [("second", 1, polygon(SQUARE, HOLE)), ("first", 0, polygon([(4, 0), (8, 0), (8, 4), (4, 4), (4, 0)])),
         ("big", 2, polygon([(-50, -50), (50, -50), (50, 50), (-50, 50), (-50, -50)]))],
        f"geoid string, ordinal long, polygon {PTYPE}")
    asked = [("in", 0.5, 0.5, "second"), ("hole", 2.0, 2.0, "big"), ("hole edge", 1.0, 2.0, "second"),
             ("shared edge", 4.0, 2.0, "first"), ("corner", 0.0, 0.0, "second"), ("vertex level", 2.0, 1.0, "second"),
             ("outside", 60.0, 0.0, None), ("nowhere", None, None, None)]
    points = spark.createDataFrame([(n, x, y) for n, x, y, _ in asked], "pams_pin string, lon double, lat double")
    found = {r.pams_pin: r.geoid for r in spatial.locate(points, shapes, ["pams_pin"]).collect()}
    assert found == {n: g for n, _, _, g in asked}


def test_area_centroid(spark):
    def centre(p):
        row = spark.createDataFrame([(p,)], f"p {PTYPE}").select(geo.area_centroid(F.col("p")).alias("c")).first()
        return None if row.c is None else (round(row.c.lon, 9), round(row.c.lat, 9))

    assert centre(polygon(SQUARE)) == (2.0, 2.0)
    assert centre(polygon(SQUARE[::-1])) == (2.0, 2.0)
    off_centre_hole = [(2, 2), (4, 2), (4, 4), (2, 4), (2, 2)]
    assert centre(polygon(SQUARE, off_centre_hole)) == (round(20 / 12, 9), round(20 / 12, 9))
    two = [polygon(SQUARE)[0], polygon([(10, 0), (12, 0), (12, 2), (10, 2), (10, 0)])[0]]
    assert centre(two) == (round((16 * 2 + 4 * 11) / 20, 9), round((16 * 2 + 4 * 1) / 20, 9))
    assert centre(polygon([(0, 0), (1, 1), (0, 0)])) is None


def test_within_reach(spark):
    rnd = random.Random(5)
    points = [("t", f"p{i}", -74 + rnd.random() / 20, 41 + rnd.random() / 20) for i in range(300)]
    centres = [("t", i, -74 + rnd.random() / 20, 41 + rnd.random() / 20, r) for i, r in enumerate([10.0, 300.0, 900.0, 5000.0])]
    got = {(r.c, r.pams_pin) for r in spatial.within_reach(
        spark.createDataFrame(centres, "territory_id string, c int, lon double, lat double, reach_m double"),
        spark.createDataFrame(points, "territory_id string, pams_pin string, lon double, lat double")).collect()}

    def metres(a, b, c, d):
        p, q = math.radians(b), math.radians(d)
        h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(c - a) / 2) ** 2
        return 2 * 6371008.8 * math.asin(math.sqrt(h))

    want = {(c, p) for _, c, x, y, r in centres for _, p, u, v in points if metres(x, y, u, v) <= r}
    assert got == want


def test_node_nearest_the_parcel_not_its_middle(spark):
    step = 0.0001
    shape = [[[[x * step - 74, y * step + 41] for x, y in L_SHAPE]]]
    parcels = spark.createDataFrame([("t", "p", -74 + step, 41 + step, shape)],
                                    f"territory_id string, pams_pin string, lon double, lat double, polygon {PTYPE}")
    nodes = spark.createDataFrame([("t", 1, -74 + 2.2 * step, 41 + 2.2 * step), ("t", 2, -74 + 6.2 * step, 41 + 0.5 * step)],
                                  "territory_id string, id long, lon double, lat double")
    assert graph.nearest_nodes(parcels, nodes, "pams_pin").first().node == 1
    best = graph.nearest_nodes_of_parcels(parcels, nodes).first()
    assert best.node == 2 and best.parcel_m == pytest.approx(0.2 * step * 111320 * math.cos(math.radians(41)), rel=0.01)


# --- ordering ------------------------------------------------------------------------------


def test_positions_with_one_hot_key(spark):
    rnd = random.Random(1)
    rows = [("hot" if i % 3 == 0 else f"k{i % 50}", i * 7919 % 100003) for i in range(3000)]
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, o long").withColumns(
        {"high": F.shiftright("o", 10), "mid": F.shiftright("o", 5), "one": F.lit(1)})
    got = {(r.k, r.o): r.below for r in count_below(df, ["k"], ["high", "mid", "o"], "one").collect()}
    want = {}
    for key in {k for k, _ in rows}:
        for i, o in enumerate(sorted(o for k, o in rows if k == key)):
            want[(key, o)] = i
    assert got == want


def test_quantiles_and_medians_are_exact(spark):
    import statistics

    rnd = random.Random(2)
    values = [("a", round(rnd.lognormvariate(12, 1), 2)) for _ in range(501)] + [("b", float(v)) for v in (-5, -5, 0, 3)]
    df = spark.createDataFrame(values, "g string, v double")
    got = {r.g: r for r in quantiles(df, ["g"], "v", {"q1": 0.1, "q5": 0.5, "q9": 0.9}).collect()}
    a = [v for g, v in values if g == "a"]
    cuts = statistics.quantiles(a, n=10, method="inclusive")
    assert (got["a"].q1, got["a"].q5, got["a"].q9) == pytest.approx((cuts[0], cuts[4], cuts[8]))
    assert {r.g: r["median"] for r in medians(df, ["g"], "v").collect()}["b"] == -2.5


def test_top_per_key_with_a_limit_per_key(spark):
    rows = [("x", i, 3) for i in range(500)] + [("y", i, 2000) for i in range(40)] + [("z", 1, 0)]
    df = spark.createDataFrame(rows, "g string, v long, n int")
    got = top_per_key(df, ["g"], [F.col("v").desc()], "n", "v").collect()
    assert sorted((r.g, r.v) for r in got if r.g == "x") == [("x", 497), ("x", 498), ("x", 499)]
    assert sum(r.g == "y" for r in got) == 40 and not any(r.g == "z" for r in got)


def test_territory_selection_ignores_input_order(spark):
    rnd = random.Random(4)
    rows = [(1, f"p{i:03d}", "2", -74 + rnd.random() / 10, 41 + rnd.random() / 10) for i in range(200)]
    anchor = spark.createDataFrame([(1, -73.95, 41.05, 50)], "territory_id int, anchor_lon double, anchor_lat double, target int")
    answers = set()
    for seed in (1, 2):
        df = spark.createDataFrame(rows, "territory_id int, pams_pin string, prop_class string, lon double, lat double")
        got = spatial.select_territory(df.orderBy(F.rand(seed)).repartition(3), anchor).collect()
        answers.add(tuple(r.pams_pin for r in sorted(got, key=lambda r: r.territory_rank)))
    assert len(answers) == 1 and len(answers.pop()) == 50


def test_lone_subjects_beside_a_crowd_read_few_places(spark, monkeypatch):
    """Lone places next to a dense town descend to small cells; answers equal a full comparison."""
    rnd = random.Random(11)
    rows = [("g", f"d{i:04d}", -74.0 + rnd.gauss(0, 1e-3), 41.0 + rnd.gauss(0, 1e-3)) for i in range(900)] + [
        ("g", f"l{i:02d}", -74.5 + rnd.random(), 40.5 + rnd.random()) for i in range(25)]
    df = spark.createDataFrame(rows, "territory_id string, pams_pin string, lon double, lat double")
    seen = []
    descend = spatial._descend
    monkeypatch.setattr(spatial, "_descend", lambda subjects, *rest: seen.append(subjects.count()) or descend(subjects, *rest))
    got = {}
    for r in spatial.nearest_neighbours(df, df, 3, crowd=2).orderBy("rank").collect():
        got.setdefault((r.territory_id, r.pams_pin), []).append(r.neighbour)
    assert got == brute(rows, 3)
    assert seen and 10 <= seen[0] < 900
