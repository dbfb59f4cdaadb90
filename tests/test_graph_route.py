"""Network steps and routes on small hand-made graphs."""

import math
import random

import pytest

from doorlens.operators import graph, route

EDGES = "src long, dst long, metres double"


def edges(spark, rows):
    return spark.createDataFrame([(a, b, float(m)) for a, b, m in rows], EDGES)


def test_components_of_a_long_chain_and_a_hub(spark):
    rows = [(i, i + 1, 10) for i in range(100, 160)] + [(500, 501 + i, 5) for i in range(80)] + [(900, 901, 1)]
    random.Random(3).shuffle(rows)
    labels = {r.id: r.component for r in graph.components(edges(spark, rows)).collect()}
    assert {labels[i] for i in range(100, 161)} == {100}
    assert {labels[i] for i in range(500, 581)} == {500}
    assert labels[901] == 900
    kept = {(r.src, r.dst) for r in graph.largest_component(edges(spark, rows)).collect()}
    assert kept == {(500, 501 + i) for i in range(80)}


def test_spurs_go_until_none_is_left(spark):
    ring = [(1, 2, 40), (2, 3, 40), (3, 4, 40), (4, 1, 40)]
    # A 10 m stub; a two-step 16 m stub; a 30 m branch that stays; an island of 12 m.
    rows = ring + [(1, 10, 10), (2, 20, 8), (20, 21, 8), (3, 30, 30), (70, 71, 12)]
    left = {(r.src, r.dst) for r in graph.prune_spurs(edges(spark, rows)).collect()}
    assert left == {(1, 2), (2, 3), (3, 4), (1, 4), (3, 30)}


def test_a_junction_keeps_two_ways(spark):
    # A fork of two short stubs at the end of a street: the first goes, the other becomes the street's end.
    rows = [(1, 2, 60), (2, 3, 10), (2, 4, 12), (1, 5, 60), (5, 6, 60), (6, 1, 60)]
    left = {(r.src, r.dst) for r in graph.prune_spurs(edges(spark, rows)).collect()}
    assert left == {(1, 2), (2, 4), (1, 5), (5, 6), (1, 6)}


def dijkstra(rows, source):
    import heapq

    near = {}
    for a, b, m in rows:
        near.setdefault(a, []).append((b, m))
        near.setdefault(b, []).append((a, m))
    seen, queue = {}, [(0.0, source)]
    while queue:
        d, n = heapq.heappop(queue)
        if n in seen:
            continue
        seen[n] = d
        for other, m in near.get(n, ()):
            heapq.heappush(queue, (d + m, other))
    return seen


def test_distances_and_paths(spark):
    rnd = random.Random(9)
    rows = [(rnd.randrange(40), rnd.randrange(40), rnd.randrange(1, 30)) for _ in range(90)]
    rows = [(a, b, m) for a, b, m in rows if a != b]
    sources = spark.createDataFrame([(0,), (7,)], "source long")
    walks = graph.distances(edges(spark, rows), sources, 60.0)
    got = walks.collect()
    length = {}
    for a, b, m in rows:
        pair = (min(a, b), max(a, b))
        length[pair] = min(m, length.get(pair, math.inf))
    for source in (0, 7):
        want = {n: d for n, d in dijkstra(rows, source).items() if d <= 60}
        assert {r.node: r.metres for r in got if r.source == source} == want
    paths = {}
    for r in graph.path_rows(walks, edges(spark, rows)).collect():
        assert paths.setdefault((r.source, r.node), {}).setdefault(r.place, r.at) == r.at
    assert len(paths) == len(got)
    for r in got:
        path = [at for _, at in sorted(paths[r.source, r.node].items())]
        assert sorted(paths[r.source, r.node]) == list(range(len(path))) and path[0] == r.source and path[-1] == r.node
        assert sum(length[(min(s), max(s))] for s in zip(path, path[1:])) == r.metres


def test_long_chains_and_rings(spark):
    """Chains of nodes with two neighbours, one with the source inside, a ring with one way in, and a ring nothing reaches."""
    rows = [(i, i + 1, 1 + i % 3) for i in range(200)] + [(0, 300, 2), (300, 301, 2), (301, 0, 2)] + [(50, 400, 5), (400, 401, 5), (401, 90, 5)]
    rows += [(500 + i, 500 + (i + 1) % 9, 1) for i in range(9)] + [(600, 601, 4)]
    sources = spark.createDataFrame([(7,), (400,), (600,), (999,)], "source long")
    walks = graph.distances(edges(spark, rows), sources, 300.0)
    got = {(r.source, r.node): r.metres for r in walks.collect()}
    want = {(s, n): d for s in (7, 400, 600) for n, d in dijkstra(rows, s).items() if d <= 300} | {(999, 999): 0.0}
    assert got == want
    far = [r.at for r in graph.path_rows(walks, edges(spark, rows)).filter("source = 7 and node = 150").orderBy("place").collect()]
    assert far[0] == 7 and far[-1] == 150 and len(far) > 100
    ends = graph.chain_ends(graph.both_ways(edges(spark, rows)), spark.createDataFrame([(7,)], "id long")).collect()
    assert {(r.end, r.metres) for r in ends if r.src == 7} == {(0, 13.0), (50, 86.0)}


def greedy(doors, lon, lat, hours, cap):
    def minutes(a, b, c, d):
        p, q = math.radians(b), math.radians(d)
        h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(c - a) / 2) ** 2
        return 2 * 6371008.8 * math.asin(math.sqrt(h)) * 1.3 / (3 * 1609.344 / 60)

    left, out, spent = dict(doors), [], 0.0
    while left and len(out) < cap:
        best = None
        for pin, (score, x, y) in left.items():
            leg = minutes(lon, lat, x, y)
            if spent + leg <= hours * 60:
                key = (-(math.inf if leg == 0 else score / leg), pin)
                best = min(best, (key, pin, leg)) if best else (key, pin, leg)
        if best is None:
            break
        _, pin, leg = best
        spent += leg
        out.append(pin)
        _, lon, lat = left.pop(pin)
    return out


DOORS = "territory_id int, pams_pin string, score int, lon double, lat double"
REQUESTS = "route_id long, territory_id int, lon double, lat double, hours double, max_doors int"


@pytest.fixture(scope="module")
def town():
    rnd = random.Random(11)
    return {f"d{i:02d}": (rnd.randrange(0, 100), -74 + rnd.random() / 60, 41 + rnd.random() / 60) for i in range(60)}


def test_routes_equal_greedy_one_by_one(spark, town):
    doors = [(1, pin, s, x, y) for pin, (s, x, y) in town.items()]
    doors += [(1, "unscored", None, -74.0, 41.0), (1, "unplaced", 99, None, None)]
    first = next(iter(town.values()))
    requests = [(1, 1, -74.0, 41.0, 0.5, 4), (2, 1, -73.99, 41.01, 1.0, None), (3, 1, first[1], first[2], 0.2, 3),
                (4, 1, -70.0, 41.0, 1.0, 5), (5, 1, -74.0, 41.0, 1.0, 0)]
    stops = route.plan_routes(spark.createDataFrame(requests, REQUESTS), spark.createDataFrame(doors, DOORS)).collect()
    for rid, _, lon, lat, hours, cap in requests:
        got = [r.pams_pin for r in sorted((r for r in stops if r.route_id == rid), key=lambda r: r.stop)]
        assert got == greedy(town, lon, lat, hours, 10**9 if cap is None else cap)


def test_exclusions_of_one_route_and_of_all(spark, town):
    doors = spark.createDataFrame([(1, pin, s, x, y) for pin, (s, x, y) in town.items()], DOORS)
    requests = spark.createDataFrame([(i, 1, -74.0 + i / 500, 41.0 + i / 500, 1.0, 6) for i in range(4)], REQUESTS)
    best = sorted(town, key=lambda p: -town[p][0])[:15]
    own = spark.createDataFrame([(i, p) for i in (1, 3) for p in best] + [(1, "nobody")], "route_id long, pams_pin string")
    stops = route.plan_routes(requests, doors, exclude=own).collect()
    for i in range(4):
        left = {p: v for p, v in town.items() if i in (0, 2) or p not in best}
        got = [r.pams_pin for r in sorted((r for r in stops if r.route_id == i), key=lambda r: r.stop)]
        assert got == greedy(left, -74.0 + i / 500, 41.0 + i / 500, 1.0, 6)
    stops = route.plan_routes(requests, doors, exclude=own.select("pams_pin")).collect()
    left = {p: v for p, v in town.items() if p not in best}
    assert [r.pams_pin for r in sorted((r for r in stops if r.route_id == 0), key=lambda r: r.stop)] == greedy(left, -74.0, 41.0, 1.0, 6)


def test_a_round_looks_into_few_cells(spark):
    """4,000 doors in reach of every route: what a round examines is a small part of them, and the answer is the plain one."""
    rnd = random.Random(5)
    town = {f"d{i:04d}": (rnd.randrange(0, 101), -74 + rnd.random() / 30, 41 + rnd.random() / 30) for i in range(4000)}
    doors = spark.createDataFrame([(1, pin, s, x, y) for pin, (s, x, y) in town.items()], DOORS)
    requests = spark.createDataFrame([(i, 1, -74 + rnd.random() / 30, 41 + rnd.random() / 30, 8.0, 5) for i in range(12)], REQUESTS)
    dealt, cells = route.scored_cells(doors)
    state = requests.selectExpr("route_id", "territory_id", "lon at_lon", "lat at_lat", "0.0D elapsed", "hours * 60.0 budget", "5L cap")
    looked = route.promising_cells(state, cells, None, False).join(dealt, ["territory_id", "gx", "gy"]).count()
    assert looked < 0.1 * 12 * 4000
    stops = route.plan_routes(requests, doors).collect()
    for r in requests.collect():
        got = [s.pams_pin for s in sorted((s for s in stops if s.route_id == r.route_id), key=lambda s: s.stop)]
        assert got == greedy(town, r.lon, r.lat, 8.0, 5)


def test_stops_are_described(spark):
    doors = spark.createDataFrame([("a", "12 OAK ST, Ramsey NJ", -74.0, 41.001, "fit_pool"), ("b", "9 ELM AVE, Ramsey NJ", -74.0, 41.002, "other")],
                                  "pams_pin string, situs string, lon double, lat double, evidence_type string")
    evidence = spark.createDataFrame([(1, "a", "fit_pool", 3.0), (1, "a", "fit_lot", 5.0), (1, "b", "capacity_local_relative_value", 9.0)],
                                     "territory_id int, pams_pin string, type string, points double")
    requests = spark.createDataFrame([(1, 1, -74.0, 41.0, 1.0, 2, 100, 0.0)], REQUESTS + ", start_node long, start_frontage_m double")
    stops = spark.createDataFrame([(1, 1, "a", 50, 4.0, 4.0), (1, 2, "b", 40, 2.0, 6.0)],
                                  "route_id long, stop int, pams_pin string, score int, walk_minutes double, cumulative_minutes double")
    scripts = spark.createDataFrame([("pool", "yes", "has one", "Nice."), ("pool", "no", "none", "OK.")], "angle string, branch string, trigger string, line string")
    a, b = route.describe_stops(requests, stops, doors, evidence, "Acme", scripts).orderBy("stop").collect()
    assert (a.address, a.reason_chip, len(a.branches), a.path) == ("12 OAK ST, Ramsey NJ", "fit_lot", 2, [[-74.0, 41.0], [-74.0, 41.001]])
    assert a.talk_track.startswith("Hey, I'm with Acme") and "Oak St" in a.talk_track and a.disclosure == route.DISCLOSURE
    assert (b.reason_chip, b.branches, b.path) == (None, None, [[-74.0, 41.001], [-74.0, 41.002]])
    streets = spark.createDataFrame([(100, 101, 50.0), (101, 102, 60.0)], "src long, dst long, metres double")
    walks = graph.distances(streets, spark.createDataFrame([(100,)], "source long"), 500.0)
    access = spark.createDataFrame([("a", 102), ("b", 103)], "pams_pin string, node long")
    nodes = spark.createDataFrame([(i, float(i), 0.0) for i in (100, 101, 102)], "id long, lon double, lat double")
    a, b = route.describe_stops(requests, stops, doors, evidence, "Acme", None, access, graph.path_rows(walks, streets), nodes).orderBy("stop").collect()
    assert a.path == [[-74.0, 41.0], [100.0, 0.0], [101.0, 0.0], [102.0, 0.0], [-74.0, 41.001]] and a.disclosure == route.NETWORK_DISCLOSURE
    assert b.path == [[-74.0, 41.001], [-74.0, 41.002]] and b.branches == []


def test_network_legs_replace_straight_ones(spark):
    # The nearer door is across a river: 1,000 m round by the street.
    doors = spark.createDataFrame([(1, "near", 50, -74.0, 41.001), (1, "far", 50, -74.0, 40.998)], DOORS)
    request = spark.createDataFrame([(1, 1, -74.0, 41.0, 1.0, 1, 100, 0.0)],
                                    REQUESTS + ", start_node long, start_frontage_m double")
    access = spark.createDataFrame([("near", 101, 5.0), ("far", 102, 5.0)], "pams_pin string, node long, frontage_m double")
    walk = spark.createDataFrame([(100, 101, 1000.0), (100, 102, 220.0)], "source long, node long, metres double")
    straight = route.plan_routes(request, doors).first()
    walked = route.plan_routes(request, doors, access=access, walk=walk).first()
    assert straight.pams_pin == "near" and walked.pams_pin == "far"
    assert walked.walk_minutes == pytest.approx(225.0 / (3 * 1609.344 / 60))


def test_plausible_networks(spark):
    nodes = spark.createDataFrame([(t, i) for t in (1, 2) for i in range(12)] + [(3, 1)], "territory_id int, id int")
    access = spark.createDataFrame([(1, f"p{i}", 10.0 + i) for i in range(5)] + [(2, f"p{i}", 60.0) for i in range(5)]
                                   + [(3, "p", 1.0)], "territory_id int, pams_pin string, parcel_m double")
    got = {r.territory_id: (r.median_m, r.plausible) for r in graph.plausible(access, nodes).collect()}
    assert got == {1: (12.0, True), 2: (60.0, False), 3: (1.0, False)}
