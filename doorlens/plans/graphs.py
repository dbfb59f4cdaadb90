"""The walk network (N) and nearest nodes (J25)."""

from __future__ import annotations

from pyspark.sql import functions as F

from doorlens.functions import geo
from doorlens.operators import graph, spatial, streets
from doorlens.plans.analogs import Tables
from doorlens.plans.registry import query


def nodes(t: Tables):
    t = t.landed()
    return t.v_node.select(F.col("area").alias("territory_id"), "id", "lon", "lat")


def starts(t: Tables):
    t = t.landed()
    return t.v_route_request.select("territory_id", "route_id", "lon", "lat")


def sources(t: Tables):
    return graph.nearest_nodes(starts(t), nodes(t), "route_id").select(F.col("node").alias("source"))


# A box is met if the boxes overlap and its corners do not all lie on one side of the segment's line.
_TURNS = "[" + ", ".join(f"(x2 - x1) * ({y} - y1) - (y2 - y1) * ({x} - x1)" for x in ("min_x", "max_x") for y in ("min_y", "max_y")) + "]"
_AMONG = f"""pairs AS (SELECT s.id, s.area, least(x1, x2) <= max_x AND greatest(x1, x2) >= min_x AND least(y1, y2) <= max_y AND greatest(y1, y2) >= min_y
            AND list_min({_TURNS}) <= 0 AND list_max({_TURNS}) >= 0 AS meets,
        sqrt(power(greatest(min_x - (x1 + x2) / 2, (x1 + x2) / 2 - max_x, 0.0), 2) + power(greatest(min_y - (y1 + y2) / 2, (y1 + y2) / 2 - max_y, 0.0), 2)) AS gap
        FROM v_segment s JOIN v_lot l ON s.area = l.area AND (x1 + x2) / 2 BETWEEN min_x - 60 AND max_x + 60 AND (y1 + y2) / 2 BETWEEN min_y - 60 AND max_y + 60),
    among AS (SELECT id, area, bool_or(meets) AS crosses, min(gap) AS clearance_m FROM pairs GROUP BY id, area)"""


def lots(t: Tables):
    return t.v_lot.select("area", spatial.box_polygon(*[F.col(c) for c in ("min_x", "min_y", "max_x", "max_y")]).alias("polygon"))


@query("n1_segments_among_parcels", f"""WITH {_AMONG} SELECT s.id, s.area, coalesce(crosses, false) AS crosses,
        CASE WHEN clearance_m <= 30.0 THEN round(clearance_m, 6) END AS clearance_m
    FROM v_segment s LEFT JOIN among a ON s.id = a.id AND s.area = a.area WHERE power(x2 - x1, 2) + power(y2 - y1, 2) <= 3600.0""")
def segments_among_parcels(t: Tables):
    return streets.segments_among_parcels(t.v_segment, lots(t), ["area"]).select("id", "area", "crosses", F.round("clearance_m", 6).alias("clearance_m"))


@query("n1_street_edges", f"""WITH {_AMONG}, s AS (SELECT CAST(round_even(x1 / 0.5, 0) AS BIGINT) AS ax, CAST(round_even(y1 / 0.5, 0) AS BIGINT) AS ay,
        CAST(round_even(x2 / 0.5, 0) AS BIGINT) AS bx, CAST(round_even(y2 / 0.5, 0) AS BIGINT) AS by_, s.area,
        sqrt(power(x2 - x1, 2) + power(y2 - y1, 2)) AS m FROM v_segment s JOIN among a ON s.id = a.id AND s.area = a.area WHERE clearance_m <= 30.0 AND NOT crosses),
    o AS (SELECT CASE WHEN (ax, ay) < (bx, by_) THEN ax ELSE bx END AS sx, CASE WHEN (ax, ay) < (bx, by_) THEN ay ELSE by_ END AS sy,
                 CASE WHEN (ax, ay) < (bx, by_) THEN bx ELSE ax END AS dx, CASE WHEN (ax, ay) < (bx, by_) THEN by_ ELSE ay END AS dy, m, area
          FROM s WHERE m <= 60.0 AND NOT (ax = bx AND ay = by_))
    SELECT area, sx, sy, dx, dy, round(min(m), 6) AS metres FROM o GROUP BY area, sx, sy, dx, dy""")
def street_edges(t: Tables):
    return streets.street_edges(t.v_segment, lots(t), ["area"]).select(
        "area", F.col("src.x").alias("sx"), F.col("src.y").alias("sy"), F.col("dst.x").alias("dx"), F.col("dst.y").alias("dy"),
        F.round("metres", 6).alias("metres"),
    )


_LABELS = """WITH RECURSIVE links AS (SELECT src AS a, dst AS b FROM v_edge UNION SELECT dst, src FROM v_edge),
    labels(id, component) USING KEY (id) AS (
        SELECT DISTINCT a, a FROM links
        UNION
        SELECT l.id, min(n.component) FROM recurring.labels l JOIN links k ON k.a = l.id JOIN labels n ON n.id = k.b
        WHERE n.component < l.component GROUP BY l.id)"""


@query("n3_components", f"{_LABELS} SELECT id, component FROM labels")
def components(t: Tables):
    return graph.components(t.v_edge)


@query("n3_largest_component", f"""{_LABELS}, sizes AS (SELECT component, count(*) AS n FROM labels GROUP BY component),
    best AS (SELECT component FROM sizes ORDER BY n DESC, component LIMIT 1)
    SELECT e.src, e.dst, min(e.metres) AS metres FROM v_edge e JOIN labels l ON e.src = l.id JOIN best b ON l.component = b.component
    GROUP BY e.src, e.dst""")
def largest_component(t: Tables):
    return graph.largest_component(t.v_edge).groupBy("src", "dst").agg(F.min("metres").alias("metres"))


_DIST = """sqrt(power((n.lon - r.lon) * 0.017453292519943295 * cos((n.lat + r.lat) / 2.0 * 0.017453292519943295), 2)
    + power((n.lat - r.lat) * 0.017453292519943295, 2)) * 6371000.0"""
_SOURCES = f"""near_node AS (SELECT route_id, first(n.id ORDER BY {_DIST}, n.id) AS source, min({_DIST}) AS m
    FROM v_route_request r JOIN v_node n ON n.area = r.territory_id GROUP BY route_id)"""


@query("j25_nearest_node", f"WITH {_SOURCES} SELECT route_id, source AS node, round(m, 4) AS distance_m FROM near_node")
def nearest_node(t: Tables):
    return graph.nearest_nodes(starts(t), nodes(t), "route_id").select(
        "route_id", "node", F.round("distance_m", 4).alias("distance_m")
    )


_WALKS = f"""WITH RECURSIVE links AS (SELECT src AS a, dst AS b, metres FROM v_edge UNION ALL SELECT dst, src, metres FROM v_edge),
    {_SOURCES},
    walks(source, node, metres) AS (
        SELECT DISTINCT source, source, CAST(0 AS DOUBLE) FROM near_node
        UNION
        SELECT w.source, k.b, w.metres + k.metres FROM walks w JOIN links k ON w.node = k.a WHERE w.metres + k.metres <= 250.0)"""


@query("n4_shortest_paths", f"{_WALKS} SELECT source, node, min(metres) AS metres FROM walks GROUP BY source, node")
def shortest_paths(t: Tables):
    return graph.distances(t.v_edge, sources(t), 250.0)


def parcels(t: Tables):
    corner = [F.col(c) for c in ("min_x", "min_y", "max_x", "max_y")]
    return t.landed().v_parcel_box.select("territory_id", "pams_pin", "lon", "lat", spatial.box_polygon(*corner).alias("polygon"))


# Metres from a node to a parcel's box, on a flat map whose scale is taken at the parcel's middle.
_BOX_GAP = """sqrt(power(greatest(p.min_x - n.lon, n.lon - p.max_x, 0.0) * 111320.0 * cos(p.lat * 0.017453292519943295), 2)
    + power(greatest(p.min_y - n.lat, n.lat - p.max_y, 0.0) * 110540.0, 2))"""
_ACCESS = f"""access AS (SELECT p.territory_id, p.pams_pin, p.lon, p.lat, first(n.id ORDER BY round({_BOX_GAP}, 6), n.id) AS node, min({_BOX_GAP}) AS parcel_m
    FROM v_parcel_box p JOIN v_node n ON n.area = p.territory_id GROUP BY p.territory_id, p.pams_pin, p.lon, p.lat)"""


def access(t: Tables):
    """Each parcel's node, the one nearest the lot itself, with the walk from the door's point to it."""
    found = graph.nearest_nodes_of_parcels(parcels(t), nodes(t))
    placed = found.join(nodes(t).select("territory_id", F.col("id").alias("node"), F.col("lon").alias("n_lon"), F.col("lat").alias("n_lat")), ["territory_id", "node"])
    placed = placed.join(parcels(t).drop("polygon"), ["territory_id", "pams_pin"])
    frontage = geo.equirectangular_m(F.col("lon"), F.col("lat"), F.col("n_lon"), F.col("n_lat"))
    return placed.select("territory_id", "pams_pin", "lon", "lat", "node", "parcel_m", frontage.alias("frontage_m"))


@query("j25_parcel_access", f"WITH {_ACCESS} SELECT territory_id, pams_pin, node, round(parcel_m, 6) AS parcel_m FROM access")
def parcel_access(t: Tables):
    return graph.nearest_nodes_of_parcels(parcels(t), nodes(t)).select("territory_id", "pams_pin", "node", F.round("parcel_m", 6).alias("parcel_m"))


_FLAT = """sqrt(power(({b}.lon - {a}.lon) * 0.017453292519943295 * cos(({b}.lat + {a}.lat) / 2.0 * 0.017453292519943295), 2)
    + power(({b}.lat - {a}.lat) * 0.017453292519943295, 2)) * 6371000.0"""
_LEG, _FRONT, _OWN = _FLAT.format(a="r", b="p"), _FLAT.format(a="p", b="n"), _FLAT.format(a="r", b="o_n")


@query("n5_network_legs", f"""{_WALKS}, {_ACCESS}, short AS (SELECT source, node, min(metres) AS metres FROM walks GROUP BY source, node)
    SELECT r.route_id, p.pams_pin, s.metres IS NOT NULL AS joined,
        round(CASE WHEN s.metres IS NULL THEN 1.3 * {_LEG} ELSE {_OWN} + s.metres + {_FRONT} END, 3) AS leg_m
    FROM v_route_request r JOIN near_node o ON r.route_id = o.route_id JOIN v_node o_n ON o_n.id = o.source AND o_n.area = r.territory_id
    JOIN access p ON p.territory_id = r.territory_id AND {_LEG} <= 900.0 JOIN v_node n ON n.id = p.node AND n.area = p.territory_id
    LEFT JOIN short s ON s.source = o.source AND s.node = p.node""")
def network_legs(t: Tables):
    """Frontage of the origin, the way along the streets, frontage of the door."""
    walk = graph.distances(t.v_edge, sources(t), 250.0)
    origins = graph.nearest_nodes(starts(t), nodes(t), "route_id").select(
        F.col("route_id").alias("origin"), F.col("node").alias("o_node"), F.col("distance_m").alias("o_frontage_m"))
    flat = geo.equirectangular_m(F.col("c_lon"), F.col("c_lat"), F.col("lon"), F.col("lat"))
    pairs = spatial.within_reach(starts(t).withColumn("reach_m", F.lit(950.0)), access(t)).withColumn("flat", flat).filter("flat <= 900.0").select(
        F.col("route_id").alias("origin"), "pams_pin", "node", "frontage_m", (F.col("flat") * geo.DETOUR).alias("straight_m"))
    return graph.network_legs(origins, pairs, walk).select(
        F.col("origin").alias("route_id"), "pams_pin", F.col("along_m").isNotNull().alias("joined"), F.round("leg_m", 3).alias("leg_m"))


@query("n7_plausibility", f"""WITH {_ACCESS}, r AS (SELECT territory_id, round(parcel_m, 6) AS m, row_number() OVER (PARTITION BY territory_id ORDER BY round(parcel_m, 6)) AS i,
        count(*) OVER (PARTITION BY territory_id) AS c FROM access),
    counted AS (SELECT area AS territory_id, count(*) AS nodes FROM v_node GROUP BY area)
    SELECT territory_id, nodes, m AS median_m, nodes >= 12 AND coalesce(m <= 25.0, false) AS plausible
    FROM counted LEFT JOIN (SELECT * FROM r WHERE i = floor(c / 2) + 1) AS middle USING (territory_id)""")
def plausibility(t: Tables):
    found = graph.nearest_nodes_of_parcels(parcels(t), nodes(t)).withColumn("parcel_m", F.round("parcel_m", 6))
    return graph.plausible(found, nodes(t))


@query("n6_walk_paths", f"""{_WALKS}, short AS (SELECT source, node, min(metres) AS metres FROM walks GROUP BY source, node),
    back AS (SELECT v.source, v.node, min(u.node) AS before FROM short v JOIN links k ON k.b = v.node JOIN short u ON u.source = v.source AND u.node = k.a
             WHERE u.metres < v.metres AND u.metres + k.metres = v.metres GROUP BY v.source, v.node),
    steps(source, node, at_node, behind) AS (
        SELECT source, node, node, 0 FROM short
        UNION ALL
        SELECT s.source, s.node, b.before, s.behind + 1 FROM steps s JOIN back b ON b.source = s.source AND b.node = s.at_node)
    SELECT source, node, CAST(max(behind) OVER (PARTITION BY source, node) - behind AS INT) AS place, at_node FROM steps""")
def walk_paths(t: Tables):
    """Every step of every walk: its nodes in order, the smaller id where two ways are equally long."""
    return graph.path_rows(graph.distances(t.v_edge, sources(t), 250.0), t.v_edge).withColumnRenamed("at", "at_node")


# Here every edge is at least 6 m and every street edge at least 21 m, so a short branch is one edge; longer ones are in the tests.
@query("n2_prune_spurs", """WITH RECURSIVE prune(round, src, dst, metres) AS (
        SELECT 0, least(src, dst), greatest(src, dst), min(metres) FROM v_edge WHERE src <> dst GROUP BY least(src, dst), greatest(src, dst)
        UNION ALL
        SELECT round + 1, src, dst, metres FROM (
            WITH ends AS (SELECT src AS a, dst AS b, metres FROM prune UNION ALL SELECT dst, src, metres FROM prune),
                degrees AS (SELECT a, count(*) AS n FROM ends GROUP BY a),
                stubs AS (SELECT e.a AS leaf, e.b AS far, f.n AS degree, row_number() OVER (PARTITION BY e.b ORDER BY e.a) AS rn
                          FROM ends e JOIN degrees l ON e.a = l.a AND l.n = 1 JOIN degrees f ON e.b = f.a WHERE e.metres < 25.0 AND f.n <> 2),
                gone AS (SELECT leaf AS id FROM stubs WHERE degree = 1 OR rn <= degree - 2 UNION SELECT far FROM stubs WHERE degree = 1)
            SELECT p.* FROM prune p WHERE EXISTS (SELECT 1 FROM gone)
                AND NOT EXISTS (SELECT 1 FROM gone g WHERE g.id = p.src) AND NOT EXISTS (SELECT 1 FROM gone g WHERE g.id = p.dst)) AS next_)
    SELECT src, dst, metres FROM prune WHERE round = (SELECT max(round) FROM prune)""")
def prune_spurs(t: Tables):
    return graph.prune_spurs(t.v_edge)
