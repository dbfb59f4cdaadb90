"""The walk network as an edge table: filtering, pruning, components, distances and access.

All origins, components and branches advance together, one join a round. Each round's
state is written to the checkpoint folder, so later rounds do not replay earlier ones and
a lost executor costs one round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doorlens.functions import geo
from doorlens.operators.ordering import ranked_histogram
from doorlens.operators.spatial import nearest_neighbours, within_reach
from doorlens.session import cut_lineage

# Fixed values.
MAX_EDGE_M = 60.0
MAX_CLEARANCE_M = 30.0
SNAP_M = 0.5
SPUR_MIN_M = 25.0
MIN_NODES = 12
MAX_MEDIAN_M = 25.0


def street_edges(segments: DataFrame, keys=()) -> DataFrame:
    """Candidate segments (x1, y1, x2, y2 in metres, clearance_m, crosses) to the shortest edge per node pair.

    Node ids are half-metre grid positions, rounded half to even.
    """
    def snap(x, y):
        return F.struct(F.bround(F.col(x) / SNAP_M).cast("bigint").alias("x"), F.bround(F.col(y) / SNAP_M).cast("bigint").alias("y"))

    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    rows = segments.withColumn("metres", F.sqrt(dx * dx + dy * dy)).filter(
        (F.col("metres") <= MAX_EDGE_M) & (F.col("clearance_m") <= MAX_CLEARANCE_M) & ~F.col("crosses")
    ).withColumn("a", snap("x1", "y1")).withColumn("b", snap("x2", "y2")).filter("a != b")
    return rows.groupBy(*keys, F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).agg(
        F.min("metres").alias("metres")
    )


def both_ways(edges: DataFrame) -> DataFrame:
    """Every edge in both directions, the shortest per pair, no loops."""
    once = edges.filter("src != dst").select(
        F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), "metres"
    ).groupBy("a", "b").agg(F.min("metres").alias("metres"))
    return once.select(
        F.explode(F.array(F.struct(F.col("a").alias("src"), F.col("b").alias("dst")),
                          F.struct(F.col("b").alias("src"), F.col("a").alias("dst")))).alias("e"), "metres"
    ).select("e.src", "e.dst", "metres")


def components(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """(id, component): the smallest id each node is joined to.

    Alternates two star steps: neighbours above a node are re-hung on its smallest neighbour,
    then each node's smaller neighbours are. The minimum per node is a combinable aggregate, so a
    node with very many edges is not gathered anywhere. Stops when the edge set no longer changes.
    """
    pairs = cut_lineage(
        edges.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).filter("u != v").distinct()
    )
    nodes = edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    before = None
    for _ in range(max_rounds):
        mirrored = pairs.select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("v").alias("v")),
                                                  F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.*")
        low = mirrored.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = mirrored.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u != v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(
            F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")),
                              F.struct(F.col("u").alias("u"), F.col("m").alias("v")))).alias("e")
        ).select("e.*").filter("u != v").distinct()
        pairs = cut_lineage(small)
        state = pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return nodes.join(pairs.withColumnRenamed("u", "id"), "id", "left").select(
        "id", F.coalesce("v", "id").alias("component")
    )


def largest_component(edges: DataFrame) -> DataFrame:
    """The edges of the component with the most nodes; the smaller label wins a tie."""
    labels = cut_lineage(components(edges))
    best = labels.groupBy("component").agg(F.count(F.lit(1)).alias("n")).agg(
        F.max_by("component", F.struct("n", -F.col("component"))).alias("component")
    )
    kept = labels.join(F.broadcast(best), "component", "left_semi").select("id")  # one row
    return edges.join(kept.withColumnRenamed("id", "src"), "src", "left_semi")


def prune_spurs(edges: DataFrame, shorter_than: float = SPUR_MIN_M, max_rounds: int = 1000) -> DataFrame:
    """Drops dead-end branches below a length, again and again until none is left.

    A branch runs from a dead end to the first junction. A junction loses at most as many of its
    short branches in one round as leave it two ways, in order of the dead end's id; what then
    becomes a longer branch is measured anew. Walks stop once they reach the length, so a round
    never follows a long street.
    """
    graph = cut_lineage(both_ways(edges))
    for _ in range(max_rounds):
        degree = graph.groupBy("src").agg(F.count(F.lit(1)).alias("degree"))
        leaves = degree.filter("degree = 1").select(F.col("src").alias("leaf"))
        walk = cut_lineage(
            leaves.join(graph, F.col("leaf") == F.col("src"))
            .join(degree.select(F.col("src").alias("dst"), "degree"), "dst")
            .select("leaf", F.col("leaf").alias("at_prev"), F.col("dst").alias("at"), F.col("metres").alias("length"),
                    "degree", F.array(F.col("leaf")).alias("members"))
        )
        ended = None
        while True:
            # Ends: a junction, another dead end, or long enough to be kept whatever follows.
            short = walk.filter(F.col("length") < shorter_than)
            at_end = short.filter("degree != 2").withColumn(
                "members", F.when(F.col("degree") == 1, F.array_union("members", F.array("at"))).otherwise(F.col("members"))
            ).withColumn("junction", F.when(F.col("degree") > 2, F.col("at")))
            at_end = cut_lineage(at_end.select("leaf", "junction", "degree", "members"))
            ended = at_end if ended is None else ended.unionByName(at_end)
            going = short.filter("degree = 2")
            step = (
                going.drop("degree").join(graph, F.col("at") == F.col("src")).filter(F.col("dst") != F.col("at_prev"))
                .join(degree.select(F.col("src").alias("dst"), "degree"), "dst")
                .select("leaf", F.col("at").alias("at_prev"), F.col("dst"), (F.col("length") + F.col("metres")).alias("length"),
                        "degree", F.array_union("members", F.array("at")).alias("members"))
                .withColumnRenamed("dst", "at")
            )
            walk = cut_lineage(step)
            if walk.isEmpty():
                break
        # Members of a short branch are few: each edge has some length and the branch has less than the limit.
        # Of m short branches all but m - (degree - 2) go, two at most: the largest ids, found by plain maxima.
        short_ends = ended.filter("junction is not null")
        last = short_ends.groupBy("junction").agg(F.count(F.lit(1)).alias("_m"), F.max("leaf").alias("_last"))
        second = short_ends.join(last, "junction").filter("leaf != _last").groupBy("junction").agg(F.max("leaf").alias("_second"))
        keeps = F.col("_m") - F.col("degree") + 2
        stays = ((keeps >= 1) & (F.col("leaf") == F.col("_last"))) | ((keeps >= 2) & F.coalesce(F.col("leaf") == F.col("_second"), F.lit(False)))
        at_junction = short_ends.join(last, "junction").join(second, "junction", "left").filter(~stays).select(*ended.columns)
        gone = cut_lineage(
            at_junction.unionByName(ended.filter("junction is null")).select(F.explode("members").alias("id")).distinct()
        )
        if gone.isEmpty():
            return graph.filter("src < dst")
        graph = cut_lineage(
            graph.join(gone.withColumnRenamed("id", "src"), "src", "left_anti")
            .join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti").select("src", "dst", "metres")
        )
    raise RuntimeError(f"pruning did not settle in {max_rounds} rounds")


def chain_ends(graph: DataFrame, keep: DataFrame, max_rounds: int = 64) -> DataFrame:
    """(src, dst, end, metres): where the walk that enters at src -> dst first meets a kept node, and how long it is.

    Nodes with two neighbours that `keep` (id) does not name are passed through. Every directed edge points at the next one
    of its walk; each round a pointer takes over the pointer it points at, so walks double and rounds grow with the logarithm
    of the longest chain. Walks that go round a ring without a kept node have no end and are left out.
    """
    degree = graph.groupBy("src").agg(F.count(F.lit(1)).alias("degree"))
    inner = degree.filter("degree = 2").select(F.col("src").alias("id")).join(keep, "id", "left_anti")
    passed = graph.join(inner.withColumnRenamed("id", "dst"), "dst", "left_semi")
    onward = graph.select(F.col("src").alias("dst"), F.col("dst").alias("to"))
    going = cut_lineage(passed.join(onward, "dst").filter("to != src").select("src", "dst", F.col("dst").alias("at"), "to", "metres"))
    ended = graph.join(inner.withColumnRenamed("id", "dst"), "dst", "left_anti").select("src", "dst", F.col("dst").alias("end"), "metres")
    ended = cut_lineage(ended)
    left = going.count()
    for _ in range(max_rounds):
        if not left:
            return ended
        # The edge at -> to is either ended, or itself points further on.
        after = ended.select(F.col("src").alias("at"), F.col("dst").alias("to"), "end", F.col("metres").alias("more"))
        done = cut_lineage(going.join(after, ["at", "to"]).select("src", "dst", "end", (F.col("metres") + F.col("more")).alias("metres")))
        further = going.select(F.col("src").alias("at"), F.col("dst").alias("to"), F.col("at").alias("next_at"), F.col("to").alias("next_to"),
                               F.col("metres").alias("more"))
        going = cut_lineage(
            going.join(further, ["at", "to"])
            .select("src", "dst", F.col("next_at").alias("at"), F.col("next_to").alias("to"), (F.col("metres") + F.col("more")).alias("metres")))
        ended = ended.unionByName(done)
        remaining = going.count()
        if remaining == left:
            return ended
        left = remaining
    raise RuntimeError(f"chains did not end in {max_rounds} rounds")


def distances(edges: DataFrame, sources: DataFrame, max_metres: float, max_rounds: int = 100_000) -> DataFrame:
    """(source, node, metres): shortest walks from every source at once, up to a length.

    Streets are mostly nodes with two neighbours: walks between the others are contracted first, the sweep goes from junction
    to junction, and the nodes between take their distance from the two ends of their chain. A round extends only what the last
    one brought and writes only what it brings; what is known is never written again. `sources` holds (source).
    """
    graph = cut_lineage(both_ways(edges))
    start = cut_lineage(sources.select("source").distinct())
    ends = chain_ends(graph, start.select(F.col("source").alias("id")))
    degree = graph.groupBy("src").agg(F.count(F.lit(1)).alias("degree"))
    kept = degree.filter("degree != 2").select("src").union(start.select("source")).distinct()
    core = cut_lineage(ends.join(kept, "src", "left_semi").filter("src != end").groupBy("src", "end").agg(F.min("metres").alias("metres")))
    known = frontier = cut_lineage(start.select("source", F.col("source").alias("node"), F.lit(0.0).alias("metres")))
    for _ in range(max_rounds):
        reached = frontier.withColumnRenamed("metres", "so_far").join(core, F.col("node") == F.col("src")).select(
            "source", F.col("end").alias("node"), (F.col("so_far") + F.col("metres")).alias("metres")).filter(F.col("metres") <= max_metres)
        offers = reached.groupBy("source", "node").agg(F.min("metres").alias("metres"))
        old = known.select(F.col("source").alias("o_source"), F.col("node").alias("o_node"), F.col("metres").alias("old"))
        frontier = cut_lineage(offers.join(
            old, (F.col("source") == F.col("o_source")) & (F.col("node") == F.col("o_node")) & (F.col("old") <= F.col("metres")), "left_anti"))
        if frontier.isEmpty():
            break
        known = known.unionByName(frontier)
    else:
        raise RuntimeError(f"distances did not settle in {max_rounds} rounds")
    settled = known.groupBy("source", "node").agg(F.min("metres").alias("metres"))
    between = ends.join(kept, "src", "left_anti").select(F.col("src").alias("inner"), "end", F.col("metres").alias("more"))
    inside = settled.join(between, F.col("node") == F.col("end")).select(
        "source", F.col("inner").alias("node"), (F.col("metres") + F.col("more")).alias("metres")).filter(F.col("metres") <= max_metres)
    return settled.unionByName(inside.groupBy("source", "node").agg(F.min("metres").alias("metres")))


def predecessors(walks: DataFrame, edges: DataFrame, slack: float = 1e-7) -> DataFrame:
    """(source, node, before): the node a shortest walk comes from, the smallest id of several; sources have none.

    `walks` is (source, node, metres), written. Sums along a walk may differ in their last digits: `slack` metres count as equal.
    """
    back = both_ways(edges).select(F.col("dst").alias("node"), F.col("src").alias("before"), F.col("metres").alias("step"))
    from_ = walks.select("source", F.col("node").alias("before"), F.col("metres").alias("so_far"))
    links = walks.join(back, "node").join(from_, ["source", "before"]).filter(
        (F.col("so_far") < F.col("metres")) & (F.abs(F.col("so_far") + F.col("step") - F.col("metres")) <= slack))
    return links.groupBy("source", "node").agg(F.min("before").alias("before"))


def path_rows(walks: DataFrame, edges: DataFrame, max_rounds: int = 64) -> DataFrame:
    """(source, node, place, at): the nodes of the walk from source (place 0) to each node, one row each.

    Predecessor links are doubled: after i rounds each knows the node 2^i steps back. Taking the powers from the largest down,
    every number of steps back is reached once. Rounds grow with the logarithm of the longest walk and no path is ever a value.
    """
    walks = cut_lineage(walks.select("source", "node", "metres"))
    jumps = [cut_lineage(predecessors(walks, edges))]
    while not jumps[-1].isEmpty():
        if len(jumps) > max_rounds:
            raise RuntimeError(f"paths did not end in {max_rounds} rounds")
        last = jumps[-1]
        jumps.append(cut_lineage(last.join(last.select("source", F.col("before").alias("b"), F.col("node").alias("n")).select(
            "source", F.col("n").alias("before"), F.col("b").alias("further")), ["source", "before"]).select("source", "node", F.col("further").alias("before"))))
    rows = walks.select("source", "node", F.col("node").alias("at"), F.lit(0).alias("back"))
    for i in range(len(jumps) - 2, -1, -1):
        step = jumps[i].select("source", F.col("node").alias("at"), "before")
        rows = cut_lineage(rows.unionByName(rows.join(step, ["source", "at"]).select(
            "source", "node", F.col("before").alias("at"), (F.col("back") + (1 << i)).alias("back"))))
    longest = rows.groupBy("source", "node").agg(F.max("back").alias("steps"))
    return rows.join(longest, ["source", "node"]).select("source", "node", (F.col("steps") - F.col("back")).alias("place"), "at")


def nearest_nodes(points: DataFrame, nodes: DataFrame, key: str, group: str = "territory_id") -> DataFrame:
    """(group, key, node, distance_m): the node nearest each point."""
    return nearest_neighbours(
        points, nodes, 1, group, key, candidate_key="id", exclude_self=False
    ).select(group, key, F.col("neighbour").alias("node"), "distance_m")


def nearest_nodes_of_parcels(parcels: DataFrame, nodes: DataFrame, group: str = "territory_id", key: str = "pams_pin"):
    """(group, key, node, parcel_m): the node nearest the parcel itself, not its middle.

    The node nearest the middle bounds the search: no better node lies farther from the middle
    than that distance plus the parcel's own reach.
    """
    centre = nearest_nodes(parcels, nodes, key, group)
    edged = parcels.withColumn("edges", geo.segments(F.col("polygon")))
    corner = F.array_max(F.transform("edges", lambda s: geo.haversine_m(F.col("lon"), F.col("lat"), s.x1, s.y1)))
    reach = edged.join(centre.select(group, key, "distance_m"), [group, key]).withColumn(
        "reach_m", F.col("distance_m") * 1.01 + corner + 1.0
    ).select(group, key, "lon", "lat", "edges", "reach_m")
    pairs = within_reach(reach, nodes.select(group, "id", "lon", "lat"), group)
    scale_x = F.lit(geo.METRES_PER_DEGREE_LON) * F.cos(geo.radians(F.col("c_lat")))
    scale_y = F.lit(geo.METRES_PER_DEGREE_LAT)

    def to_segment(s):
        vx, vy = (s.x2 - s.x1) * scale_x, (s.y2 - s.y1) * scale_y
        wx, wy = (F.col("lon") - s.x1) * scale_x, (F.col("lat") - s.y1) * scale_y
        size = vx * vx + vy * vy
        t = F.when(size > 0, F.least(F.greatest((wx * vx + wy * vy) / size, F.lit(0.0)), F.lit(1.0))).otherwise(0.0)
        ox, oy = wx - t * vx, wy - t * vy
        return F.sqrt(ox * ox + oy * oy)

    gap = F.when(geo.covered(F.col("edges"), F.col("lon"), F.col("lat")), F.lit(0.0)).otherwise(
        F.array_min(F.transform("edges", to_segment))
    )
    # Nodes equally far but for rounding are a tie, the smaller id's.
    return pairs.withColumn("gap", F.round(gap, 6)).groupBy(group, key).agg(
        F.min(F.struct("gap", "id")).alias("best")
    ).select(group, key, F.col("best.id").alias("node"), F.col("best.gap").alias("parcel_m"))


def network_legs(
    origins: DataFrame, doors: DataFrame, walk: DataFrame, origin_key: str = "origin", door_key: str = "pams_pin"
) -> DataFrame:
    """Metres from each origin to each door it is paired with: frontage, along the network, frontage.

    `origins` hold (origin, o_node, o_frontage_m), `doors` (origin, pams_pin, node, frontage_m,
    straight_m), `walk` (source, node, metres). Without a way along the network the straight
    estimate stands.
    """
    along = walk.select(F.col("source").alias("o_node"), "node", F.col("metres").alias("along_m"))
    return (
        doors.join(origins, origin_key).join(along, ["o_node", "node"], "left")
        .withColumn("leg_m", F.coalesce(F.col("o_frontage_m") + F.col("along_m") + F.col("frontage_m"), F.col("straight_m")))
    )


def plausible(access: DataFrame, nodes: DataFrame, group: str = "territory_id", metres: str = "parcel_m") -> DataFrame:
    """(group, nodes, median_m, plausible): enough nodes, and the middle parcel close to one (upper middle)."""
    counted = nodes.groupBy(group).agg(F.count(F.lit(1)).alias("nodes"))
    ranked = ranked_histogram(access, [group], metres)
    middle = F.floor(F.col("total") / 2)
    median = ranked.filter((F.col("below") <= middle) & (middle < F.col("below") + F.col("n"))).select(
        group, F.col(metres).alias("median_m")
    )
    return counted.join(median, group, "left").withColumn(
        "plausible", (F.col("nodes") >= MIN_NODES) & F.coalesce(F.col("median_m") <= MAX_MEDIAN_M, F.lit(False))
    )
