"""Exact nearest neighbours and point-in-polygon as equi-joins on cell ids.

Nearest neighbours. Points at one spot are first folded into one location, and a
location offers only its first k+1 ids, since no answer can need more of them. Cells
come from a grid that is halved level by level over the extent of each territory;
a subject works at the finest level where its own cell holds more than k points, so
dense places get small cells and thin places large ones. All k nearest then lie within
the far corner of that cell, and only cells that touch that circle are probed. A subject whose
circle would take in far more than k places (a lone one beside a town, one at the edge of a crowd)
descends from the root instead, cell by cell: the far corner of any cell that holds more than k
bounds its search, cells beyond the bound are left, and only small cells are read. The answer
equals a full comparison; no partner is cut off.

Point in polygon. A polygon is filed under the one level whose cell side is at least its
extent, so it covers at most four cells; a point asks one cell per level in use.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from doorlens.functions import geo
from doorlens.operators.ordering import count_below, value_bucket
from doorlens.session import cut_lineage, land


def _cell(value: Column, origin: Column, side: Column) -> Column:
    return F.floor((value - origin) / side).cast("bigint")


def nearest_neighbours(
    subjects: DataFrame,
    candidates: DataFrame,
    k: int,
    group: str = "territory_id",
    key: str = "pams_pin",
    candidate_key: str | None = None,
    exclude_self: bool = True,
    radius: float = geo.COMPARABLES_RADIUS_M,
    below_levels: int = 4,
    crowd: int = 16,
    extra_levels: int = 24,
    carry: Sequence[str] = (),
) -> DataFrame:
    """The k nearest candidates of each subject in its group, ties by id.

    `subjects` hold (group, key, lon, lat), `candidates` (group, candidate_key, lon, lat); rows
    without a position take no part. `exclude_self` is for ids of one kind: a subject does not
    meet itself. `carry` names columns of the candidates that come along with the neighbour, so that
    nobody has to look them up again. Returns (group, key, neighbour, distance_m, rank, *carry).

    Places and subjects' spots get a number when they are written. The pairs, most of the rows, then hold two numbers and a
    distance, and what follows is keyed by a number: Spark deals rows anew for each grouping or join by a floating-point key.
    """
    subjects = subjects.select(group, key, "lon", "lat").filter("lon is not null and lat is not null")
    candidates = candidates.select(group, F.col(candidate_key or key).alias("_id"), "lon", "lat", *carry).filter(
        "lon is not null and lat is not null"
    )
    spot = [group, "lon", "lat"]

    # Subjects and candidates at one spot share one search.
    in_spot = Window.partitionBy(*spot).orderBy("_id")
    offered = (
        candidates.withColumn("_i", F.row_number().over(in_spot)).filter(F.col("_i") <= k + 1)
        .groupBy(*spot).agg(F.collect_list(F.struct("_id", *carry)).alias("ids")).withColumn("place", F.monotonically_increasing_id())
    )
    # What several steps read is written once: the places, the index with its counts, and the cells that subjects ask.
    offered = land(offered, "places")
    places = offered.select(*spot, F.size("ids").alias("weight"), "place")
    spots = land(subjects.select(*spot).distinct().withColumn("sid", F.monotonically_increasing_id()), "spots")

    # The root cell covers subjects and candidates alike, so no subject falls outside the grid.
    everyone = places.drop("place").unionByName(spots.select(*spot, F.lit(0).alias("weight")))
    extent = everyone.groupBy(group).agg(
        F.min("lon").alias("x0"), F.min("lat").alias("y0"),
        F.greatest(F.max("lon") - F.min("lon"), F.max("lat") - F.min("lat")).alias("_span"),
        F.max(F.abs("lat")).alias("_far_lat"), F.min(F.abs("lat")).alias("_near_lat"), F.count_if(F.col("weight") > 0).alias("_places"),
    ).select(
        group, "x0", "y0",
        # A hair more than the extent, so the last point stays inside the root cell.
        (F.col("_span") * 1.000001 + 1e-9).alias("root"),
        # The least and the greatest length of a degree of longitude here, against one of latitude.
        F.cos(geo.radians(F.least(F.col("_far_lat") + 0.01, F.lit(89.0)))).alias("thin"),
        F.cos(geo.radians(F.greatest(F.col("_near_lat") - 0.01, F.lit(0.0)))).alias("thick"),
        F.greatest(F.ceil(F.log2(F.greatest(F.col("_places") / F.lit(k + 1.0), F.lit(1.0))) / 2.0), F.lit(0))
        .cast("int").alias("_even"),
    ).withColumn("deepest", F.col("_even") + below_levels).withColumn(
        "topmost", F.greatest(F.col("_even") - below_levels, F.lit(0))
    )
    extent = land(extent, "extent")

    # Where one cell of the deepest level is still crowded, the grid goes on below it. The cells
    # around it are indexed as deep, because a subject inside may look over the border.
    def deepest_cell(df):
        side = F.col("root") / F.pow(F.lit(2.0), F.col("deepest"))
        return (
            df.join(extent, group).withColumn("dx", _cell(F.col("lon"), F.col("x0"), side))
            .withColumn("dy", _cell(F.col("lat"), F.col("y0"), side))
        )

    crowded = (
        deepest_cell(places).groupBy(group, "dx", "dy").agg(F.sum("weight").alias("_w"), F.max("thin").alias("thin"),
                                                            F.max("thick").alias("thick"))
        .filter(F.col("_w") > crowd * (k + 1))
    )
    crowded = land(crowded, "crowded")
    ring = F.ceil(F.sqrt(F.col("thick") * F.col("thick") + 1.0) / (F.col("thin") * 2.0))
    around = (
        crowded.withColumn("dx", F.explode(F.sequence(F.col("dx") - ring, F.col("dx") + ring)))
        .withColumn("dy", F.explode(F.sequence(F.col("dy") - 1, F.col("dy") + 1)))
        .select(group, "dx", "dy").distinct()
    )

    def at_levels(df, dense):
        marked = deepest_cell(df).join(dense.select(group, "dx", "dy", F.lit(True).alias("_dense")), [group, "dx", "dy"], "left")
        last = F.col("deepest") + F.when(F.col("_dense"), extra_levels).otherwise(0)
        levels = F.array_distinct(F.concat(F.array(F.lit(0)), F.sequence(F.col("topmost"), last)))
        return (
            marked.withColumn("level", F.explode(levels)).drop("dx", "dy", "_dense")
            .withColumn("side", F.col("root") / F.pow(F.lit(2.0), F.col("level")))
            .withColumn("cx", _cell(F.col("lon"), F.col("x0"), F.col("side")))
            .withColumn("cy", _cell(F.col("lat"), F.col("y0"), F.col("side")))
        )

    cell = [group, "level", "cx", "cy"]
    indexed = land(at_levels(places, around).select(*cell, "lon", "lat", "weight", "place"), "index")
    filled = land(indexed.groupBy(*cell).agg(F.sum("weight").alias("held")), "cells")

    # The finest own cell with more than k points, or the root.
    asked = at_levels(spots, crowded).select(*cell, "sid")
    chosen = (
        asked.join(filled, cell, "left")
        .filter((F.coalesce(F.col("held"), F.lit(0)) > k) | (F.col("level") == 0))
        .groupBy("sid").agg(F.max(F.struct("level", "cx", "cy", "held")).alias("c"))
        .select("sid", "c.*").join(spots, "sid").join(extent.select(group, "x0", "y0", "root", "thin", "thick"), group)
        .withColumn("side", F.col("root") / F.pow(F.lit(2.0), F.col("level")))
    )
    # The farthest corner of that cell bounds the search; a thin root cell means everything.
    low_x, low_y = F.col("x0") + F.col("cx") * F.col("side"), F.col("y0") + F.col("cy") * F.col("side")
    dx = F.greatest(F.col("lon") - low_x, low_x + F.col("side") - F.col("lon"))
    dy = F.greatest(F.col("lat") - low_y, low_y + F.col("side") - F.col("lat"))
    reach_y = F.sqrt(dx * dx * F.col("thick") * F.col("thick") + dy * dy) * (1.0 + 1e-9)
    probes = chosen.select(
        "sid", *spot, "level", "side", "x0", "y0", "held", reach_y.alias("ry"), (reach_y / F.col("thin")).alias("rx"),
        (reach_y * F.lit(geo.DEGREE * radius)).alias("reach_m"),
    )
    whole = F.coalesce(F.col("held"), F.lit(0)) <= k
    span_x = F.when(whole, F.array(F.lit(0).cast("bigint"))).otherwise(
        F.sequence(
            F.greatest(_cell(F.col("lon") - F.col("rx"), F.col("x0"), F.col("side")), F.lit(0)),
            F.greatest(_cell(F.col("lon") + F.col("rx"), F.col("x0"), F.col("side")), F.lit(0)),
        )
    )
    span_y = F.when(whole, F.array(F.lit(0).cast("bigint"))).otherwise(
        F.sequence(
            F.greatest(_cell(F.col("lat") - F.col("ry"), F.col("y0"), F.col("side")), F.lit(0)),
            F.greatest(_cell(F.col("lat") + F.col("ry"), F.col("y0"), F.col("side")), F.lit(0)),
        )
    )
    low_x, low_y = F.col("x0") + F.col("cx") * F.col("side"), F.col("y0") + F.col("cy") * F.col("side")
    gap_x = F.greatest(low_x - F.col("lon"), F.col("lon") - low_x - F.col("side"), F.lit(0.0)) / F.col("rx")
    gap_y = F.greatest(low_y - F.col("lat"), F.col("lat") - low_y - F.col("side"), F.lit(0.0)) / F.col("ry")
    probes = (
        probes.withColumn("cx", F.explode(span_x)).withColumn("cy", F.explode(span_y))
        .filter(whole | (gap_x * gap_x + gap_y * gap_y <= 1.0 + 1e-6))
        .select(
            *cell, "sid", F.col("lon").alias("s_lon"), F.col("lat").alias("s_lat"), F.when(~whole, F.col("reach_m")).alias("reach_m")
        )
    )
    probes = land(probes, "probes")
    most = 9 * crowd * (k + 1)
    costly = (
        probes.join(filled, cell).groupBy("sid").agg(
            F.sum("held").alias("_read"), *[F.any_value(c).alias(c) for c in (group, "s_lon", "s_lat")])
        .filter(F.col("_read") > most).select(group, "sid", "s_lon", "s_lat")
    )
    costly = cut_lineage(costly)
    if not costly.isEmpty():
        probes = probes.join(costly, "sid", "left_anti").unionByName(
            _descend(costly, extent, filled, cell, group, k, crowd * (k + 1), extra_levels, geo.DEGREE * radius)
        )

    distance = geo.equirectangular_m(F.col("lon"), F.col("lat"), F.col("s_lon"), F.col("s_lat"), radius)
    # Levels that nobody asks at, most of the index, are left before it is dealt by cell; there are some tens of levels at most.
    levels = [r.level for r in probes.select("level").distinct().collect()]
    offering = indexed.filter(F.col("level").isin(levels)).select(*cell, "lon", "lat", "place")
    pairs = (
        probes.join(offering, cell).withColumn("distance_m", distance)
        .filter(F.col("reach_m").isNull() | (F.col("distance_m") <= F.col("reach_m"))).select("sid", "place", "distance_m")
    )
    # The k+1 nearest locations, ties kept, hold the k nearest ids of every subject there.
    near = Window.partitionBy("sid").orderBy("distance_m")
    shortlist = (
        pairs.withColumn("_r", F.rank().over(near)).filter(F.col("_r") <= k + 1)
        .join(offered.select("place", "ids"), "place")
        .select("sid", "distance_m", F.explode("ids").alias("id")).select("sid", "distance_m", F.col("id._id").alias("neighbour"), *[f"id.{c}" for c in carry])
    )
    ranked = Window.partitionBy("sid").orderBy("distance_m", "neighbour")
    answer = (
        shortlist.withColumn("_r", F.row_number().over(ranked)).filter(F.col("_r") <= k + 1)
        .groupBy("sid").agg(F.sort_array(F.collect_list(F.struct("distance_m", "neighbour", *carry))).alias("near"))
    )
    # Each subject drops itself and keeps k.
    others = F.filter("near", lambda n: n.neighbour != F.col(key)) if exclude_self else F.col("near")
    own = F.slice(others, 1, k)
    return (
        subjects.join(spots, spot).select(group, key, "sid").join(answer, "sid").select(group, key, F.posexplode(own).alias("_p", "n"))
        .select(group, key, "n.neighbour", "n.distance_m", (F.col("_p") + 1).alias("rank"), *[f"n.{c}" for c in carry])
    )


def _descend(
    subjects: DataFrame, extent: DataFrame, filled: DataFrame, cell: list[str], group: str, k: int, small: int, extra_levels: int, metres: float
) -> DataFrame:
    """(cell..., sid, s_lon, s_lat, reach_m): the small cells that can hold one of a subject's k nearest, found from the root down.

    Each round goes one level deeper for all subjects at once. A subject's bound is the least far
    corner distance of any cell seen with more than k places; a cell whose near side lies beyond it is left.
    """
    subject = [group, "sid", "s_lon", "s_lat"]
    upper = (
        filled.join(extent.select(group, "topmost"), group).filter(F.col("level") == F.col("topmost")).filter("topmost > 0")
        .withColumn("up", F.explode(F.sequence(F.lit(1), F.col("topmost")))).withColumn("step", F.pow(F.lit(2.0), F.col("up")))
        .select(group, (F.col("topmost") - F.col("up")).alias("level"), F.floor(F.col("cx") / F.col("step")).alias("cx"),
                F.floor(F.col("cy") / F.col("step")).alias("cy"), "held")
        .groupBy(*cell).agg(F.sum("held").alias("held"))
    )
    lower = filled.join(extent.select(group, "topmost"), group).filter(F.col("level") >= F.col("topmost")).select(*cell, "held")
    counts = cut_lineage(lower.unionByName(upper))
    frontier = cut_lineage(
        subjects.join(extent, group).select(
            *subject, "x0", "y0", "root", "thin", "thick", "topmost", "deepest", F.lit(0).cast("bigint").alias("cx"), F.lit(0).cast("bigint").alias("cy"),
            F.lit(float("inf")).alias("bound"))
    )
    every = Window.partitionBy("sid")
    found = None
    level = 0
    while not frontier.isEmpty():
        level += 1
        below = counts.filter(F.col("level") == level).select(
            group, F.col("cx").alias("nx"), F.col("cy").alias("ny"), "held", F.shiftright("cx", 1).alias("cx"), F.shiftright("cy", 1).alias("cy"))
        side = F.col("root") / float(2**level)
        low_x, low_y = F.col("x0") + F.col("nx") * side, F.col("y0") + F.col("ny") * side
        far_x = F.greatest(F.abs(F.col("s_lon") - low_x), F.abs(low_x + side - F.col("s_lon")))
        far_y = F.greatest(F.abs(F.col("s_lat") - low_y), F.abs(low_y + side - F.col("s_lat")))
        gap_x = F.greatest(low_x - F.col("s_lon"), F.col("s_lon") - low_x - side, F.lit(0.0))
        gap_y = F.greatest(low_y - F.col("s_lat"), F.col("s_lat") - low_y - side, F.lit(0.0))
        near = F.sqrt(F.pow(gap_x * F.col("thin"), 2) + gap_y * gap_y)
        far = F.sqrt(F.pow(far_x * F.col("thick"), 2) + far_y * far_y) * (1.0 + 1e-9)
        step = (
            frontier.join(below, [group, "cx", "cy"]).withColumns({"near": near, "far": far})
            .withColumn("bound", F.least("bound", F.coalesce(F.min(F.when(F.col("held") > k, F.col("far"))).over(every), F.lit(float("inf")))))
            .filter(F.col("near") <= F.col("bound") * (1.0 + 1e-6))
            .withColumn("leaf", (F.lit(level) >= F.col("topmost")) & ((F.col("held") <= small) | (F.lit(level) >= F.col("deepest") + extra_levels)))
            .drop("cx", "cy", "far", "held").withColumnsRenamed({"nx": "cx", "ny": "cy"})
        )
        step = cut_lineage(step)
        leaves = step.filter("leaf").select(*subject, F.lit(level).alias("level"), "cx", "cy", "near", "bound")
        found = leaves if found is None else found.unionByName(leaves)
        frontier = step.filter(~F.col("leaf")).drop("leaf", "near")
    final = Window.partitionBy("sid")
    return (
        found.withColumn("bound", F.min("bound").over(final)).filter(F.col("near") <= F.col("bound") * (1.0 + 1e-6))
        .select(*cell, "sid", "s_lon", "s_lat", F.when(F.col("bound") < float("inf"), F.col("bound") * (metres * (1.0 + 1e-6))).alias("reach_m"))
    )


def valid_single_family(parcels: DataFrame) -> DataFrame:
    return parcels.filter(
        (F.trim(F.coalesce("prop_class", F.lit(""))) == "2") & (F.col("net_value") > 0) & F.col("lon").isNotNull()
        & F.col("lat").isNotNull()
    )


def nearest_comparables(parcels: DataFrame, k: int = 20) -> DataFrame:
    """(territory_id, pams_pin, comp_pin, distance_m, value): up to k valid homes nearest each positioned door."""
    homes = valid_single_family(parcels).withColumn("value", F.col("net_value"))
    return nearest_neighbours(parcels, homes, k, carry=["value"]).select(
        "territory_id", "pams_pin", F.col("neighbour").alias("comp_pin"), "distance_m", "value", "rank"
    )


# --- polygons ----------------------------------------------------------------------


def with_edges(boundaries: DataFrame, polygon: str = "polygon") -> DataFrame:
    """Adds ring edges and bounds; rows without a usable ring go."""
    out = boundaries.withColumn("edges", geo.segments(F.col(polygon))).filter(F.size("edges") > 0)
    return out.select("*", *geo.bounds(F.col("edges"))).filter("min_x is not null and min_y is not null")


def box_polygon(min_x: Column, min_y: Column, max_x: Column, max_y: Column) -> Column:
    ring = F.array(
        F.array(min_x, min_y), F.array(max_x, min_y), F.array(max_x, max_y), F.array(min_x, max_y), F.array(min_x, min_y)
    )
    return F.array(F.array(ring))


def locate(
    points: DataFrame, boundaries: DataFrame, keys: Sequence[str], value: str = "geoid", order: str = "ordinal"
) -> DataFrame:
    """Adds `value` of the boundary that covers each point; edges count, the lowest `order` wins."""
    filed = with_edges(boundaries).withColumn(
        "level",
        F.ceil(F.log2(F.greatest(F.col("max_x") - F.col("min_x"), F.col("max_y") - F.col("min_y"), F.lit(1e-6))))
        .cast("int"),
    )
    side = F.pow(F.lit(2.0), F.col("level"))
    cells = (
        filed.withColumn("cx", F.explode(F.sequence(F.floor(F.col("min_x") / side), F.floor(F.col("max_x") / side))))
        .withColumn("cy", F.explode(F.sequence(F.floor(F.col("min_y") / side), F.floor(F.col("max_y") / side))))
        .select("level", "cx", "cy", value, order, "edges", "min_x", "min_y", "max_x", "max_y")
    )
    in_use = filed.agg(F.collect_set("level").alias("levels")).scalar()
    placed = points.filter("lon is not null and lat is not null").select(*keys, "lon", "lat")
    asked = (
        placed.withColumn("level", F.explode(in_use))
        .withColumn("cx", F.floor(F.col("lon") / side)).withColumn("cy", F.floor(F.col("lat") / side))
    )
    found = (
        asked.join(cells, ["level", "cx", "cy"])
        .filter(F.col("lon").between(F.col("min_x"), F.col("max_x")) & F.col("lat").between(F.col("min_y"), F.col("max_y")))
        .filter(geo.covered(F.col("edges"), F.col("lon"), F.col("lat")))
        .groupBy(*keys).agg(F.min_by(value, order).alias(value))
    )
    return points.join(found, list(keys), "left")


# --- everything within a distance ---------------------------------------------------


def within_reach(
    centres: DataFrame, points: DataFrame, group: str = "territory_id", reach: str = "reach_m"
) -> DataFrame:
    """Pairs of a centre and a point of its group no farther than the centre's own `reach` (metres).

    A centre is filed under the grid level whose cell is as wide as its reach, so it asks at
    most nine cells (a few more near the poles); points ask one cell per level in use. Columns
    of both sides are kept; the point's position is `lon`, `lat`, the centre's `c_lon`, `c_lat`.
    """
    widest = F.cos(geo.radians(F.least(F.abs("c_lat") + 1.0, F.lit(89.0))))
    degree = geo.COMPARABLES_RADIUS_M * geo.DEGREE
    ry = F.col(reach) / F.lit(degree) * 1.001
    rx = ry / widest
    side = F.pow(F.lit(2.0), F.col("level"))
    filed = (
        centres.withColumnsRenamed({"lon": "c_lon", "lat": "c_lat"})
        .withColumn("level", F.ceil(F.log2(F.greatest(rx, F.lit(1e-7)))).cast("int"))
        .withColumn("cx", F.explode(F.sequence(F.floor((F.col("c_lon") - rx) / side), F.floor((F.col("c_lon") + rx) / side))))
        .withColumn("cy", F.explode(F.sequence(F.floor((F.col("c_lat") - ry) / side), F.floor((F.col("c_lat") + ry) / side))))
    )
    in_use = filed.agg(F.collect_set("level").alias("levels")).scalar()
    asked = (
        points.filter("lon is not null and lat is not null").withColumn("level", F.explode(in_use))
        .withColumn("cx", F.floor(F.col("lon") / side)).withColumn("cy", F.floor(F.col("lat") / side))
    )
    near = geo.haversine_m(F.col("c_lon"), F.col("c_lat"), F.col("lon"), F.col("lat")) <= F.col(reach)
    return asked.join(filed, [group, "level", "cx", "cy"]).filter(near).drop("level", "cx", "cy")


# --- territory ---------------------------------------------------------------------


def select_territory(parcels: DataFrame, anchors: DataFrame) -> DataFrame:
    """The `target` residential parcels nearest each anchor, nearest first, as `territory_rank`; ties by pin.

    Distances fall into bands, whose counts say in which band a territory's target lies; what is farther goes unranked. The
    others take their rank level by level: bands of a territory, distances of a band, pins of one distance. So no window
    holds a territory, however many parcels it has and however large its target is.
    """
    homes = parcels.filter((F.col("prop_class") == "2") & F.col("lon").isNotNull() & F.col("lat").isNotNull())
    metres = geo.equirectangular_m(F.col("lon"), F.col("lat"), F.col("anchor_lon"), F.col("anchor_lat"), geo.TERRITORY_RADIUS_M)
    placed = homes.join(anchors, "territory_id").withColumn("anchor_m", metres).withColumns({
        "_band": value_bucket(F.col("anchor_m")), "_distance": F.col("anchor_m"), "_pin": F.col("pams_pin"), "_one": F.lit(1).cast("long")})
    bands = placed.groupBy("territory_id", "target", "_band").agg(F.count(F.lit(1)).alias("_held"))
    wanted = count_below(bands, ["territory_id"], ["_band"], "_held", "_before").filter(F.col("_before") < F.col("target"))
    near = placed.join(wanted.select("territory_id", "_band"), ["territory_id", "_band"], "left_semi")
    ranked = count_below(near, ["territory_id"], ["_band", "_distance", "_pin"], "_one", "territory_rank")
    return ranked.withColumn("territory_rank", (F.col("territory_rank") + 1).cast("int")).filter(F.col("territory_rank") <= F.col("target")).drop(
        "anchor_lon", "anchor_lat", "target", "_band", "_distance", "_pin", "_one")
