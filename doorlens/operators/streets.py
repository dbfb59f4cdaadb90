"""Street segments against parcel polygons: which ones cross a parcel, and how far their middles lie from the nearest.

A segment is at most 60 m long, so whatever it meets and whatever is within 30 m of its middle lies in one square around
that middle. Polygon edges are filed under the grid level whose cell is as wide as their box, grown by that square: at most
four cells each. A segment then asks one cell a level, and both questions are answered by the same join. Edges, not
polygons, travel, so a parcel with very many corners is spread over its cells like many small ones.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doorlens.functions import geo
from doorlens.operators import graph
from doorlens.operators.spatial import with_edges


def _cells(box: list[Column], level: Column) -> tuple[Column, Column]:
    side = F.pow(F.lit(2.0), level)
    return tuple(F.sequence(F.floor(box[i] / side).cast("bigint"), F.floor(box[i + 2] / side).cast("bigint")) for i in (0, 1))


def _turn(ax, ay, bx, by, cx, cy) -> Column:
    """Positive where c lies to the left of a -> b, zero on its line."""
    return (bx - ax) * (cy - ay) - (by - ay) * (cx - ax)


def _meet(p: Sequence[Column], q: Sequence[Column]) -> Column:
    """Whether two segments (x1, y1, x2, y2) share a point, ends included."""
    boxes = ((F.greatest(p[0], p[2]) >= F.least(q[0], q[2])) & (F.greatest(q[0], q[2]) >= F.least(p[0], p[2]))
             & (F.greatest(p[1], p[3]) >= F.least(q[1], q[3])) & (F.greatest(q[1], q[3]) >= F.least(p[1], p[3])))

    def parted(a, b):
        one, two = _turn(*a, b[0], b[1]), _turn(*a, b[2], b[3])
        return ((one > 0) & (two > 0)) | ((one < 0) & (two < 0))

    return boxes & ~parted(p, q) & ~parted(q, p)


def _gap(x: Column, y: Column, q: Sequence[Column]) -> Column:
    """Distance from a point to a segment."""
    vx, vy = q[2] - q[0], q[3] - q[1]
    size = vx * vx + vy * vy
    t = F.when(size > 0, F.least(F.greatest(((x - q[0]) * vx + (y - q[1]) * vy) / size, F.lit(0.0)), F.lit(1.0))).otherwise(0.0)
    ox, oy = x - q[0] - t * vx, y - q[1] - t * vy
    return F.sqrt(ox * ox + oy * oy)


def segments_among_parcels(
    segments: DataFrame, parcels: DataFrame, keys: Sequence[str] = (), max_edge: float = graph.MAX_EDGE_M, max_clearance: float = graph.MAX_CLEARANCE_M
) -> DataFrame:
    """Segments up to `max_edge` long with `crosses` and `clearance_m` (null beyond `max_clearance`).

    `segments` hold (id, x1, y1, x2, y2), `parcels` a `polygon`, both in metres on one flat map per `keys`. Touching a parcel or
    lying in it is crossing; inside, the clearance is 0.
    """
    reach = max(max_edge / 2, max_clearance)
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    short = segments.filter(dx * dx + dy * dy <= max_edge * max_edge).withColumns({"mx": (F.col("x1") + F.col("x2")) / 2, "my": (F.col("y1") + F.col("y2")) / 2})
    shapes = with_edges(parcels).select(*keys, F.xxhash64("edges").alias("shape"), "edges").dropDuplicates([*keys, "shape"])
    rings = shapes.select(*keys, "shape", F.explode("edges").alias("e")).select(*keys, "shape", "e.*").withColumnsRenamed(
        {"x1": "ex1", "y1": "ey1", "x2": "ex2", "y2": "ey2"})
    box = [F.least("ex1", "ex2") - reach, F.least("ey1", "ey2") - reach, F.greatest("ex1", "ex2") + reach, F.greatest("ey1", "ey2") + reach]
    filed = rings.withColumn("level", F.ceil(F.log2(F.greatest(box[2] - box[0], box[3] - box[1]))).cast("int"))
    across, down = _cells(box, F.col("level"))
    filed = filed.withColumn("cx", F.explode(across)).withColumn("cy", F.explode(down)).drop("shape")
    in_use = filed.agg(F.collect_set("level").alias("levels")).scalar()
    side = F.pow(F.lit(2.0), F.col("level"))
    asked = short.withColumn("level", F.explode(in_use)).withColumns(
        {"cx": F.floor(F.col("mx") / side).cast("bigint"), "cy": F.floor(F.col("my") / side).cast("bigint")})
    mine, other = [F.col(c) for c in ("x1", "y1", "x2", "y2")], [F.col(c) for c in ("ex1", "ey1", "ex2", "ey2")]
    # One row a segment and task is shuffled, however many edges it met.
    met = asked.join(filed, [*keys, "level", "cx", "cy"]).groupBy(*keys, "id").agg(
        F.max(_meet(mine, other)).alias("meets"), F.min(_gap(F.col("mx"), F.col("my"), other)).alias("gap"))
    inside = _inside(short.select(*keys, "id", "mx", "my"), rings, keys)
    joined = short.join(met, [*keys, "id"], "left").join(inside, [*keys, "id"], "left")
    held = F.coalesce("held", F.lit(False))
    gap = F.when(held, F.lit(0.0)).otherwise(F.col("gap"))
    return joined.select(*segments.columns, (held | F.coalesce("meets", F.lit(False))).alias("crosses"), F.when(gap <= max_clearance, gap).alias("clearance_m"))


def _inside(points: DataFrame, rings: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, id, held): points that some polygon holds by the even-odd rule.

    An upward ray is cut by the edges over a point. Edges are filed by their span across, points ask their column at each level;
    the cuts are counted per point and polygon.
    """
    upright = rings.filter("ex1 != ex2")
    left, right = F.least("ex1", "ex2"), F.greatest("ex1", "ex2")
    filed = upright.withColumn("level", F.ceil(F.log2(right - left)).cast("int"))
    side = F.pow(F.lit(2.0), F.col("level"))
    filed = filed.withColumn("cx", F.explode(F.sequence(F.floor(left / side).cast("bigint"), F.floor(right / side).cast("bigint"))))
    box = rings.groupBy(*keys, "shape").agg(F.min(F.least("ey1", "ey2")).alias("low"), F.max(F.greatest("ey1", "ey2")).alias("high"))
    # A polygon's height bounds the rows of points that its edges can matter to: the join is on column and row.
    filed = filed.join(box, [*keys, "shape"]).withColumn("rows", F.ceil(F.log2(F.greatest(F.col("high") - F.col("low"), F.lit(1.0)))).cast("int"))
    tall = F.pow(F.lit(2.0), F.col("rows"))
    filed = filed.withColumn("cy", F.explode(F.sequence(F.floor(F.col("low") / tall).cast("bigint"), F.floor(F.col("high") / tall).cast("bigint"))))
    in_use = filed.agg(F.collect_set(F.struct("level", "rows")).alias("levels")).scalar()
    asked = points.withColumn("l", F.explode(in_use)).select(*keys, "id", "mx", "my", "l.level", "l.rows")
    asked = asked.withColumns({"cx": F.floor(F.col("mx") / side).cast("bigint"), "cy": F.floor(F.col("my") / tall).cast("bigint")})
    # Half-open across, so that a corner counts once; above the point, by the sign of a product.
    spans = (F.col("ex1") > F.col("mx")) != (F.col("ex2") > F.col("mx"))
    above = (_turn(F.col("ex1"), F.col("ey1"), F.col("ex2"), F.col("ey2"), F.col("mx"), F.col("my")) < 0) == (F.col("ex2") > F.col("ex1"))
    cuts = asked.join(filed, [*keys, "level", "rows", "cx", "cy"]).filter(spans & above).groupBy(*keys, "id", "shape").agg(F.count(F.lit(1)).alias("cuts"))
    return cuts.filter("cuts % 2 = 1").select(*keys, "id").distinct().withColumn("held", F.lit(True))


def street_edges(segments: DataFrame, parcels: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """The segments that are roadway, as the shortest edge per pair of half-metre nodes: no parcel crossed, one within 30 m."""
    placed = segments_among_parcels(segments, parcels, keys)
    return graph.street_edges(placed.filter("clearance_m is not null"), keys)
