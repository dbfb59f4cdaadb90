"""Distances, projection, tile frames and polygon arithmetic as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
DEGREE = 0.017453292519943295
TERRITORY_RADIUS_M = 6371008.8
COMPARABLES_RADIUS_M = 6371000.0
MERCATOR_RADIUS_M = 6378137.0
DETOUR = 1.3
METRES_PER_MINUTE = 3.0 * 1609.344 / 60.0
METRES_PER_DEGREE_LAT = 110540.0
METRES_PER_DEGREE_LON = 111320.0
TILE_SPAN_M = 120.0
ORTHO_BASE = "https://maps.nj.gov/arcgis/rest/services/Basemap"
VINTAGES = (2015, 2020)


def radians(degrees: Column) -> Column:
    return degrees * F.lit(DEGREE)


def equirectangular_m(lon1, lat1, lon2, lat2, radius: float = COMPARABLES_RADIUS_M) -> Column:
    dx = radians(lon2 - lon1) * F.cos(radians((lat1 + lat2) / 2.0))
    dy = radians(lat2 - lat1)
    return F.sqrt(dx * dx + dy * dy) * F.lit(radius)


def haversine_m(lon1, lat1, lon2, lat2) -> Column:
    half_lat = F.sin(radians(lat2 - lat1) / 2.0)
    half_lon = F.sin(radians(lon2 - lon1) / 2.0)
    a = half_lat * half_lat + F.cos(radians(lat1)) * F.cos(radians(lat2)) * half_lon * half_lon
    return F.lit(2.0 * TERRITORY_RADIUS_M) * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def walk_minutes(metres: Column) -> Column:
    return metres / F.lit(METRES_PER_MINUTE)


def straight_leg_minutes(lon1, lat1, lon2, lat2) -> Column:
    return walk_minutes(haversine_m(lon1, lat1, lon2, lat2) * F.lit(DETOUR))


def flat_m(lon1, lat1, lon2, lat2, scale_lat: Column) -> Column:
    """Metres on one local flat projection whose scale is taken at `scale_lat`."""
    dx = (lon2 - lon1) * F.lit(METRES_PER_DEGREE_LON) * F.cos(radians(scale_lat))
    dy = (lat2 - lat1) * F.lit(METRES_PER_DEGREE_LAT)
    return F.sqrt(dx * dx + dy * dy)


# --- image tiles -------------------------------------------------------------------


def mercator_x(lon: Column) -> Column:
    return radians(lon) * F.lit(MERCATOR_RADIUS_M)


def mercator_y(lat: Column) -> Column:
    return F.ln(F.tan(F.lit(0.7853981633974483) + radians(lat) / 2.0)) * F.lit(MERCATOR_RADIUS_M)


def tile_ref(lon: Column, lat: Column, vintage: Column, pixels: int = 640) -> Column:
    """The export address of a square frame; it is the frame's identity everywhere."""
    x, y = F.round(mercator_x(lon), 3), F.round(mercator_y(lat), 3)
    half = TILE_SPAN_M / 2.0
    corners = [F.format_string("%.3f", value) for value in (x - half, y - half, x + half, y + half)]
    return F.concat(
        F.lit(f"{ORTHO_BASE}/Orthos_Natural_"), vintage.cast("string"),
        F.lit("_NJ_WM/MapServer/export?bbox="), F.concat_ws("%2C", *corners),
        F.lit(f"&bboxSR=3857&imageSR=3857&size={pixels}%2C{pixels}&format=png&f=image"),
    )


def ref_bbox(ref: Column) -> Column:
    """The four corner numbers an export address asks for, or NULL."""
    query = F.try_parse_url(ref, F.lit("QUERY"), F.lit("bbox"))
    parts = F.split(F.replace(F.replace(query, F.lit("%2C"), F.lit(",")), F.lit("%2c"), F.lit(",")), ",", -1)
    numbers = F.transform(parts, lambda part: F.trim(part).try_cast("double"))
    whole = (F.size(numbers) == 4) & ~F.exists(numbers, lambda number: number.isNull())
    return F.when(whole, numbers)


# --- polygons ----------------------------------------------------------------------
# A polygon column is array<polygon<ring<point<double>>>>: every geometry is held as
# a multi-polygon, rings closed, points (lon, lat).


def segments(polygons: Column) -> Column:
    """All ring edges as structs, computed once per polygon before any join."""
    rings = F.flatten(polygons)
    return F.flatten(
        F.transform(
            rings,
            lambda ring: F.transform(
                F.sequence(F.lit(1), F.greatest(F.size(ring) - 1, F.lit(1))),
                lambda i: F.struct(
                    F.get(F.get(ring, i - 1), F.lit(0)).alias("x1"),
                    F.get(F.get(ring, i - 1), F.lit(1)).alias("y1"),
                    F.get(F.get(ring, i), F.lit(0)).alias("x2"),
                    F.get(F.get(ring, i), F.lit(1)).alias("y2"),
                ),
            ),
        )
    )


def covered(edges: Column, lon: Column, lat: Column) -> Column:
    """Inside by the even-odd rule, or exactly on an edge."""

    def cross(s):
        return (s.x2 - s.x1) * (lat - s.y1) - (s.y2 - s.y1) * (lon - s.x1)

    on_edge = F.exists(
        edges,
        lambda s: (cross(s) == 0.0)
        & lon.between(F.least(s.x1, s.x2), F.greatest(s.x1, s.x2))
        & lat.between(F.least(s.y1, s.y2), F.greatest(s.y1, s.y2)),
    )
    # The half-open test counts a vertex once; multiplying out avoids a division.
    crossings = F.filter(
        edges,
        lambda s: ((s.y1 > lat) != (s.y2 > lat)) & ((cross(s) > 0.0) == (s.y2 > s.y1)),
    )
    return on_edge | (F.size(crossings) % 2 == 1)


def bounds(edges: Column) -> list[Column]:
    xs = F.flatten(F.transform(edges, lambda s: F.array(s.x1, s.x2)))
    ys = F.flatten(F.transform(edges, lambda s: F.array(s.y1, s.y2)))
    return [
        F.array_min(xs).alias("min_x"), F.array_min(ys).alias("min_y"),
        F.array_max(xs).alias("max_x"), F.array_max(ys).alias("max_y"),
    ]


def _ring_moments(ring: Column, x0: Column, y0: Column) -> Column:
    """Twice the signed area and the first moments of a ring, about a nearby origin."""
    zero = F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("mx"), F.lit(0.0).alias("my"))

    def step(acc, i):
        ax, ay = F.get(F.get(ring, i - 1), F.lit(0)) - x0, F.get(F.get(ring, i - 1), F.lit(1)) - y0
        bx, by = F.get(F.get(ring, i), F.lit(0)) - x0, F.get(F.get(ring, i), F.lit(1)) - y0
        turn = ax * by - bx * ay
        return F.struct(
            (acc.a + turn).alias("a"),
            (acc.mx + (ax + bx) * turn).alias("mx"),
            (acc.my + (ay + by) * turn).alias("my"),
        )

    return F.aggregate(F.sequence(F.lit(1), F.greatest(F.size(ring) - 1, F.lit(1))), zero, step)


def area_centroid(polygons: Column) -> Column:
    """Area centroid as struct<lon, lat>: holes subtract, parts weigh by area; NULL without area."""
    first = F.get(F.get(F.get(polygons, F.lit(0)), F.lit(0)), F.lit(0))
    x0, y0 = F.get(first, F.lit(0)), F.get(first, F.lit(1))
    moments = F.flatten(
        F.transform(
            polygons,
            lambda polygon: F.transform(
                polygon,
                lambda ring, i: F.struct(
                    _ring_moments(ring, x0, y0).alias("m"), F.when(i == 0, 1.0).otherwise(-1.0).alias("sign")
                ),
            ),
        )
    )
    zero = F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("mx"), F.lit(0.0).alias("my"))

    def add(acc, item):
        # Orientation is not trusted: outer rings add, holes subtract, whatever their winding.
        flip = F.when(item.m.a < 0, -1.0).otherwise(1.0) * item.sign
        return F.struct(
            (acc.a + item.m.a * flip).alias("a"),
            (acc.mx + item.m.mx * flip).alias("mx"),
            (acc.my + item.m.my * flip).alias("my"),
        )

    return F.aggregate(
        moments,
        zero,
        add,
        lambda t: F.when(
            t.a != 0.0,
            F.struct((x0 + t.mx / (t.a * 3.0)).alias("lon"), (y0 + t.my / (t.a * 3.0)).alias("lat")),
        ),
    )
