"""Walking routes for many requests at once.

Every round moves each route one door on. Doors lie in cells that know their scores; a route looks
into the cells that could hold its best next door, and the best affordable one is a combinable
minimum. Only the small state is written each round.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doorlens.functions import geo, keys
from doorlens.operators.filters import routable
from doorlens.operators.publish import reason_chips
from doorlens.operators.spatial import within_reach
from doorlens.session import land

# Fixed values.
CONTRACT = "v2"
DISCLOSURE = "Walking times are straight-line estimates (x1.3 detour at 3 mph), not turn-by-turn directions."
NETWORK_DISCLOSURE = (
    "Walking times follow the streets between the parcels, at 3 mph — estimated from parcel geometry, not turn-by-turn directions.")
HOOKS = {
    "tenure": "Have you been here long?",
    "churn": "Who do you usually call when something on the house needs doing?",
    "pool": "Do you have a pool or anything out back?",
    "house": "How old's the house, do you know?",
    "default": "Are you the one who deals with the house stuff, or is that somebody else?",
}
ANGLE_OF = {
    "capacity_acs_dual_income_prior": "default", "capacity_cap_adjustment": "default",
    "capacity_local_relative_value": "default", "capacity_territory_percentile": "default",
    "fit_cap_adjustment": "house", "fit_condition_decline": "tenure", "fit_condition_superseded": "churn",
    "fit_home_age": "house", "fit_lot": "house", "fit_pool": "pool", "fit_roof_age": "churn", "fit_solar": "pool",
    "mover_invalid_sale": "tenure", "mover_recency": "tenure", "project_active": "churn",
    "project_cap_adjustment": "churn", "project_completed": "churn", "project_neutralized": "churn",
    "rental_registration": "default", "rental_stale": "default",
}


def current_requests(requests: DataFrame, current: str = CONTRACT) -> tuple[DataFrame, DataFrame]:
    """(requests to plan, refresh rows): a request made under another contract gets no stops."""
    version = F.coalesce("score_contract_version", F.lit(current))
    stale = requests.filter(version != current).select(
        "route_id", F.lit(True).alias("refresh_required"), F.lit(current).alias("score_contract_version")
    )
    return requests.filter(version == current), stale


def scored_cells(doors: DataFrame, per_cell: int = 12) -> tuple[DataFrame, DataFrame]:
    """(doors with their cell, cells with their doors' box and scores), both written.

    A territory's cells are as large as hold `per_cell` of its doors on average. `scores` lists a cell's scores with their
    number of doors, highest first: what is still the best of a cell once some of its doors are gone can be read off it.
    """
    placed = routable(doors)
    extent = placed.groupBy("territory_id").agg(
        F.count(F.lit(1)).alias("n"), (F.max("lon") - F.min("lon")).alias("width"), (F.max("lat") - F.min("lat")).alias("height"))
    area = F.greatest("width", F.lit(1e-6)) * F.greatest("height", F.lit(1e-6)) * per_cell / F.col("n")
    sized = extent.select("territory_id", F.pow(F.lit(2.0), F.ceil(F.log2(F.sqrt(area)))).alias("side"))
    dealt = land(placed.join(sized, "territory_id").withColumns({
        "gx": F.floor(F.col("lon") / F.col("side")).cast("bigint"), "gy": F.floor(F.col("lat") / F.col("side")).cast("bigint")}).drop("side"), "route-doors")
    cell = ["territory_id", "gx", "gy"]
    held = dealt.groupBy(*cell, "score").agg(
        F.count(F.lit(1)).alias("n"), *[f(c).alias(f"{f.__name__}_{c}") for c in ("lon", "lat") for f in (F.min, F.max)])
    cells = held.groupBy(*cell).agg(
        F.reverse(F.array_sort(F.collect_list(F.struct("score", "n")))).alias("scores"),
        *[f(f"{f.__name__}_{c}").alias(f"{f.__name__}_{c}") for c in ("lon", "lat") for f in (F.min, F.max)])
    half = geo.haversine_m(F.col("min_lon"), F.col("min_lat"), F.col("max_lon"), F.col("max_lat")) / 2.0 + 1.0
    cells = cells.withColumns({"lon": (F.col("min_lon") + F.col("max_lon")) / 2, "lat": (F.col("min_lat") + F.col("max_lat")) / 2, "half_m": half})
    return dealt, land(cells, "route-cells")


def _best_left(scores: Column, gone: Column) -> Column:
    """The highest score of a cell after any `gone` of its doors are left out; null if none need be left."""
    zero = F.struct(F.lit(0).cast("bigint").alias("seen"), F.lit(None).cast("double").alias("best"))
    return F.aggregate(scores, zero, lambda acc, x: F.struct(
        (acc.seen + x.n).alias("seen"), F.when(acc.best.isNull() & (acc.seen + x.n > gone), x.score.cast("double")).otherwise(acc.best).alias("best"))).best


def promising_cells(state: DataFrame, cells: DataFrame, gone: DataFrame | None, networked: bool) -> DataFrame:
    """The cells in which each route's best next door can lie: state columns with gx, gy.

    A cell's nearest side bounds score per minute from above, its farthest corner and a score that is surely still there from
    below. Cells whose upper bound is under the best lower bound of the route are left. A leg along streets has no such lower
    bound; there the budget alone leaves cells out.
    """
    per_minute = F.lit(geo.METRES_PER_MINUTE / (1.0 / 1.01 if networked else geo.DETOUR))
    widest = cells.groupBy("territory_id").agg(F.max("half_m").alias("half_m"))
    reach = (F.col("budget") - F.col("elapsed")) * per_minute * 1.001 + F.col("half_m") + 1.0
    centres = state.join(widest, "territory_id").withColumns({"reach_m": reach, "lon": F.col("at_lon"), "lat": F.col("at_lat")}).drop("half_m")
    pairs = within_reach(land(centres, "route-centres"), cells)
    degree = geo.TERRITORY_RADIUS_M * geo.DEGREE

    def metres(across: Column, down: Column, lat: Column) -> Column:
        return F.sqrt(F.pow(across * F.cos(geo.radians(lat)), 2) + down * down) * degree

    gap = [F.greatest(F.col(f"min_{c}") - F.col(f"at_{c}"), F.col(f"at_{c}") - F.col(f"max_{c}"), F.lit(0.0)) for c in ("lon", "lat")]
    span = [F.greatest(F.abs(F.col(f"at_{c}") - F.col(f"min_{c}")), F.abs(F.col(f"max_{c}") - F.col(f"at_{c}"))) for c in ("lon", "lat")]
    lats = [F.abs("at_lat"), F.abs("min_lat"), F.abs("max_lat")]
    near = metres(*gap, F.least(F.greatest(*lats), F.lit(90.0))) * 0.999 / per_minute
    far = metres(*span, F.when(F.signum("min_lat") * F.signum("at_lat") <= 0, F.lit(0.0)).otherwise(F.least(*lats))) * 1.001 / per_minute
    pairs = pairs.withColumns({"near": near, "far": far}).filter(F.col("elapsed") + F.col("near") <= F.col("budget"))
    if networked:
        return pairs.select(*state.columns, "gx", "gy")
    left = F.lit(0)
    if gone is not None:
        pairs = pairs.join(gone, ["route_id", "gx", "gy"], "left")
        left = F.coalesce("gone", F.lit(0))
    infinite = F.lit(float("inf"))
    sure = _best_left(F.col("scores"), left)
    pairs = pairs.withColumns({
        "most": F.when(F.col("near") == 0.0, infinite).otherwise(F.get("scores", F.lit(0)).score / F.col("near")),
        "least": F.when(F.col("elapsed") + F.col("far") <= F.col("budget"), F.when(F.col("far") == 0.0, infinite).otherwise(sure / F.col("far")))})
    floor = pairs.groupBy("route_id").agg(F.max("least").alias("floor"))
    return pairs.join(floor, "route_id").filter("floor is null or most >= floor * (1.0 - 1e-9)").select(*state.columns, "gx", "gy")


def _gone(doors: DataFrame, stops: DataFrame | None, exclude: DataFrame | None) -> DataFrame | None:
    """(route_id, gx, gy, gone): how many doors of a cell a route may not visit (again); a door named twice counts twice, which is safe."""
    named = [x.select("route_id", "pams_pin") for x in (stops, exclude) if x is not None]
    if not named:
        return None
    every = named[0] if len(named) == 1 else named[0].unionByName(named[1])
    return every.join(doors.select("pams_pin", "gx", "gy"), "pams_pin").groupBy("route_id", "gx", "gy").agg(F.count(F.lit(1)).alias("gone"))


def plan_routes(
    requests: DataFrame,
    doors: DataFrame,
    exclude: DataFrame | None = None,
    access: DataFrame | None = None,
    walk: DataFrame | None = None,
    max_rounds: int = 1_000_000,
) -> DataFrame:
    """Stops of every request: (route_id, stop, pams_pin, score, walk_minutes, cumulative_minutes).

    `requests` hold route_id, territory_id, lon, lat, hours and optionally max_doors; `doors` hold
    territory_id, pams_pin, score, lon, lat. Each step takes the most score per minute among the
    doors whose leg still fits, a door underfoot first, ties by pin. `exclude` leaves doors out and plans anew: those of
    (route_id, pams_pin), or without route_id for all routes. With `access` (pams_pin, node, frontage_m; and start_node,
    start_frontage_m on the requests) and `walk` (source, node, metres), legs follow the network
    where it joins the two points.

    The search is best first over cells: a round looks into those cells only whose best score, at their nearest side, could beat
    what is sure elsewhere. No table of requests and doors is kept. What a round brings is read back from files, whose size Spark knows:
    it is then what a join sends, not the doors.
    """
    networked = walk is not None
    if exclude is not None and "route_id" not in exclude.columns:
        doors, exclude = doors.join(exclude.select("pams_pin").distinct(), "pams_pin", "left_anti"), None
    dealt, cells = scored_cells(doors)
    if exclude is not None:
        exclude = exclude.select("route_id", "pams_pin").distinct()

    cap = F.col("max_doors") if "max_doors" in requests.columns else F.lit(None)
    keys_ = ["route_id", "territory_id"]
    state = requests.select(
        *keys_, F.col("lon").alias("at_lon"), F.col("lat").alias("at_lat"), F.lit(0.0).alias("elapsed"),
        (F.greatest(F.col("hours"), F.lit(0.0)) * 60.0).alias("budget"),
        F.greatest(F.coalesce(cap.cast("bigint"), F.lit(2**62)), F.lit(0)).alias("cap"),
        *([F.col("start_node").alias("at_node"), F.col("start_frontage_m").alias("at_frontage")] if networked else []),
    ).filter("at_lon is not null and at_lat is not null")
    stops = None
    for number in range(1, max_rounds + 1):
        open_ = state.filter(F.col("cap") >= number)
        asked = land(promising_cells(open_, cells, _gone(dealt, stops, exclude), networked), "route-asked")
        legs = asked.join(dealt, ["territory_id", "gx", "gy"])
        for left in (stops, exclude):
            if left is not None:
                legs = legs.join(left.select("route_id", "pams_pin"), ["route_id", "pams_pin"], "left_anti")
        straight = geo.haversine_m(F.col("at_lon"), F.col("at_lat"), F.col("lon"), F.col("lat")) * geo.DETOUR
        metres = straight
        if networked:
            legs = legs.join(access.select("pams_pin", "node", "frontage_m"), "pams_pin", "left")
            along = walk.select(F.col("source").alias("at_node"), "node", F.col("metres").alias("along"))
            legs = legs.join(along, ["at_node", "node"], "left")
            same = (F.col("lon") == F.col("at_lon")) & (F.col("lat") == F.col("at_lat"))
            metres = F.when(same, F.lit(0.0)).otherwise(F.coalesce(F.col("at_frontage") + F.col("along") + F.col("frontage_m"), straight))
        legs = legs.withColumn("walk_minutes", geo.walk_minutes(metres)).filter(
            F.col("elapsed") + F.col("walk_minutes") <= F.col("budget")
        )
        merit = F.when(F.col("walk_minutes") == 0.0, F.lit(float("-inf"))).otherwise(-F.col("score") / F.col("walk_minutes"))
        picked = ["pams_pin", "score", "lon", "lat", "walk_minutes"] + (["node", "frontage_m"] if networked else [])
        chosen = land(
            legs.groupBy(*keys_, "elapsed", "budget", "cap").agg(
                F.min_by(F.struct(*picked), F.struct(merit.alias("m"), F.col("pams_pin").alias("p"))).alias("c")
            ).select(
                *keys_, F.lit(number).alias("stop"), "c.*", (F.col("elapsed") + F.col("c.walk_minutes")).alias("cumulative_minutes"),
                "budget", "cap",
            ), "route-stops"
        )
        if chosen.isEmpty():
            break
        made = chosen.select("route_id", "stop", "pams_pin", "score", "walk_minutes", "cumulative_minutes")
        stops = made if stops is None else stops.unionByName(made)
        state = chosen.select(
            *keys_, F.col("lon").alias("at_lon"), F.col("lat").alias("at_lat"),
            F.col("cumulative_minutes").alias("elapsed"), "budget", "cap",
            *([F.col("node").alias("at_node"), F.col("frontage_m").alias("at_frontage")] if networked else []),
        )
    else:
        raise RuntimeError(f"routes did not end in {max_rounds} stops")
    if stops is None:
        spark = requests.sparkSession
        return spark.createDataFrame(
            [], "route_id bigint, stop int, pams_pin string, score int, walk_minutes double, cumulative_minutes double"
        )
    return stops


def describe_stops(
    requests: DataFrame, stops: DataFrame, doors: DataFrame, evidence: DataFrame, company: str, scripts: DataFrame | None = None,
    access: DataFrame | None = None, paths: DataFrame | None = None, nodes: DataFrame | None = None,
) -> DataFrame:
    """Stops as a rep needs them: address, reason chip, opening line with its branches, the line of the leg, and what the minutes rest on.

    `doors` hold pams_pin, situs, lon, lat and evidence_type, `evidence` the scored entries the chip is chosen from, `scripts` (angle,
    branch, trigger, line) what follows an answer. With `access`, `paths` (source, node, place, at) and `nodes` (id, lon, lat),
    legs that the network joins are drawn along it; others are a straight line from the place before.
    """
    chips = reason_chips(evidence).select("pams_pin", "reason_chip")
    told = talk_tracks(stops.join(doors.select("pams_pin", "situs", "lon", "lat", "evidence_type"), "pams_pin").join(chips, "pams_pin", "left"), company)
    if scripts is None:
        told = told.withColumn("branches", F.array().cast("array<struct<branch:string,trigger:string,line:string>>"))
    else:
        lines = scripts.groupBy("angle").agg(F.array_sort(F.collect_list(F.struct("branch", "trigger", "line"))).alias("branches"))
        told = told.join(lines, "angle", "left")
    point = lambda lon, lat: F.array(F.col(lon), F.col(lat))
    start = requests.select("route_id", point("lon", "lat").alias("start"), *([F.col("start_node")] if access is not None else []))
    before = told.select("route_id", (F.col("stop") + 1).alias("stop"), F.col("pams_pin").alias("from_pin"), point("lon", "lat").alias("from_point"))
    legs = told.join(start, "route_id").join(before, ["route_id", "stop"], "left").withColumns(
        {"from_point": F.coalesce("from_point", "start"), "to_point": point("lon", "lat")})
    straight = F.array("from_point", "to_point")
    if access is None:
        drawn = legs.withColumns({"path": straight, "disclosure": F.lit(DISCLOSURE)})
    else:
        node = access.select("pams_pin", "node")
        ends = legs.join(node, "pams_pin", "left").join(node.toDF("from_pin", "from_node"), "from_pin", "left").withColumn(
            "source", F.when(F.col("from_pin").isNull(), F.col("start_node")).otherwise(F.col("from_node")))
        asked = ends.select("source", "node").distinct()
        placed = paths.join(asked, ["source", "node"]).join(nodes.select(F.col("id").alias("at"), F.array("lon", "lat").alias("xy")), "at")
        line = placed.groupBy("source", "node").agg(F.array_sort(F.collect_list(F.struct("place", "xy"))).alias("line"))
        drawn = ends.join(line, ["source", "node"], "left").withColumns({
            "path": F.when(F.col("line").isNull(), straight).otherwise(F.concat(F.array("from_point"), F.transform("line", lambda x: x.xy), F.array("to_point"))),
            "disclosure": F.lit(NETWORK_DISCLOSURE)})
    return drawn.select(
        "route_id", "stop", "pams_pin", F.col("situs").alias("address"), "score", "walk_minutes", "cumulative_minutes", "reason_chip", "talk_track",
        "branches", "path", "disclosure")


def route_summary(requests: DataFrame, stops: DataFrame) -> DataFrame:
    """One row per route: stops, minutes and the mean score, NULL without stops."""
    totals = stops.groupBy("route_id").agg(
        F.count(F.lit(1)).alias("stops"), F.max("cumulative_minutes").alias("total_minutes"),
        F.avg("score").alias("average_score"),
    )
    return requests.select("route_id").join(totals, "route_id", "left").select(
        "route_id", F.coalesce("stops", F.lit(0)).alias("stops"),
        F.coalesce("total_minutes", F.lit(0.0)).alias("total_minutes"), "average_score",
    )


def talk_tracks(stops: DataFrame, company: str, scripts: DataFrame | None = None) -> DataFrame:
    """Adds the opening line of each stop by its evidence type; an unmapped type takes the default angle.

    `stops` hold evidence_type and situs. `scripts` (angle, branch, trigger, line) is the caller's own
    wording of what follows the answer; the angle names are those of HOOKS.
    """
    angles = F.create_map(*[F.lit(x) for pair in ANGLE_OF.items() for x in pair])
    hooks = F.create_map(*[F.lit(x) for pair in HOOKS.items() for x in pair])
    angle = F.coalesce(F.try_element_at(angles, F.coalesce("evidence_type", F.lit(""))), F.lit("default"))
    opened = stops.withColumn("angle", angle).withColumn(
        "talk_track",
        F.concat(
            F.lit(f"Hey, I'm with {company} — we're doing work for a few of your neighbors here on "),
            keys.spoken_street(F.col("situs")), F.lit(" this week. "), F.try_element_at(hooks, F.col("angle")),
        ),
    )
    return opened if scripts is None else opened.join(scripts, "angle", "left")
