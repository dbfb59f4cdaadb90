"""Suggestions for addresses that name no door: the most alike key by longest matching blocks.

Two keys of T letters together, M of them in matching blocks, are 2M / T alike. The M matched letters stand in the same order in
both, so they make M - 1 neighbouring pairs, and only T - 2M letters are left to stand between them. A pair with nothing between
is a letter pair of both keys; with one letter between, it is a letter pair of one and a gapped pair of the other; at most
(T - 2M) / 2 pairs have more between. So alike keys share marks (letter pairs and gapped pairs) at no fewer than
`2M - 1 - floor(T / 2)` places of the asked key, and an index of marks finds them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doorlens.functions import keys
from doorlens.session import land

_SLACK = 1e-9
_RANGE = "array<struct<x:string,y:string>>"


def block_likeness(first: Column, second: Column) -> Column:
    """Twice the letters in matching blocks over all letters; 1.0 for two empty texts, NULL beside a NULL.

    The longest common block is taken, the earliest of `first` and then of `second` among equals, and the same is done left and
    right of it. Each step works on all open ranges at once; there are no more steps than letters in the shorter text.
    """
    def block(r: Column) -> Column:
        # If a text is common to both, so are its starts: counting the common starts at a place gives the longest.
        def common(i: Column) -> Column:
            return F.size(F.filter(F.sequence(F.lit(1), F.length(r.x) - i + 1), lambda k: F.contains(r.y, F.substring(r.x, i, k))))
        return F.array_max(F.transform(F.sequence(F.lit(1), F.length(r.x)), lambda i: F.struct(common(i).alias("size"), (-i).alias("back"))))

    def sides(b: Column) -> Column:
        at, there = -b.best.back, F.position(F.substring(b.x, -b.best.back, b.best.size), b.y)
        return F.filter(F.array(
            F.struct(F.substring(b.x, F.lit(1), at - 1).alias("x"), F.substring(b.y, F.lit(1), there - 1).alias("y")),
            F.struct(F.substring(b.x, at + b.best.size, F.length(b.x)).alias("x"),
                     F.substring(b.y, there + b.best.size, F.length(b.y)).alias("y")),
        ), lambda r: (r.x != "") & (r.y != ""))

    def step(state: Column, _: Column) -> Column:
        found = F.filter(
            F.transform(state.open, lambda r: F.struct(r.x.alias("x"), r.y.alias("y"), block(r).alias("best"))), lambda b: b.best.size > 0)
        # The blocks are worked out once: a list of one value names them for both uses.
        return F.element_at(F.transform(F.array(found), lambda blocks: F.struct(
            F.flatten(F.transform(blocks, sides)).cast(_RANGE).alias("open"),
            F.aggregate(blocks, state.matched, lambda total, b: total + b.best.size).alias("matched"))), 1)

    whole = F.array(F.struct(first.alias("x"), second.alias("y")))
    start = F.struct(F.filter(whole, lambda r: (r.x != "") & (r.y != "")).cast(_RANGE).alias("open"), F.lit(0).alias("matched"))
    letters = F.length(first) + F.length(second)
    steps = F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.length(first), F.length(second))))
    matched = F.aggregate(steps, start, step, lambda state: state.matched)
    return F.when(letters == 0, 1.0).when(letters > 0, 2.0 * matched / letters)


# --- how many marks alike keys share -----------------------------------------------------------


def _matched_at_least(likeness: Column, letters: Column) -> Column:
    return F.ceil(likeness * letters / 2.0 - _SLACK)


def _shared_places(likeness: Column, letters: Column) -> Column:
    return 2 * _matched_at_least(likeness, letters) - 1 - F.floor(letters / 2.0)


def _can_be_alike(likeness: Column) -> Column:
    """By length alone: the matched letters all fit into the shorter key."""
    n, m = F.length("address_key"), F.length("known_key")
    return _matched_at_least(likeness, n + m) <= F.least(n, m)


def _place_marks(key: Column, gap: int) -> Column:
    """The letter (or gapped) pair that starts at each place, in order."""
    last = F.length(key) - 1 - gap
    pair = lambda i: F.concat(F.substring(key, i, F.lit(1)), F.substring(key, i + 1 + gap, F.lit(1)))
    return F.when(last >= 1, F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), pair)).otherwise(F.array().cast("array<string>"))


def _marks(df: DataFrame, key: str) -> DataFrame:
    return df.withColumns({"pairs": _place_marks(F.col(key), 0), "gapped": _place_marks(F.col(key), 1)})


def _known_marks(known: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, mark, known_key, place): pairs as they are, gapped ones with a dash between, once per place."""
    def placed(marks, prefix):
        return F.transform(marks, lambda v, i: F.struct(F.concat(F.lit(prefix), v).alias("mark"), (i + 1).alias("place")))
    return known.select(*by, "known_key", F.inline(F.concat(placed(F.col("pairs"), "2"), placed(F.col("gapped"), "3"))))


def _asked_marks(asked: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, address_key, place, mark): what a known key would hold if the neighbouring matched letters at `place` were its own."""
    held = F.concat(
        F.transform("pairs", lambda v, i: F.struct((i + 1).alias("place"), F.concat(F.lit("2"), v).alias("mark"))),
        F.transform("pairs", lambda v, i: F.struct((i + 1).alias("place"), F.concat(F.lit("3"), v).alias("mark"))),
        F.transform("gapped", lambda v, i: F.struct((i + 1).alias("place"), F.concat(F.lit("2"), v).alias("mark"))),
    )
    return asked.select(*by, "address_key", F.inline(held))


def _shared() -> Column:
    """The places of the asked key whose marks the known key holds anywhere."""
    hits = F.size(F.filter(
        F.sequence(F.lit(0), F.greatest(F.size("pairs") - 1, F.lit(0))),
        lambda i: F.array_contains("known_pairs", F.get("pairs", i)) | F.array_contains("known_gapped", F.get("pairs", i))
        | F.coalesce(F.array_contains("known_pairs", F.get("gapped", i)), F.lit(False)),
    ))
    return F.when(F.size("pairs") > 0, hits).otherwise(0)


def _with_shared(pairs: DataFrame, asked: DataFrame, known: DataFrame, by: Sequence[str]) -> DataFrame:
    other = known.select(*by, "known_key", F.col("pairs").alias("known_pairs"), F.col("gapped").alias("known_gapped"))
    return pairs.join(asked, [*by, "address_key"]).join(other, [*by, "known_key"]).withColumn("shared", _shared())


def _compared(pairs: DataFrame, asked: DataFrame, known: DataFrame, by: Sequence[str]) -> DataFrame:
    """Candidates (by, address_key, known_key) that pass the count of shared places, with their likeness."""
    enough = _shared_places(F.col("at_least"), F.length("address_key") + F.length("known_key"))
    left = _with_shared(pairs, asked, known, by).filter(F.col("shared") >= enough).select(*by, "address_key", "known_key")
    # Few bytes and much work: pairs are dealt evenly over all tasks, also those of one asked key.
    dealt = left.repartition(int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return dealt.withColumn("likeness", block_likeness(F.col("known_key"), F.col("address_key")))


def candidates(asked: DataFrame, known: DataFrame, floor: float = 0.6, by: Sequence[str] = ("territory_id",), tries: int = 2) -> dict[str, DataFrame]:
    """Candidate pairs of `suggestions` in its two rounds: `first`, one for each asked key, and `second`, all that could still win."""
    by = list(by)
    asked = land(_marks(asked.select(*by, "address_key").filter("address_key != ''").distinct(), "address_key"), "asked-keys")
    known = land(_marks(known.select(*by, "known_key").filter("known_key != ''").distinct(), "known_key"), "known-keys")
    index = land(_known_marks(known, by), "known-marks")
    seen = index.groupBy(*by, "mark").agg(F.count(F.lit(1)).alias("seen"))
    marks = _asked_marks(asked, by).join(seen, [*by, "mark"], "left").na.fill(0, ["seen"])
    # The places of an asked key, rarest first: a list as long as one address.
    ranked = land(marks.groupBy(*by, "address_key", "place").agg(F.sum("seen").alias("seen")).groupBy(*by, "address_key").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("seen", "place"))), lambda e: e.place).alias("places")), "rare-places")

    def met(taken: DataFrame) -> DataFrame:
        """Pairs and each taken place of the asked key (`here`) where they share a mark no further away than unmatched letters allow."""
        n, m = F.length("address_key"), F.length("known_key")
        here = taken.select(*by, "address_key", "at_least", F.explode("places").alias("here"))
        looked = _asked_marks(asked, by).withColumnRenamed("place", "here").join(here, [*by, "address_key", "here"])
        apart = F.greatest(n, m) - _matched_at_least(F.col("at_least"), n + m)
        return (
            looked.join(index, [*by, "mark"]).filter(_can_be_alike(F.col("at_least")) & (F.abs(F.col("here") - F.col("place")) <= apart))
            .select(*by, "address_key", "known_key", "at_least", "here").distinct()
        )

    least = F.lit(float(floor)).alias("at_least")
    rare = met(ranked.select(*by, "address_key", F.slice("places", 1, tries).alias("places"), least))
    nearest = F.struct("shared", -F.abs(F.length("address_key") - F.length("known_key")), "known_key")
    first = _with_shared(rare.drop("here").distinct(), asked, known, by).groupBy(*by, "address_key").agg(
        F.max_by("known_key", nearest).alias("known_key")).withColumn("at_least", F.lit(float(floor)))
    won = land(_compared(first, asked, known, by).groupBy(*by, "address_key").agg(
        F.max("likeness").alias("won")).filter(F.col("won") >= floor), "first-likeness")
    # All but the commonest places: one of the shared ones stays, however short the other key may be.
    n = F.length("address_key")
    shortest = n + F.ceil(n * F.col("at_least") / (2.0 - F.col("at_least")) - _SLACK)
    surely = F.ceil((F.col("at_least") - 0.5) * shortest - 1.0 - _SLACK)
    kept = F.size("places") - F.greatest(surely, F.lit(1)) + 1
    wanted = asked.select(*by, "address_key").join(won, [*by, "address_key"], "left").withColumn("at_least", F.coalesce("won", F.lit(float(floor))))
    second = met(wanted.join(ranked, [*by, "address_key"]).select(
        *by, "address_key", F.slice("places", F.lit(1), F.greatest(kept, F.lit(0)).cast("int")).alias("places"), "at_least")).drop("here")
    # Keys so short that they may share no place meet on a letter; there are as many as short texts.
    def letters(df, key):
        return df.withColumn("letter", F.explode(F.array_distinct(F.split(F.col(key), ""))))
    few = _shared_places(F.col("at_least"), F.length("address_key") + F.length("known_key")) <= 0
    unsure = 2.0 / (2.0 * floor - 1.0) if floor > 0.5 else None
    def short(df, key):
        return df if unsure is None else df.filter(F.length(key) <= unsure)
    brief = (
        letters(short(wanted, "address_key"), "address_key").join(letters(short(known.select(*by, "known_key"), "known_key"), "known_key"), [*by, "letter"])
        .filter(few & _can_be_alike(F.col("at_least"))).select(*by, "address_key", "known_key", "at_least")
    )
    return {"asked": asked, "known": known, "first": first, "second": second.unionByName(brief).distinct()}


def suggestions(asked: DataFrame, known: DataFrame, floor: float = 0.6, by: Sequence[str] = ("territory_id",), tries: int = 2) -> DataFrame:
    """(by, address_key, suggested_key, likeness): the most alike known key at or above `floor`, the later key among equals.

    `asked` has (by, address_key), `known` (by, known_key); empty and NULL keys are left out. The answer is that of comparing
    every asked key with every known one. A first round takes, of the known keys met at an asked key's `tries` rarest
    places, the one that shares most places. Its likeness is what another key has to reach, so the second round leaves the commonest places alone: a key with one
    letter wrong is looked up by its two or three rarest.
    """
    parts = candidates(asked, known, floor, by, tries)
    found = _compared(parts["second"], parts["asked"], parts["known"], list(by))
    best = found.groupBy(*by, "address_key").agg(F.max(F.struct("likeness", F.col("known_key").alias("suggested_key"))).alias("best"))
    return best.select(*by, "address_key", "best.suggested_key", "best.likeness").filter(F.col("likeness") >= floor)


def suggest_doors(
    requests: DataFrame, doors: DataFrame, address: str = "address", floor: float = 0.6, by: Sequence[str] = ("territory_id",)
) -> DataFrame:
    """The most alike short address key of the same territory for each asked-for address; see `suggestions`."""
    asked = keys.with_address_key(requests, address)
    known = doors.select(*by, keys.street_address_key(F.col("situs")).alias("known_key"))
    return suggestions(asked, known, floor, by)
