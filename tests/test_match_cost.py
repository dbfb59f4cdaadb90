"""Address keys of permit lists: one reading of a line, one key per distinct location, every record kept."""

from pyspark.sql import functions as F

from doorlens.functions import keys
from doorlens.operators import history


def test_line_is_read_once(spark):
    plan = spark.range(1).select(F.lit("x").alias("a"), F.rand().cast("string").alias("line")).select(keys.portal_address_key(F.col("line")))
    assert plan._jdf.queryExecution().analyzed().toString().split("\n")[0].count("line#") == 1


def test_every_record_is_kept(spark):
    records = [(1, n, at, False, "", "") for n, at in enumerate(["1 Oak St", "1 Oak St", None, "2 Elm Ave", "9 None Rd", ""])] + [
        (None, 10, "1 Oak St", False, "", ""), (None, 11, None, False, "", ""), (2, 12, "1 Oak St", False, "", "")]
    doors = [(1, "a", "1 OAK STREET"), (1, "b", "2 Elm Avenue"), (1, "c", "2 ELM AVE"), (2, "d", "3 Oak St"), (1, "e", None)]
    got = history.match_permits(
        spark.createDataFrame(records, "territory_id int, ordinal int, location string, has_detail boolean, work_description string, comments string"),
        spark.createDataFrame(doors, "territory_id int, pams_pin string, address string"))
    want = {0: ("matched", "a"), 1: ("matched", "a"), 3: ("ambiguous", None)}
    assert sorted((r.ordinal, r.outcome, r.pams_pin) for r in got.collect()) == sorted(
        (r[1], *want.get(r[1], ("unmatched", None))) for r in records)
