"""Session settings the jobs rely on, and the checkpoint folder they cut lineage with."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


#: How much larger rows are in memory than in Parquet files. Spark takes a file's bytes for its rows' bytes otherwise, and sends
#: joins' sides of some hundred MB through the driver because their files are under the broadcast limit.
ROWS_TO_FILE = {"spark.sql.sources.fileCompressionFactor": "16.0"}


def sized_by_rows(spark: SparkSession) -> None:
    """Joins are planned by the size of rows, unless the session names a factor of its own; AQE still broadcasts what it measures as small."""
    for key, value in ROWS_TO_FILE.items():
        if spark.conf.get(key) == "1.0":
            spark.conf.set(key, value)


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "doorlens") -> SparkSession:
    """A local session for tests and the bench; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    )
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of the cluster; a scratch folder only where none is named.

    A local master has no other executors to lose, so a temporary folder is safe
    there. On a cluster a missing setting is an error, not a guess.
    """
    sized_by_rows(spark)
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not configured:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        configured = tempfile.mkdtemp(prefix="spark-")
    context.setCheckpointDir(configured)
    return configured


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write `df` to the checkpoint folder and read it back, so later rounds do not replay it."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


@contextmanager
def hot_joins_split(spark: SparkSession):
    """AQE splits a hot key of a join here even where a grouping by that key follows, which costs one more shuffle there and then."""
    name = "spark.sql.adaptive.forceOptimizeSkewedJoin"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def land(df: DataFrame, name: str) -> DataFrame:
    """Write `df` as a table under the checkpoint folder and read it back.

    For a result several outputs are derived from: each then reads only the columns it needs,
    and nothing upstream runs again when an executor is lost.
    """
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/landed-{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)
