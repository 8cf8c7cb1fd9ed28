"""Session factory and the storage helpers every plan shares."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def get_session(app: str = "talasik", master: str | None = None, **conf: str) -> SparkSession:
    """Session with UTC, ANSI and AQE; `master` only for local use."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false",
    } | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it."""
    home = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    environment = spark.sparkContext.environment
    have = environment.get("PYTHONPATH", "").split(os.pathsep)
    if home not in have:
        environment["PYTHONPATH"] = os.pathsep.join([home, *filter(None, have)])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables of a data folder."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use spark.checkpoint.dir as given; only where it is unset (tests), a temporary folder."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isDefined():
        return
    given = spark.conf.get("spark.checkpoint.dir", None)
    if given is None and not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    context.setCheckpointDir(given or tempfile.mkdtemp(prefix="talasik-ckpt-"))


def cut(df: DataFrame) -> DataFrame:
    """Write `df` to the shared checkpoint folder and read it back: reused results survive lost executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def with_row_ids(df: DataFrame, name: str = "uid") -> DataFrame:
    """`df` with an id of its own for every row, the same wherever the result is used.

    Ids follow partitions and places in them. Those of a scan are fixed; behind an exchange they may turn out
    differently when computed again, so such rows are cut first.
    """
    numbered = df.withColumn(name, F.monotonically_increasing_id())
    fixed = "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
    return numbered if fixed else cut(numbered)


def spread(df: DataFrame, per_core: int = 2) -> DataFrame:
    """Enough partitions to keep every core busy in a Python-heavy stage.

    A scan that already has as many is left alone: at scale this adds no shuffle.
    """
    want = df.sparkSession.sparkContext.defaultParallelism * per_core
    have = df._jdf.queryExecution().toRdd().getNumPartitions()
    return df if have >= want else df.repartition(want)


def default_data_dir() -> str:
    return os.environ.get("TALASIK_DATA", "/root/testdata/sf0.001")
