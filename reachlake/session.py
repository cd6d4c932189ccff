"""Session helpers: the shared folder for tables that cut lineage, and local sessions for tests."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def local_session(cpus: int = 8, app: str = "reachlake") -> SparkSession:
    """A small session for tests and the bench; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: the session's ``spark.checkpoint.dir``.

    Only a local session without that setting gets a folder of its own.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    path = spark.conf.get("reachlake.local.dir", None)
    if not path:
        path = tempfile.mkdtemp(prefix="reachlake-")
        spark.conf.set("reachlake.local.dir", path)
    return path


def new_table_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_freed(spark: SparkSession):
    """Jobs started inside drop their shuffle files when they end; nobody reads them once the table is written."""
    before = spark.conf.get(FREE_SHUFFLES)
    spark.conf.set(FREE_SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.set(FREE_SHUFFLES, before)


def written(df: DataFrame, label: str = "step") -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts the lineage so that a lost executor costs a re-read and not the whole loop, and gives
    Catalyst the real size of the data for its join choices. The shuffle files of the job go with it.
    """
    spark = df.sparkSession
    path = new_table_path(spark, label)
    with shuffles_freed(spark):
        df.write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def written_observed(df: DataFrame, label: str = "step", **aggs: Column) -> tuple[DataFrame, dict]:
    """Like :func:`written`, with aggregates over the rows taken in the same job."""
    seen = Observation()
    out = written(df.observe(seen, *[c.alias(n) for n, c in aggs.items()]), label)
    return out, dict(seen.get)


def written_with_count(df: DataFrame, label: str = "step") -> tuple[DataFrame, int]:
    """Like :func:`written`; the row count comes from the same job."""
    out, seen = written_observed(df, label, n=F.count(F.lit(1)))
    return out, int(seen["n"])


def written_in_buckets(df: DataFrame, label: str, keys: list[str], buckets: int) -> DataFrame:
    """Like :func:`written`, hashed and sorted by ``keys``, so that joins on them don't shuffle the table again."""
    spark = df.sparkSession
    name = f"{label.replace('-', '_')}_{uuid.uuid4().hex}"
    ready = df.repartition(buckets, *keys).write.bucketBy(buckets, *keys).sortBy(*keys)
    with shuffles_freed(spark):
        ready.option("path", new_table_path(spark, label)).saveAsTable(name)
    return spark.table(name)


def hashed_table(df: DataFrame, label: str, keys: list[str], buckets: int) -> DataFrame:
    """Like :func:`written_in_buckets` for rows that are dealt by ``keys`` already; they are neither shuffled nor ordered by ``keys``."""
    spark = df.sparkSession
    name = f"{label.replace('-', '_')}_{uuid.uuid4().hex}"
    with shuffles_freed(spark):
        df.write.bucketBy(buckets, *keys).option("path", new_table_path(spark, label)).saveAsTable(name)
    return spark.table(name)
