"""Session settings and durable scratch space."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "tollspan", master: str | None = None, **conf: str) -> SparkSession:
    """Session with adaptive execution on; `conf` overrides any setting."""
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **conf,
    }
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: the cluster's `spark.checkpoint.dir`.

    Only where that setting is absent and all work runs in this process (tests, a laptop) a local
    folder is made and remembered in the session. On a cluster the setting must be there, as its
    executors would not see each other's files.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.conf.get("tollspan.local.scratch", None)
    if not base:
        master = spark.conf.get("spark.master", "")
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="tollspan-")
        atexit.register(shutil.rmtree, base, ignore_errors=True)
        spark.conf.set("tollspan.local.scratch", base)
    return base


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new, unused path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def durable(df: DataFrame) -> DataFrame:
    """Write a result to the shared folder and go on from there.

    Cuts the lineage, survives the loss of executors, and lets later steps read only
    the columns they need.
    """
    spark = df.sparkSession
    path = fresh_path(spark, "step")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, by: str) -> DataFrame:
    """Write a result to the shared folder in buckets of a column and go on from there.

    Like `durable`, but joins and groups by that column read the buckets as they lie: only the other side is shuffled.
    """
    spark = df.sparkSession
    path = fresh_path(spark, "dealt")
    name = f"dealt_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.format("parquet").bucketBy(buckets, by).option("path", path).saveAsTable(name)
    kept = spark.table(name)
    # the catalog forgets the name, the files stay
    spark.sql(f"DROP TABLE {name}")
    return kept


@contextmanager
def swept(spark: SparkSession) -> Iterator[None]:
    """Inside, Spark removes what a query has shuffled once the query is done, instead of when the driver's memory is cleared.

    For chains of steps that are each written (`durable`, `dealt`) or collected, so that none reads those files again.
    """
    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(setting, None)
    spark.conf.set(setting, "true")
    try:
        yield
    finally:
        spark.conf.unset(setting) if before is None else spark.conf.set(setting, before)


def sized(df: DataFrame) -> DataFrame:
    """Materialise a summary table so that Catalyst plans with its measured size.

    A joined summary is then broadcast only when it really is under
    `spark.sql.autoBroadcastJoinThreshold`, and shuffled otherwise.
    """
    kept = df.persist()
    kept.count()
    return kept
