"""Append-only result tables and run histories."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tollspan.session import fresh_path


def append_results(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def append_history(df: DataFrame, path: str) -> None:
    """One JSON line per run."""
    df.write.mode("append").json(path)


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a history; a line that is no JSON keeps its text in `raw` and has no run id."""
    lines = spark.read.text(path)
    return lines.select(
        F.get_json_object("value", "$.run_id").alias("run_id"),
        F.get_json_object("value", "$.run_ts").alias("run_ts"),
        F.col("value").alias("raw"),
    )


def without_runs(history: DataFrame, run_ids: Sequence[str] | DataFrame) -> DataFrame:
    """History without some runs; unreadable lines are kept."""
    if isinstance(run_ids, DataFrame):
        return history.join(run_ids.select("run_id"), "run_id", "left_anti")
    return history.filter(F.col("run_id").isNull() | ~F.col("run_id").isin(*run_ids))


def delete_runs(spark: SparkSession, path: str, run_ids: Sequence[str]) -> str:
    """Write the history without some runs to a new folder and return it."""
    out = fresh_path(spark, "history")
    without_runs(read_history(spark, path), run_ids).select(F.col("raw").alias("value")).write.text(out)
    return out


def latest_best(df: DataFrame, metric: str = "metric", ts: str = "run_ts", tie: str = "run_id") -> DataFrame:
    """Row of the highest metric, the latest on ties."""
    return df.filter(F.col(metric).isNotNull()).orderBy(F.desc(metric), F.desc(ts), F.desc(tie)).limit(1)


def latest_per(df: DataFrame, keys: Sequence[str], ts: str = "run_ts", tie: str = "run_id") -> DataFrame:
    """Latest run of each key, such as the run that wrote a label file."""
    rest = [c for c in df.columns if c not in keys]
    last = df.groupBy(*keys).agg(F.max(F.struct(ts, tie, F.struct(*rest).alias("_r"))).alias("_m"))
    return last.select(*keys, *[F.col(f"_m._r.{c}").alias(c) for c in rest])
