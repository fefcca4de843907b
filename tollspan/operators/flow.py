"""Flow, speed and density by gantry, interval and vehicle class."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tollspan.functions import scalars as S

LABELS = ("Light", "Heavy", "Motorcycles")
# Metric name and the column that holds it.
METRICS = {
    "flow": "flow_per_hour",
    "speed": "speed_mean",
    "speed_std": "speed_std",
    "density": "density",
    "delta_speed": "delta_speed",
    "delta_density": "delta_density",
}


def flow_core(df: DataFrame, minutes: int = 5, lanes: int = 1, labels: Sequence[str] | None = None) -> DataFrame:
    """Count, mean and deviation of speed, hourly flow and density per gantry, interval and class."""
    rows = (
        df.select(
            "ts",
            F.col("speed_kmh").cast("double").alias("speed_kmh"),
            S.strip(F.col("gantry")).alias("gantry"),
            S.category_label(F.col("category").cast("int")).alias("class_label"),
        )
        .filter(F.col("speed_kmh").isNotNull() & F.col("gantry").isNotNull() & F.col("class_label").isNotNull())
    )
    if labels:
        rows = rows.filter(F.col("class_label").isin(*labels))
    grouped = (
        S.with_slot(rows, minutes=minutes)
        .groupBy("gantry", "interval_start", "class_label")
        .agg(
            F.count(F.lit(1)).alias("flow_count"),
            F.avg("speed_kmh").alias("speed_mean"),
            F.coalesce(F.stddev_samp("speed_kmh"), F.lit(0.0)).alias("speed_std"),
        )
    )
    per_hour = F.col("flow_count") * (60.0 / max(1, minutes)) / max(1, lanes)
    return grouped.withColumn("flow_per_hour", per_hour).withColumn(
        "density", S.density(F.col("flow_per_hour"), F.col("speed_mean"))
    )


def with_deltas(
    df: DataFrame,
    keys: Sequence[str],
    values: dict[str, str],
    *,
    reset_by: str | None = None,
    adjacent_minutes: int | None = None,
) -> DataFrame:
    """Difference to the previous present interval (`{output: input}`), 0 for the first.

    `reset_by` starts anew in each batch; `adjacent_minutes` counts only the interval just before.
    """
    part = [*keys, reset_by] if reset_by else list(keys)
    w = Window.partitionBy(*part).orderBy("interval_start")
    usable = F.lit(True)
    if adjacent_minutes:
        earlier = F.lag("interval_start").over(w)
        usable = earlier == F.expr(f"timestampadd(MINUTE, -{adjacent_minutes}, interval_start)")
    return df.withColumns(
        {out: F.coalesce(F.when(usable, F.col(src) - F.lag(src).over(w)), F.lit(0.0)) for out, src in values.items()}
    )


def flow_with_deltas(df: DataFrame, minutes: int = 5, lanes: int = 1, **kw) -> DataFrame:
    return with_deltas(
        flow_core(df, minutes, lanes),
        ["gantry", "class_label"],
        {"delta_speed": "speed_mean", "delta_density": "density"},
        **kw,
    )


def deltas_where_present(df: DataFrame, keys: Sequence[str], values: dict[str, str]) -> DataFrame:
    """Deltas of pivoted columns (`{output: input}`) to the last interval that had a value; 0 without one."""
    earlier = Window.partitionBy(*keys).orderBy("interval_start").rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumns(
        {
            out: F.coalesce(F.col(src) - F.last(src, ignorenulls=True).over(earlier), F.lit(0.0))
            for out, src in values.items()
        }
    )


def flow_matrix(
    df: DataFrame,
    minutes: int = 5,
    lanes: int = 1,
    metrics: Sequence[str] = ("flow", "speed", "density"),
    labels: Sequence[str] = LABELS,
) -> DataFrame:
    """Gantry x interval matrix with one block of class columns per metric.

    The classes are conditional aggregates, so one shuffle makes the matrix; deltas add
    one by gantry over the far smaller matrix.
    """
    rows = df.select(
        "ts",
        F.col("speed_kmh").cast("double").alias("speed_kmh"),
        S.strip(F.col("gantry")).alias("gantry"),
        S.category_label(F.col("category").cast("int")).alias("class_label"),
    ).filter(
        F.col("speed_kmh").isNotNull() & F.col("gantry").isNotNull() & F.col("class_label").isin(*labels)
    )
    names = {label: label.lower() for label in labels}
    cells = []
    for label, c in names.items():
        hit = F.col("class_label") == label
        speed = F.when(hit, F.col("speed_kmh"))
        cells += [F.count_if(hit).alias(f"_n_{c}"), F.avg(speed).alias(f"_speed_{c}"), F.stddev_samp(speed).alias(f"_std_{c}")]
    out = S.with_slot(rows, minutes=minutes).groupBy("gantry", "interval_start").agg(*cells)
    for c in names.values():
        # an absent class has no value here, which the deltas look past; it becomes 0 below
        flow = F.when(F.col(f"_n_{c}") > 0, F.col(f"_n_{c}") * (60.0 / max(1, minutes)) / max(1, lanes))
        out = out.withColumn(f"_flow_{c}", flow).withColumn(
            f"_density_{c}", S.density(F.col(f"_flow_{c}"), F.col(f"_speed_{c}"))
        )
    if any(m.startswith("delta") for m in metrics):
        wanted = {f"_delta_{m}_{c}": f"_{m}_{c}" for m in ("speed", "density") for c in names.values()}
        out = deltas_where_present(out, ["gantry"], wanted)
    source = {"speed_std": "std"}
    return out.select(
        "gantry",
        "interval_start",
        *[
            F.coalesce(f"_{source.get(m, m)}_{c}", F.lit(0.0)).alias(f"{m}_{c}")
            for m in metrics
            if m in METRICS
            for c in names.values()
        ],
    )
