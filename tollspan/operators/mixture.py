"""Cluster mixture of the traffic at each gantry and interval."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tollspan.functions import scalars as S
from tollspan.operators.flow import deltas_where_present, with_deltas
from tollspan.session import sized

# Metric name and the column that holds it.
METRICS = {
    "share": "share",
    "flow": "flow_per_hour",
    "speed": "speed_mean",
    "density": "density",
    "delta_speed": "delta_speed",
    "delta_density": "delta_density",
}


def label_table(labels: DataFrame) -> DataFrame:
    """One label per normalised plate (the smallest)."""
    return (
        labels.select(S.normalise_plate(F.col("plate")).alias("plate"), "cluster_label")
        .filter(F.col("plate").isNotNull() & F.col("cluster_label").isNotNull())
        .groupBy("plate")
        .agg(F.min("cluster_label").alias("cluster_label"))
    )


def _labelled_input(df: DataFrame) -> DataFrame:
    return df.withColumn("plate", S.normalise_plate(F.col("plate"))).filter(
        F.col("plate").isNotNull() & F.col("ts").isNotNull() & F.col("gantry").isNotNull()
    )


def attach_labels(df: DataFrame, labels: DataFrame) -> DataFrame:
    """Detections of labelled plates, row by row; Spark splits the partition of a very frequent plate."""
    return _labelled_input(df).join(sized(label_table(labels)), "plate")


def labelled_slots(df: DataFrame, labels: DataFrame, minutes: int) -> DataFrame:
    """Detections and sums of speeds per gantry, interval and label.

    Detections are summed by plate, gantry and interval first, so a plate brings a row an interval to the join
    however often it passes.
    """
    slots = S.with_slot(_labelled_input(df), minutes=minutes)
    summed = slots.groupBy("plate", S.strip(F.col("gantry")).alias("gantry"), "interval_start").agg(
        F.count(F.lit(1)).alias("n"), F.sum("speed_kmh").alias("speed_sum"), F.count("speed_kmh").alias("n_speed")
    )
    return summed.join(sized(label_table(labels)), "plate").drop("plate")


def mixture_core(df: DataFrame, labels: DataFrame, minutes: int = 5, lanes: int = 1) -> DataFrame:
    """Count, share, hourly flow, mean speed and density per gantry, interval and label."""
    grouped = labelled_slots(df, labels, minutes).groupBy("gantry", "interval_start", "cluster_label").agg(
        F.sum("n").alias("n"), F.try_divide(F.sum("speed_sum"), F.sum("n_speed")).alias("speed_mean")
    )
    total = grouped.groupBy("gantry", "interval_start").agg(F.sum("n").alias("total"))
    per_hour = F.col("n") * (60.0 / max(1, minutes)) / max(1, lanes)
    return (
        grouped.join(total, ["gantry", "interval_start"])
        .withColumn("share", F.col("n") / F.col("total"))
        .withColumn("flow_per_hour", per_hour)
        .withColumn("density", F.coalesce(S.density(F.col("flow_per_hour"), F.col("speed_mean")), F.lit(0.0)))
    )


def mixture_deltas(core: DataFrame, **kw) -> DataFrame:
    return with_deltas(
        core, ["gantry", "cluster_label"], {"delta_speed": "speed_mean", "delta_density": "density"}, **kw
    )


def mixture_entropy(core: DataFrame) -> DataFrame:
    return core.groupBy("gantry", "interval_start").agg(
        F.sum(S.entropy_term(F.col("share"))).alias("cluster_entropy")
    )


def label_suffix(label: int) -> str:
    return f"neg_{-label}" if label < 0 else str(label)


def mixture_matrix(
    df: DataFrame,
    labels: DataFrame,
    label_list: Sequence[int],
    metrics: Sequence[str] = tuple(METRICS),
    entropy: bool = True,
    minutes: int = 5,
    lanes: int = 1,
) -> DataFrame:
    """Gantry x interval matrix with one block of label columns per metric.

    `label_list` names every label there is. The labels are conditional aggregates, so
    after the label join one shuffle makes the matrix.
    """
    rows = labelled_slots(df, labels, minutes)
    names = {k: label_suffix(k) for k in label_list}
    cells = []
    for k, c in names.items():
        hit = F.col("cluster_label") == k
        mean = F.try_divide(F.sum(F.when(hit, F.col("speed_sum"))), F.sum(F.when(hit, F.col("n_speed"))))
        cells += [F.coalesce(F.sum(F.when(hit, F.col("n"))), F.lit(0)).alias(f"_n_{c}"), mean.alias(f"_speed_{c}")]
    out = rows.groupBy("gantry", "interval_start").agg(F.sum("n").alias("_total"), *cells)
    for c in names.values():
        present = F.col(f"_n_{c}") > 0
        per_hour = F.col(f"_n_{c}") * (60.0 / max(1, minutes)) / max(1, lanes)
        out = out.withColumns(
            {
                f"_share_{c}": F.when(present, F.col(f"_n_{c}") / F.col("_total")),
                f"_flow_{c}": F.when(present, per_hour),
            }
        ).withColumn(
            f"_density_{c}", F.when(present, F.coalesce(S.density(F.col(f"_flow_{c}"), F.col(f"_speed_{c}")), F.lit(0.0)))
        )
    if any(m.startswith("delta") for m in metrics):
        wanted = {f"_delta_{m}_{c}": f"_{m}_{c}" for m in ("speed", "density") for c in names.values()}
        out = deltas_where_present(out, ["gantry"], wanted)
    columns = [F.coalesce(f"_{m}_{c}", F.lit(0.0)).alias(f"cluster_{m}_{c}") for m in metrics for c in names.values()]
    if entropy:
        parts = [S.entropy_term(F.coalesce(f"_share_{c}", F.lit(0.0))) for c in names.values()]
        columns.append(sum(parts, F.lit(0.0)).alias("cluster_entropy"))
    return out.select("gantry", "interval_start", *columns)


def pivoted_deltas(matrix: DataFrame, label_list: Sequence[int]) -> DataFrame:
    """Deltas over the pivoted columns of a gantry: an absent cluster counts as 0."""
    values = {
        f"cluster_delta_{m}_{label_suffix(k)}": f"cluster_{m}_{label_suffix(k)}"
        for m in ("speed", "density")
        for k in label_list
    }
    return with_deltas(matrix, ["gantry"], values)
