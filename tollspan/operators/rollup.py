"""Calendar batches and their roll-up to plates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tollspan.functions import scalars as S
from tollspan.operators.plate import WEIGHTED, plate_features


def _day(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd")


def batch_ranges(df: DataFrame, mode: str = "month", split_months: bool = False) -> DataFrame:
    """Half-open calendar batches that cover a table's time range: months or Monday weeks."""
    span = df.agg(F.to_date(F.min("ts")).alias("a"), F.to_date(F.max("ts")).alias("b")).filter("a IS NOT NULL")
    if mode == "month":
        starts = span.select(
            F.explode(F.sequence(F.trunc("a", "month"), F.trunc("b", "month"), F.expr("INTERVAL 1 MONTH"))).alias("s")
        )
        out = starts.select("s", F.add_months("s", 1).alias("e"), F.date_format("s", "yyyy-MM").alias("batch_label"))
    elif mode == "week":
        weeks = span.select(
            F.explode(F.sequence(F.trunc("a", "week"), F.trunc("b", "week"), F.expr("INTERVAL 7 DAYS"))).alias("s")
        ).withColumn("e", F.date_add("s", 7))
        if split_months:
            turn = F.add_months(F.trunc("s", "month"), 1)
            parts = F.when(
                turn < F.col("e"),
                F.array(
                    F.struct(F.col("s").alias("s"), turn.alias("e")), F.struct(turn.alias("s"), F.col("e").alias("e"))
                ),
            ).otherwise(F.array(F.struct(F.col("s").alias("s"), F.col("e").alias("e"))))
            weeks = weeks.select(F.explode(parts).alias("p")).select("p.s", "p.e")
        out = weeks.select(
            "s", "e", F.concat(_day(F.col("s")), F.lit("_to_"), _day(F.date_sub("e", 1))).alias("batch_label")
        )
    else:
        raise ValueError("mode must be 'month' or 'week'")
    return out.select(
        "batch_label", F.col("s").cast("timestamp_ntz").alias("batch_start"), F.col("e").cast("timestamp_ntz").alias("batch_end")
    )


def batch_start(ts: Column, mode: str = "month", split_months: bool = False) -> Column:
    """First day of the batch a time falls in; no join with the ranges is needed."""
    if mode == "month":
        return F.trunc(F.to_date(ts), "month")
    week = F.trunc(F.to_date(ts), "week")
    return F.greatest(week, F.trunc(F.to_date(ts), "month")) if split_months else week


def features_by_batch(df: DataFrame, mode: str = "month", split_months: bool = False, **kw) -> DataFrame:
    """Behaviour vector per plate and calendar batch.

    One job: the batch only groups. Windows are not cut by it, so the vehicle ahead
    and the previous lane carry over from one batch to the next.
    """
    rows = df.withColumn("batch_start", batch_start(F.col("ts"), mode, split_months))
    return plate_features(rows, batch="batch_start", include_counts=True, **kw)


def roll_up(batches: DataFrame, mode: str = "month", keys: tuple[str, ...] = ("plate",)) -> DataFrame:
    """Batches to plates: speed and lanes weighted by passes, the other means by their own counts."""

    def weighted(value: str, weight: str) -> Column:
        return F.try_divide(F.sum(F.col(value) * F.col(weight)), F.sum(weight))

    passes = F.sum("total_passes")
    changes = F.sum("lane_changes")
    return batches.groupBy(*keys).agg(
        passes.alias("total_passes"),
        weighted("avg_speed_kmh", "total_passes").alias("avg_speed_kmh"),
        weighted("avg_relative_speed", "rel_speed_count").alias("avg_relative_speed"),
        weighted("avg_headway_s", "headway_count").alias("avg_headway_s"),
        weighted("conflict_rate", "conflict_count").alias("conflict_rate"),
        *[weighted(f"lane_prop_{k}", "total_passes").alias(f"lane_prop_{k}") for k in (1, 2, 3)],
        changes.alias("lane_changes"),
        F.coalesce(F.try_divide(changes, passes - 1), F.lit(0.0)).alias("lane_change_rate"),
        F.sum("n_days_active").alias("n_days_active"),
        F.sum("n_weeks_active" if mode == "week" else "n_months_active").alias(
            "n_weeks_active" if mode == "week" else "n_months_active"
        ),
        *[F.sum(c).alias(c) for c in ("rel_speed_count", "headway_count", "conflict_count")],
    )


def roll_up_monthly(batches: DataFrame) -> DataFrame:
    """Months to plates, every mean weighted by passes; months without a value still count in full."""
    passes = F.sum("total_passes")
    moves = F.sum(F.greatest(F.col("total_passes") - 1, F.lit(0)))
    return batches.groupBy("plate").agg(
        passes.alias("total_passes"),
        *[(F.coalesce(F.sum(F.col(c) * F.col("total_passes")), F.lit(0.0)) / passes).alias(c) for c in WEIGHTED],
        F.sum("lane_changes").alias("lane_changes"),
        F.coalesce(F.try_divide(F.sum("lane_changes"), moves), F.lit(0.0)).alias("lane_change_rate"),
        F.sum("n_days_active").alias("n_days_active"),
    )


def weeks_to_months(batches: DataFrame) -> DataFrame:
    """Month-split weekly batches to plate-months, keyed by the month a batch starts in."""
    months = roll_up(
        batches.withColumn("month", S.month_key(F.col("batch_start").cast("timestamp_ntz"))), "week", ("plate", "month")
    )
    return months.withColumn("n_months_active", F.lit(1).cast("bigint"))
