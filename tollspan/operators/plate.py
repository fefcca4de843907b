"""Behaviour vector of each plate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tollspan.functions import scalars as S
from tollspan.skew import halo_copies, seconds_between, time_bucket_id

BUCKET_S = 600
WEIGHTED = [
    "avg_speed_kmh",
    "avg_relative_speed",
    "avg_headway_s",
    "conflict_rate",
    "lane_prop_1",
    "lane_prop_2",
    "lane_prop_3",
]


def follow_measures(
    df: DataFrame, *, max_headway_s: float = 60.0, cut: str | None = None, slot_minutes: int = 5
) -> DataFrame:
    """Per pass: speed relative to the gantry's slot mean, headway and conflict flag.

    Headways above the limit do not count, so the vehicle before is searched only
    that far back. Time buckets with a halo of that length hold all it takes, and
    one shuffle on (gantry, bucket) serves both the headway and the slot mean.
    `cut` names a column, such as the month, across which no vehicle precedes another.
    """
    seconds = max(BUCKET_S, slot_minutes * 60)
    seconds += -seconds % (slot_minutes * 60)
    rows = halo_copies(df, "ts", seconds, max_headway_s).repartition("gantry", "_bucket")
    rows = S.with_slot(rows, minutes=slot_minutes, name="_slot")
    lead_keys = ["gantry", "_bucket", "lane"] + ([cut] if cut else [])
    order = ["ts", "plate", "speed_kmh"] + (["event_id"] if "event_id" in df.columns else [])
    ahead = Window.partitionBy(*lead_keys).orderBy(*order)
    slot = Window.partitionBy("gantry", "_bucket", "_slot", "_counted")
    counted = ~F.col("_context")
    if "overlap" in df.columns:
        counted = counted & ~F.coalesce(F.col("overlap"), F.lit(False))
    rows = rows.withColumn("_counted", counted).select(
        "*",
        F.lag("ts").over(ahead).alias("_prev_ts"),
        F.lag("speed_kmh").over(ahead).alias("_prev_speed"),
        F.avg("speed_kmh").over(slot).alias("_slot_mean"),
    )
    known = F.col("gantry").isNotNull()
    gap = seconds_between("_prev_ts", "ts")
    rows = rows.filter("_counted").withColumn("_gap", F.when(known, gap))
    gap_ok = (F.col("_gap") > 0) & (F.col("_gap") <= max_headway_s)
    rows = rows.withColumn("headway_s", F.when(gap_ok, F.col("_gap"))).withColumn(
        "relative_speed", F.when(known, F.try_divide("speed_kmh", "_slot_mean"))
    )
    return rows.withColumn("conflict", conflict_flag()).select(
        *df.columns, "relative_speed", "headway_s", "conflict"
    )


def conflict_flag() -> Column:
    """1 when the time to collision is strictly below the gantry's limit; NULL without a headway."""
    faster = F.col("speed_kmh") - F.col("_prev_speed")
    ttc = F.when(faster > 0, F.col("headway_s") * F.col("speed_kmh") / faster)
    return F.when(
        F.col("headway_s").isNotNull() & F.col("_prev_speed").isNotNull(),
        F.coalesce((ttc < S.ttc_limit(F.col("gantry"))).cast("int"), F.lit(0)),
    )


def hourly_lanes(df: DataFrame, cut: str | None = None) -> DataFrame:
    """Per pass: hour, lane change inside the hour, and whether it is the hour's first or last pass.

    A plate is ordered hour by hour; `border_changes` adds the changes between hours.
    """
    order = ["ts", "gantry"] + (["event_id"] if "event_id" in df.columns else [])
    rows = df.withColumn("_hour", time_bucket_id("ts", 3600))
    w = Window.partitionBy("plate", "_hour", *([cut] if cut else [])).orderBy(*order)
    before = F.lag("lane").over(w)
    return rows.select(
        "*",
        F.coalesce((F.col("lane") != before).cast("int"), F.lit(0)).alias("lane_change"),
        F.when(before.isNull(), F.col("lane")).alias("_first_lane"),
        F.when(F.lead("lane").over(w).isNull(), F.col("lane")).alias("_last_lane"),
    )


def border_changes(hourly: DataFrame, cut: str | None = None) -> DataFrame:
    """Add to each hour the lane change from the plate's last pass in an earlier hour."""
    w = Window.partitionBy("plate", *([cut] if cut else [])).orderBy("_hour")
    crossed = F.coalesce((F.col("_first_lane") != F.lag("_last_lane").over(w)).cast("int"), F.lit(0))
    return hourly.withColumn("lane_changes", F.col("lane_changes") + crossed)


def _sums() -> list[Column]:
    return [
        F.count(F.lit(1)).alias("total_passes"),
        F.sum("speed_kmh").alias("_speed"),
        *[F.count_if(F.col("lane") == k).alias(f"_lane_{k}") for k in (1, 2, 3)],
        F.sum("relative_speed").alias("_rel"),
        F.count("relative_speed").alias("rel_speed_count"),
        F.sum("headway_s").alias("_hw"),
        F.count("headway_s").alias("headway_count"),
        F.sum("conflict").alias("_conf"),
        F.count("conflict").alias("conflict_count"),
        F.sum("lane_change").alias("lane_changes"),
        F.max("_first_lane").alias("_first_lane"),
        F.max("_last_lane").alias("_last_lane"),
    ]


def _ratios(df: DataFrame) -> DataFrame:
    return (
        df.withColumn("avg_speed_kmh", F.col("_speed") / F.col("total_passes"))
        .withColumns({f"lane_prop_{k}": F.col(f"_lane_{k}") / F.col("total_passes") for k in (1, 2, 3)})
        .withColumn("avg_headway_s", F.try_divide("_hw", "headway_count"))
        .withColumn("avg_relative_speed", F.try_divide("_rel", "rel_speed_count"))
        .withColumn("conflict_rate", F.try_divide("_conf", "conflict_count"))
        .withColumn(
            "lane_change_rate",
            F.coalesce(F.try_divide("lane_changes", F.col("total_passes") - 1), F.lit(0.0)),
        )
    )


def plate_features(
    df: DataFrame,
    *,
    max_headway_s: float = 60.0,
    include_counts: bool = False,
    batch: str | None = None,
    monthly: bool = False,
) -> DataFrame:
    """Behaviour vector per plate, or per plate and batch.

    `batch` is only a grouping column: windows run across batches, so a vehicle or
    lane seen in an earlier batch is still the predecessor. `monthly` instead cuts
    the windows by month and weights the months by passes. Rows with a true
    `overlap` column are seen as predecessors only.
    """
    rows = df.withColumn("_month", S.month_key(F.col("ts"))) if monthly else df
    cut = "_month" if monthly else None
    rows = follow_measures(rows, max_headway_s=max_headway_s, cut=cut)
    keys = ["plate"] + ([batch] if batch else [])
    rows = hourly_lanes(rows, cut)
    # The hour level (a batch or month is a set of hours) keeps any one plate's
    # rows apart until they are summed, and spares the distinct counts an expansion.
    day = F.to_date("ts").alias("_day")
    hourly = rows.groupBy("plate", "_hour", day, *keys[1:], *([cut] if cut else [])).agg(*_sums())
    hourly = border_changes(hourly, cut)
    additive = ["total_passes", "_speed", "_lane_1", "_lane_2", "_lane_3", "_rel", "rel_speed_count", "_hw",
                "headway_count", "_conf", "conflict_count", "lane_changes"]
    active = [
        F.size(F.collect_set("_day")).alias("n_days_active"),
        F.size(F.collect_set(S.iso_week(F.col("_day")))).alias("n_weeks_active"),
        F.size(F.collect_set(F.year("_day") * 100 + F.month("_day"))).alias("n_months_active"),
    ]
    if not monthly:
        out = _ratios(hourly.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in additive], *active))
    else:
        per_month = _ratios(
            hourly.groupBy(*keys, "_month").agg(*[F.sum(c).alias(c) for c in additive], *active)
        )
        weighted = [F.sum(F.col(c) * F.col("total_passes")).alias(f"_w_{c}") for c in WEIGHTED]
        out = per_month.groupBy(*keys).agg(
            *weighted,
            F.sum("total_passes").alias("total_passes"),
            F.sum("lane_changes").alias("lane_changes"),
            F.sum(F.greatest(F.col("total_passes") - 1, F.lit(0))).alias("_moves"),
            *[F.sum(c).alias(c) for c in ("rel_speed_count", "headway_count", "conflict_count")],
            F.sum("n_days_active").cast("int").alias("n_days_active"),
            F.lit(None).cast("int").alias("n_weeks_active"),
            F.count("_month").cast("int").alias("n_months_active"),
        )
        weeks = hourly.groupBy(*keys).agg(
            F.size(F.collect_set(S.iso_week(F.col("_day")))).alias("_weeks")
        )
        out = (
            out.withColumns({c: F.coalesce(F.col(f"_w_{c}"), F.lit(0.0)) / F.col("total_passes") for c in WEIGHTED})
            .withColumn("lane_change_rate", F.coalesce(F.try_divide("lane_changes", "_moves"), F.lit(0.0)))
            .join(weeks, keys)
            .withColumn("n_weeks_active", F.col("_weeks"))
        )
    counts = ["rel_speed_count", "headway_count", "conflict_count"] if include_counts else []
    return out.select(
        *keys,
        "total_passes",
        *WEIGHTED,
        "lane_changes",
        "lane_change_rate",
        "n_days_active",
        "n_weeks_active",
        "n_months_active",
        *counts,
    )


def sorted_features(df: DataFrame) -> DataFrame:
    return df.orderBy(F.desc("total_passes"), "plate")
