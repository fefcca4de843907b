"""Trips, segments, headways and macroscopic metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tollspan.functions import geo as G
from tollspan.functions import scalars as S
from tollspan.session import durable
from tollspan.skew import (
    exact_quantiles,
    previous_row,
    seconds_between,
    time_bucket_id,
)

# Rules that end a trip.
MAX_GAP_S = 3600.0
MAX_JUMP_KM = 50.0
MAX_SPEED_KMH = 160.0
MIN_SPEED_KMH = 5.0


_CARRIED = ("ts", "km", "speed_kmh", "gantry", "lane")


def _ends_trip(ts, km, prev_ts, prev_km, before_km):
    """Whether a row ends a trip, from its own place, that of the row before and the km of the one before that."""
    gap = F.expr(f"timestampdiff(MICROSECOND, {prev_ts}, {ts}) / 1000000.0D")
    step = F.expr(f"{km} - {prev_km}")
    sign, before = F.signum(F.coalesce(step, F.lit(0.0))), F.signum(F.coalesce(F.expr(f"{prev_km} - {before_km}"), F.lit(0.0)))
    speed = F.try_divide(F.abs(step), gap) * 3600
    ends = (
        gap.isNull()
        | (gap > MAX_GAP_S)
        | (F.abs(step) > MAX_JUMP_KM)
        | (speed > MAX_SPEED_KMH)
        | (speed < MIN_SPEED_KMH)
        | ((gap == 0) & (F.abs(step) > 0))
        | ((sign != before) & (sign != 0) & (before != 0))
    )
    return F.coalesce(ends, F.lit(False))


def trajectories(passes: DataFrame, *, bucket_s: int = 3600) -> DataFrame:
    """Cut each plate's passes into trips.

    A trip ends at a long gap, a long jump, an impossible or very low implied speed, or a change of direction.
    Every plate is cut into buckets of time, so no plate is too much for a task. One sort a bucket gives each row the
    two before it. A summary row a bucket (first two and last two rows, trip ends behind them) tells the
    next bucket what came before and how many trips there were.
    """
    key = ["plate", "_bucket"]
    inside = Window.partitionBy(*key).orderBy("ts", "gantry")
    own = F.struct(*[F.col(c).alias(c) for c in _CARRIED])
    rows = passes.withColumn("_bucket", time_bucket_id("ts", bucket_s)).select(
        "*", F.row_number().over(inside).alias("_at"), F.lag(own).over(inside).alias("_p"), F.lag("km", 2).over(inside).alias("_km2")
    )
    local = (F.col("_at") > 2) & _ends_trip("ts", "km", "_p.ts", "_p.km", "_km2")
    rows = rows.withColumn("_ends", local.cast("int"))

    def at(n: int):
        return F.max(F.when(F.col("_at") == n, own))

    last = F.max(F.struct("_at", own.alias("row"), "_p"))
    summary = rows.groupBy(*key).agg(at(1).alias("one"), at(2).alias("two"), last.alias("last"), F.sum("_ends").alias("inner"))
    line = Window.partitionBy("plate").orderBy("_bucket")
    carry = summary.select(
        "*", F.lag("last").over(line).alias("_l1"), F.lag("last", 2).over(line).alias("_l2")
    ).withColumn("_b2", F.coalesce("_l1._p.km", "_l2.row.km"))
    carry = carry.withColumns(
        {
            "_e1": _ends_trip("one.ts", "one.km", "_l1.row.ts", "_l1.row.km", "_b2").cast("int"),
            "_e2": F.when(F.col("two").isNotNull(), _ends_trip("two.ts", "two.km", "one.ts", "one.km", "_l1.row.km").cast("int")).otherwise(0),
        }
    )
    before = F.sum(F.col("_e1") + F.col("_e2") + F.col("inner")).over(line.rowsBetween(Window.unboundedPreceding, -1))
    carry = carry.select(*key, F.col("_l1.row").alias("_c"), "_e1", "_e2", F.coalesce(before, F.lit(0)).alias("_trips"))
    counted = F.sum("_ends").over(inside.rowsBetween(Window.unboundedPreceding, 0))
    joined = rows.withColumn("_run", counted).join(carry, key)
    prev = F.coalesce("_p", "_c")
    ends = F.when(F.col("_at") == 1, F.col("_e1")).when(F.col("_at") == 2, F.col("_e2")).otherwise(F.col("_ends"))
    number = F.col("_trips") + F.col("_e1") + F.when(F.col("_at") > 1, F.col("_e2")).otherwise(0) + F.col("_run")
    out = joined.withColumns({"_prev": prev, "trip_break": ends == 1, "trip_no": number})
    out = out.withColumns({f"prev_{c}": F.col(f"_prev.{c}") for c in _CARRIED})
    out = out.withColumns({"delta_t_s": seconds_between("prev_ts", "ts"), "delta_km": F.col("km") - F.col("prev_km")})
    return out.select(
        *passes.columns, *[f"prev_{c}" for c in _CARRIED], "delta_t_s", "delta_km",
        (F.try_divide(F.abs("delta_km"), F.col("delta_t_s")) * 3600).alias("implied_kmh"), "trip_break", "trip_no",
        F.concat_ws("_", "plate", F.col("trip_no").cast("string")).alias("trip_id"),
    )


def segments(traj: DataFrame) -> DataFrame:
    """Movements between consecutive passes of a trip.

    Inside a trip the previous pass of the plate is the previous pass of the trip, so
    no further window is needed.
    """
    rows = traj.filter(~F.col("trip_break") & (F.col("delta_t_s") > 0))
    dist = F.abs("delta_km")
    changed = F.coalesce(F.col("prev_lane") != F.col("lane"), F.lit(False))
    return rows.select(
        "plate",
        "trip_id",
        F.concat_ws("→", "prev_gantry", "gantry").alias("segment_id"),
        F.col("prev_gantry").alias("start_gantry"),
        F.col("gantry").alias("end_gantry"),
        F.col("prev_ts").alias("start_time"),
        F.col("ts").alias("end_time"),
        "delta_t_s",
        (F.col("delta_t_s") / 60).alias("travel_time_min"),
        "delta_km",
        dist.alias("distance_km"),
        (dist / F.col("delta_t_s") * 3600).alias("avg_speed_kmh"),
        (F.col("speed_kmh") - F.col("prev_speed_kmh")).alias("speed_change_kmh"),
        G.acceleration(F.col("prev_speed_kmh"), F.col("speed_kmh"), dist).alias("accel_m_s2"),
        F.col("prev_lane").alias("start_lane"),
        F.col("lane").alias("end_lane"),
        changed.cast("int").alias("lane_change"),
        F.col("prev_km").alias("start_km"),
        F.col("km").alias("end_km"),
        "carriageway",
        "category",
    )


def headways(passes: DataFrame) -> DataFrame:
    """Seconds and metres to the vehicle before at each gantry and lane; zero gaps are kept.

    There are few gantries and lanes, so each is cut into ten-minute buckets.
    """
    rows = passes.filter(F.col("gantry").isNotNull() & F.col("lane").isNotNull()).withColumn(
        "_bucket", time_bucket_id("ts", 600)
    )
    rows = previous_row(rows, ["gantry", "lane"], ["ts", "plate", "event_id"], ["ts"])
    gap = seconds_between("prev_ts", "ts")
    return rows.filter(F.col("prev_ts").isNotNull()).select(
        "event_id", "plate", "gantry", "lane", "ts", gap.alias("headway_s"), (gap * F.col("speed_kmh") / 3.6).alias("headway_m"), "speed_kmh"
    )


def macro_metrics(segs: DataFrame, minutes: int = 15) -> DataFrame:
    """Speed, travel time and density per section and time window.

    A group holds one window's traffic on one section; equal values are merged before the shuffle.
    """
    rows = S.with_slot(segs, "start_time", minutes, "window_start")
    per_hour = F.col("vehicle_count") * (60.0 / minutes)
    return (
        rows.groupBy("start_gantry", "end_gantry", "window_start")
        .agg(
            F.count("plate").alias("vehicle_count"),
            F.avg("avg_speed_kmh").alias("mean_speed_kmh"),
            F.stddev_samp("avg_speed_kmh").alias("std_speed_kmh"),
            F.percentile("avg_speed_kmh", F.array(F.lit(0.05), F.lit(0.5), F.lit(0.95))).alias("_q"),
            F.avg("travel_time_min").alias("mean_travel_time_min"),
            F.percentile("travel_time_min", F.lit(0.95)).alias("p95_travel_time_min"),
        )
        .withColumns({f"{n}_speed_kmh": F.col("_q")[i] for i, n in enumerate(("p05", "p50", "p95"))})
        .withColumn("density_veh_per_km", S.density(per_hour, F.col("mean_speed_kmh"), None))
        .drop("_q")
    )


def vehicle_profiles(passes: DataFrame, segs: DataFrame) -> DataFrame:
    """Maximum speed, class, acceleration, deceleration and driver imperfection per plate.

    The segments are worked out once; what each figure needs of them is read back.
    """
    segs = durable(segs.select("plate", "accel_m_s2", "lane_change"))
    speed = exact_quantiles(passes, ["plate"], "speed_kmh", {"max_speed_kmh": 0.95})
    per_class = passes.filter(F.col("category").isNotNull()).groupBy("plate", "category").agg(F.count(F.lit(1)).alias("n"))
    mode = per_class.groupBy("plate").agg(
        (-F.max(F.struct("n", (-F.col("category")).alias("c")))["c"]).alias("vehicle_class")
    )
    up = exact_quantiles(segs.filter("accel_m_s2 > 0"), ["plate"], "accel_m_s2", {"_up": 0.9})
    down = segs.filter("accel_m_s2 < 0").select("plate", F.abs("accel_m_s2").alias("a"))
    down = exact_quantiles(down, ["plate"], "a", {"_down": 0.9})
    moves = segs.groupBy("plate").agg(F.avg("lane_change").alias("_rate"))
    out = speed.join(mode, "plate", "left").join(up, "plate", "left").join(down, "plate", "left").join(moves, "plate", "left")
    cls = F.col("vehicle_class")
    return out.select(
        F.concat(F.lit("vt_"), S.safe_id(F.col("plate"))).alias("profile_id"),
        "plate",
        "vehicle_class",
        S.template_name(cls).alias("template"),
        "max_speed_kmh",
        F.coalesce("_up", S.template_value(cls, "accel")).alias("accel"),
        F.coalesce("_down", S.template_value(cls, "decel")).alias("decel"),
        F.least(
            F.lit(1.2), S.template_value(cls, "sigma") + F.coalesce("_rate", F.lit(0.0)) * 0.4
        ).alias("sigma"),
        S.template_value(cls, "length").alias("length"),
        S.template_value(cls, "min_gap").alias("min_gap"),
        S.template_value(cls, "v_class").alias("v_class"),
    )


def trips(traj: DataFrame, edges: DataFrame) -> DataFrame:
    """One row per trip of two or more passes whose gantries all lie on known edges.

    Kilometres only rise or only fall inside a trip, so a trip never has more passes
    than there are gantries, and its ordered list stays short.
    """
    base = traj.agg(F.min("ts").alias("t")).first()["t"]
    rows = traj.join(edges.select("gantry", "edge_id", "pos_m"), "gantry", "left")
    stops = F.sort_array(
        F.collect_list(F.struct("ts", "gantry", "edge_id", "pos_m", "lane", "speed_kmh", "category"))
    )
    out = (
        rows.groupBy("plate", "trip_id")
        .agg(stops.alias("s"), F.bool_and(F.col("edge_id").isNotNull()).alias("_known"))
        .filter(F.col("_known") & (F.size("s") >= 2))
    )
    first, last = F.col("s")[0], F.element_at("s", -1)
    lane = F.greatest(first["lane"].cast("int") - 1, F.lit(0))
    started = first["ts"]
    return out.withColumn("_t0", F.lit(base).cast("timestamp_ntz")).withColumn("_start", started).select(
        "trip_id",
        "plate",
        first["category"].alias("category"),
        F.greatest(seconds_between("_t0", "_start"), F.lit(0.0)).alias("depart_s"),
        first["edge_id"].alias("from_edge"),
        last["edge_id"].alias("to_edge"),
        F.transform(F.slice("s", F.lit(2), F.size("s") - 2), lambda p: p["edge_id"]).alias("via_edges"),
        F.when(first["lane"].isNotNull(), lane.cast("string")).alias("depart_lane"),
        F.coalesce(first["pos_m"], F.lit(0.0)).alias("depart_pos"),
        (first["speed_kmh"] / 3.6).alias("depart_speed"),
    )


def trips_with_types(trip_table: DataFrame, profiles: DataFrame) -> DataFrame:
    """The plate's own profile, else the template of its class."""
    out = trip_table.join(profiles.select("plate", "profile_id"), "plate", "left")
    return out.withColumn("vehicle_type", F.coalesce("profile_id", S.template_name(F.col("category")))).drop("profile_id")


def departure_summary(trip_table: DataFrame) -> DataFrame:
    return trip_table.agg(
        F.count(F.lit(1)).alias("n_trips"), F.min("depart_s").alias("first_depart_s"), F.max("depart_s").alias("last_depart_s")
    )


def trajectory_bundle(passes: DataFrame, minutes: int = 15) -> dict[str, DataFrame]:
    """All tables of a run; passes and trajectories are read several times and so written once."""
    passes = durable(passes)
    traj = durable(trajectories(passes))
    segs = segments(traj)
    return {
        "passes": passes,
        "trajectories": traj,
        "segments": segs,
        "headways": headways(passes),
        "macro": macro_metrics(segs, minutes),
    }


def run_summary(bundle: dict[str, DataFrame]) -> DataFrame:
    """Rows of each table of a run, and its trips."""
    parts = None
    for name, df in bundle.items():
        n = df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows")
        parts = n if parts is None else parts.unionByName(n)
    n_trips = bundle["trajectories"].filter("trip_break").agg(F.count(F.lit(1)).alias("n_rows"))
    return parts.unionByName(n_trips.select(F.lit("trips").alias("table_name"), "n_rows"))
