"""Section features, accident targets and accident statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tollspan.functions import scalars as S
from tollspan.skew import floor_div, micros, running_totals

SECTION = ["gantry_last", "gantry_next"]


def combine_features(flow: DataFrame, mixture: DataFrame) -> DataFrame:
    """Flow matrix with the cluster columns; numbers absent become 0. A base that has them is reused."""
    if any(c.startswith("cluster_") for c in flow.columns):
        out = flow
    else:
        out = flow.join(mixture, ["gantry", "interval_start"], "left")
    return out.fillna(0)


def prefixed(df: DataFrame, prefix: str, keep: Sequence[str] = ("interval_start",)) -> DataFrame:
    return df.select(*[F.col(c) if c in keep else F.col(c).alias(prefix + c) for c in df.columns])


def section_matrix(sections: DataFrame, features: DataFrame) -> DataFrame:
    """Features of both ends of each section in the same interval."""
    last = prefixed(features, "last_").withColumnRenamed("last_gantry", "gantry_last")
    nxt = prefixed(features, "next_").withColumnRenamed("next_gantry", "gantry_next")
    return sections.join(last, "gantry_last").join(nxt, ["gantry_next", "interval_start"])


def accident_slots(accidents: DataFrame, minutes: int = 5) -> DataFrame:
    """Distinct gantry and interval before each accident."""
    known = accidents.filter(F.col("last_gantry").isNotNull() & F.col("event_time").isNotNull())
    slot = S.with_slot(known, "event_time", minutes, "_slot")
    return slot.select(
        S.strip(F.col("last_gantry")).alias("gantry"), F.expr(f"timestampadd(MINUTE, -{minutes}, _slot)").alias("interval_start")
    ).distinct()


def add_target(features: DataFrame, accidents: DataFrame, minutes: int = 5) -> DataFrame:
    """1 where an accident follows in the next interval of the gantry, else 0."""
    key = "gantry" if "gantry" in features.columns else "gantry_last"
    pairs = accident_slots(accidents, minutes).withColumnRenamed("gantry", key).withColumn("target", F.lit(1))
    out = features.join(pairs, [key, "interval_start"], "left")
    return out.withColumn("target", F.coalesce("target", F.lit(0)))


def with_match_slot(accidents: DataFrame, minutes: int = 5) -> DataFrame:
    """Add `interval_start`, the interval before the accident; NULL without a time."""
    floor = micros("event_time") - F.pmod(micros("event_time"), F.lit(minutes * 60_000_000))
    return accidents.withColumn("_us", floor - F.lit(minutes * 60_000_000)).withColumn(
        "interval_start", F.expr("timestampadd(MICROSECOND, _us, TIMESTAMP_NTZ'1970-01-01 00:00:00')")
    ).drop("_us")


def accidents_with_features(accidents: DataFrame, features: DataFrame, matched: bool = True) -> DataFrame:
    """Accidents that have, or have not, a feature row."""
    keys = features.select(F.col("gantry").alias("last_gantry"), "interval_start")
    return with_match_slot(accidents).join(keys, ["last_gantry", "interval_start"], "left_semi" if matched else "left_anti")


def match_status(accidents: DataFrame, features: DataFrame, minutes: int = 5) -> DataFrame:
    """Why an accident has, or lacks, a feature row; the first reason that holds."""
    keys = features.select(F.col("gantry").alias("last_gantry"), "interval_start").distinct().withColumn("_hit", F.lit(True))
    gantries = features.select(F.col("gantry").alias("last_gantry")).distinct().withColumn("_seen", F.lit(True))
    span = features.agg(F.min("interval_start").alias("a"), F.max("interval_start").alias("b")).first()
    rows = with_match_slot(accidents, minutes).join(keys, ["last_gantry", "interval_start"], "left").join(
        gantries, "last_gantry", "left"
    )
    outside = F.lit(False)
    if span["a"] is not None:
        end = F.lit(span["b"]).cast("timestamp_ntz") + F.expr(f"INTERVAL {minutes} MINUTES")
        outside = (F.col("event_time") < F.lit(span["a"]).cast("timestamp_ntz")) | (F.col("event_time") > end)
    status = (
        F.when(F.col("_hit"), "matched")
        .when(F.col("event_time").isNull(), "no time")
        .when(F.col("last_gantry").isNull(), "no gantry")
        .when(outside, "out of range")
        .when(F.col("_seen").isNull(), "gantry absent")
        .otherwise("interval absent")
    )
    return rows.withColumn("status", status).drop("_hit", "_seen")


def status_counts(statuses: DataFrame) -> DataFrame:
    return statuses.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def accidents_per_section(sections: DataFrame, accidents: DataFrame) -> DataFrame:
    """Every section with its accident count, 0 included."""
    n = accidents.groupBy(
        F.col("last_gantry").alias("gantry_last"), F.col("next_gantry").alias("gantry_next")
    ).agg(F.count(F.lit(1)).alias("n_accidents"))
    return sections.join(n, SECTION, "left").withColumn("n_accidents", F.coalesce("n_accidents", F.lit(0).cast("bigint")))


def section_ranges(matrix: DataFrame, sections: DataFrame, accidents: DataFrame) -> DataFrame:
    """Feature date range and accident total of each section that has features."""
    span = matrix.groupBy(*SECTION).agg(
        F.min("interval_start").alias("feature_min"), F.max("interval_start").alias("feature_max")
    )
    meta = accidents_per_section(sections, accidents).select("axis", "carriageway", *SECTION, "n_accidents")
    return meta.join(span, SECTION)


def densest_windows(accidents: DataFrame, ranges: DataFrame, window_days: Sequence[float]) -> DataFrame:
    """Per section and window length: the window, starting at an accident, with most accidents.

    The end is inclusive, the window ends within the section's feature range, and the
    earliest start wins. A window's count is the number of accidents up to its end less
    those before its start, both read off one running count, so a section with very many
    accidents is cut into hours like any hot key.
    """
    day = 86_400_000_000
    times = (
        accidents.select(
            F.col("last_gantry").alias("gantry_last"), F.col("next_gantry").alias("gantry_next"), "event_time"
        )
        .join(ranges.select(*SECTION, "feature_min", "feature_max"), SECTION)
        .filter(F.col("event_time").between(F.col("feature_min"), F.col("feature_max")))
        .withColumns({"_t": micros("event_time"), "_end": micros("feature_max")})
        .groupBy(*SECTION, "_t", "_end")
        .agg(F.count(F.lit(1)).alias("_w"))
    )
    # kind 0 reads the count before equal times, kind 1 is data, kind 2 reads after them
    def mark(at: Column, kind: int, add: Column, length: Column) -> Column:
        return F.struct(at.alias("_at"), F.lit(kind).alias("_kind"), add.alias("_add"), length.alias("_len"))

    zero, none, t = F.lit(0).cast("bigint"), F.lit(None).cast("bigint"), F.col("_t")
    lengths = F.array(*[F.lit(int(round(d * day))).cast("bigint") for d in window_days])
    fitting = F.filter(lengths, lambda n: t <= F.col("_end") - n)
    reads = F.flatten(F.transform(fitting, lambda n: F.array(mark(t, 0, zero, n), mark(t + n, 2, zero, n))))
    marks = F.concat(F.array(mark(t, 1, F.col("_w"), none)), reads)
    line = (
        times.select(*SECTION, "_t", F.explode(marks).alias("_p"))
        .select(*SECTION, "_t", "_p.*")
        .withColumn("_bucket", floor_div(F.col("_at"), 3_600_000_000))
    )
    order = [F.col("_at"), F.col("_kind"), F.col("_len"), F.col("_t")]
    counted = running_totals(line, SECTION, order, {"_cum": "_add"})
    signed = F.when(F.col("_kind") == 2, F.col("_cum")).otherwise(-F.col("_cum"))
    per_start = counted.filter(F.col("_kind") != 1).groupBy(*SECTION, "_len", "_t").agg(F.sum(signed).alias("n"))
    best = per_start.groupBy(*SECTION, "_len").agg(F.max(F.struct("n", (-F.col("_t")).alias("s"))).alias("m"))

    def at(us: Column, name: str) -> Column:
        return F.timestamp_add("MICROSECOND", us, F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'")).alias(name)

    days = F.col("_len") / F.lit(day)
    return best.select(
        *SECTION,
        days.alias("window_days"),
        at(-F.col("m.s"), "window_start"),
        at(-F.col("m.s") + F.col("_len"), "window_end"),
        F.col("m.n").alias("n_accidents"),
        (F.col("m.n") / F.greatest(days, F.lit(1.0))).alias("per_day"),
    )


def section_lengths(sections: DataFrame, first: int, last: int, step: int) -> DataFrame:
    """Every section with every window length."""
    return sections.withColumn("window_days", F.explode(F.sequence(F.lit(first), F.lit(last), F.lit(step))))


def top_candidates(windows: DataFrame, n: int, by: str = "per_day") -> DataFrame:
    other = "n_accidents" if by == "per_day" else "per_day"
    return windows.orderBy(F.desc(by), F.desc(other), *SECTION, "window_days").limit(n)


def attach_section_info(df: DataFrame, sections: DataFrame) -> DataFrame:
    return df.join(sections.select(*SECTION, "axis", "carriageway").distinct(), SECTION, "left")


def build_diagnostics(detections: DataFrame, features: DataFrame, sections: DataFrame) -> DataFrame:
    """Rows in, feature rows, and gantries shared by sections and features."""
    ends = sections.select(F.col("gantry_last").alias("gantry")).union(sections.select("gantry_next"))
    shared = ends.intersect(features.select("gantry"))
    parts = [("input_rows", detections), ("feature_rows", features), ("shared_gantries", shared)]
    out = None
    for name, df in parts:
        n = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("stage"), "n")
        out = n if out is None else out.unionByName(n)
    return out


def best_rows(df: DataFrame, keys: Sequence[str], metric: str, tie: Sequence[str], lowest: bool = False) -> DataFrame:
    """Best row per group; rows with an error or without the metric do not count."""
    ok = df.filter(F.col(metric).isNotNull())
    if "error" in df.columns:
        ok = ok.filter(F.col("error").isNull())
    score = F.col(metric) if lowest else -F.col(metric)
    rest = [c for c in df.columns if c not in keys]
    best = ok.groupBy(*keys).agg(F.min(F.struct(score.alias("_s"), *tie, F.struct(*rest).alias("_r"))).alias("_m"))
    return best.select(*keys, *[F.col(f"_m._r.{c}").alias(c) for c in rest])


def flag_best(df: DataFrame, groups: dict[str, Sequence[str]], metric: str, tie: str, lowest: bool = False) -> DataFrame:
    """Mark the best row overall and per grouping: `{flag: keys}`."""
    out = df
    for flag, keys in groups.items():
        ids = best_rows(df, list(keys), metric, [tie], lowest).select(tie).withColumn(flag, F.lit(True))
        out = out.join(ids, tie, "left").withColumn(flag, F.coalesce(flag, F.lit(False)))
    return out


def rank_sections(ranges: DataFrame, n: int) -> DataFrame:
    return ranges.orderBy(F.desc("n_accidents"), *SECTION).limit(n)


def first_per(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")
