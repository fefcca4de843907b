"""Filters, duplicate removal, outliers and row selection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tollspan.functions import scalars as S
from tollspan.session import durable, sized
from tollspan.skew import exact_quantiles, floor_div, micros


def clean_passes(df: DataFrame) -> DataFrame:
    """Keep passes usable for behaviour features: plate of 5-6 characters, numbers present, lane 1-3."""
    out = (
        df.withColumn("plate", S.normalise_plate(F.col("plate")))
        .withColumn("gantry", S.normalise_gantry(F.col("gantry")))
        .withColumn("lane", F.col("lane").try_cast("double"))
    )
    usable = (
        F.length("plate").between(5, 6)
        & F.col("ts").isNotNull()
        & F.col("speed_kmh").isNotNull()
        & F.col("lane").isin(1.0, 2.0, 3.0)
    )
    return out.filter(usable).withColumn("lane", F.col("lane").cast("int"))


def drop_duplicates_keep(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key: the smallest by `order`. Copies are combined before the shuffle."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    best = F.min(F.struct(*order, *rest)).alias("_best")
    out = df.groupBy(*keys).agg(best)
    return out.select(*[F.col(c) if c in keys else F.col(f"_best.{c}").alias(c) for c in df.columns])


def dedupe_passes(df: DataFrame) -> DataFrame:
    """Duplicate passes keep the lowest speed."""
    order = ["speed_kmh"] + (["event_id"] if "event_id" in df.columns else [])
    return drop_duplicates_keep(df, ["plate", "gantry", "lane", "ts"], order)


def speed_bounds(df: DataFrame, low: float, high: float, by: Sequence[str]) -> DataFrame:
    known = df
    for key in by:
        known = known.filter(F.col(key).isNotNull())
    return exact_quantiles(known, by, "speed_kmh", {"speed_lo": low, "speed_hi": high})


def limit_outliers(
    df: DataFrame,
    action: str = "winsorize",
    low: float = 0.01,
    high: float = 0.99,
    scope: Sequence[str] = (),
) -> DataFrame:
    """Clip to, or keep only, the [low, high] speed quantiles of each gantry and lane.

    `scope` adds keys, such as a batch, within which the quantiles are taken.
    Rows without a gantry have no bounds: clipping leaves them, filtering drops them.
    """
    if action == "none":
        return df
    if action not in ("winsorize", "filter"):
        raise ValueError("action must be 'winsorize', 'filter' or 'none'")
    by = [*scope, "gantry", "lane"]
    joined = df.join(sized(speed_bounds(df, low, high, by)), by, "left")
    if action == "filter":
        kept = joined.filter(F.col("speed_kmh").between(F.col("speed_lo"), F.col("speed_hi")))
    else:
        clipped = F.least(F.greatest("speed_kmh", "speed_lo"), F.col("speed_hi"))
        kept = joined.withColumn("speed_kmh", F.when(F.col("speed_lo").isNull(), F.col("speed_kmh")).otherwise(clipped))
    return kept.select(*df.columns)


def behaviour_input(df: DataFrame, action: str = "winsorize") -> DataFrame:
    """Clean, deduplicate and limit outliers.

    The quantiles need a pass of their own, so the deduplicated passes are written once
    rather than shuffled twice.
    """
    rows = dedupe_passes(clean_passes(df))
    return rows if action == "none" else limit_outliers(durable(rows), action)


def trajectory_input(df: DataFrame, catalogue: DataFrame, max_speed: float = 200.0) -> DataFrame:
    """Valid time, plate and speed; catalogue gantries only; one row per plate, gantry and time."""
    out = df.withColumn("plate", S.normalise_plate(F.col("plate"))).withColumn(
        "gantry", S.strip(F.col("gantry").cast("string"))
    )
    out = out.filter(
        F.col("plate").isNotNull() & F.col("ts").isNotNull() & F.col("speed_kmh").between(0, max_speed)
    )
    out = drop_duplicates_keep(out, ["plate", "gantry", "ts"], ["speed_kmh", "lane", "event_id"])
    return attach_posts(out, catalogue)


def attach_posts(df: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Rows of catalogue gantries with the place of the post; of several posts with one code, the first in order."""
    posts = drop_duplicates_keep(catalogue, ["gantry"], ["seq"])
    return df.join(posts.select("gantry", "km", "carriageway", "seq", "axis"), "gantry")


def gantries_between(catalogue: DataFrame, axis: str, way: str, first: str, last: str) -> DataFrame:
    """Gantries of an axis and carriageway from one post to another, in either order."""
    line = catalogue.filter((F.col("axis") == axis) & (F.col("carriageway") == way))
    ends = line.filter(F.col("gantry").isin(first, last)).agg(F.min("seq").alias("a"), F.max("seq").alias("b")).first()
    if ends is None or ends["a"] is None:
        return line.limit(0).select("gantry", "seq")
    return line.filter(F.col("seq").between(ends["a"], ends["b"])).select("gantry", "seq")


def keep_section(df: DataFrame, gantries: DataFrame) -> DataFrame:
    return df.join(gantries.select("gantry"), "gantry", "left_semi")


# Key column pairs of section tables, in order of preference.
SECTION_KEYS = [
    ("gantry_last", "gantry_next"),
    ("gantry_start", "gantry_end"),
    ("gantry", None),
    ("last_gantry", None),
]


def section_keys(columns: Sequence[str]) -> tuple[str, str | None]:
    """The columns that name a row's section, or its only gantry."""
    for a, b in SECTION_KEYS:
        if a in columns and (b is None or b in columns):
            return a, b
    raise ValueError("no section key column")


def section_predicate(columns: Sequence[str], first: str, last: str | None = None) -> Column:
    """Filter on whichever section key columns a feature table has."""
    a, b = section_keys(columns)
    hit = F.col(a) == first
    return hit & (F.col(b) == last) if b and last is not None else hit


def filter_section(
    df: DataFrame, first: str, last: str | None = None, axis: str | None = None, way: str | None = None
) -> DataFrame:
    out = df.filter(section_predicate(df.columns, first, last))
    if axis is not None and "axis" in df.columns:
        out = out.filter(F.col("axis") == axis)
    if way is not None and "carriageway" in df.columns:
        out = out.filter(F.col("carriageway") == way)
    return out


def frequent_condition(
    columns: Sequence[str],
    passes: int = 20,
    days: int = 5,
    weeks: int | None = None,
    months: int | None = None,
) -> Column:
    limits = {"total_passes": passes, "n_days_active": days, "n_weeks_active": weeks, "n_months_active": months}
    cond = F.lit(True)
    for name, least in limits.items():
        if least is not None and name in columns:
            cond = cond & F.coalesce(F.col(name) >= least, F.lit(False))
    return cond


def split_frequent(df: DataFrame, **limits: int) -> tuple[DataFrame, DataFrame]:
    """Frequent plates and their exact complement."""
    cond = frequent_condition(df.columns, **limits)
    return df.filter(cond), df.filter(~cond)


def valid_rows(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Rows whose features are all finite numbers."""
    out = df.withColumns({c: F.col(c).try_cast("double") for c in features})
    for c in features:
        bad = F.isnan(c) | F.col(c).isin(float("inf"), float("-inf"))
        out = out.withColumn(c, F.when(~bad, F.col(c)))
    return out.dropna(subset=list(features))


def accident_rows(log: DataFrame, roads: Sequence[str] = ("expresa", "via expresa")) -> DataFrame:
    return log.filter((F.col("tipo") == "Accidente") & F.lower("via").isin(*roads))


def filter_events(
    events: DataFrame,
    types: Sequence[str] | None = None,
    first_day: str | None = None,
    last_day: str | None = None,
    gantry_start: str | None = None,
    gantry_end: str | None = None,
) -> DataFrame:
    """Types, a range of days (the last one included) and a section."""
    out = events
    if types is not None:
        out = out.filter(F.col("event_type").isin(*types))
    if first_day is not None:
        out = out.filter(F.col("event_time") >= F.lit(first_day).cast("timestamp_ntz"))
    if last_day is not None:
        out = out.filter(F.col("event_time") < F.expr(f"timestampadd(DAY, 1, TIMESTAMP_NTZ'{last_day} 00:00:00')"))
    if gantry_start is not None:
        out = out.filter(F.col("gantry_start") == gantry_start)
    if gantry_end is not None:
        out = out.filter(F.col("gantry_end") == gantry_end)
    return out


def filter_table(
    df: DataFrame,
    *,
    text: str | None = None,
    ranges: dict[str, tuple[float, float]] | None = None,
    values: dict[str, Sequence] | None = None,
    contains: dict[str, str] | None = None,
) -> DataFrame:
    """Ad-hoc filter of any table."""
    out = df
    if text:
        out = out.filter(S.any_contains(df.columns, text))
    for c, (a, b) in (ranges or {}).items():
        out = out.filter(F.col(c).between(a, b))
    for c, allowed in (values or {}).items():
        out = out.filter(F.col(c).isin(*allowed))
    for c, part in (contains or {}).items():
        out = out.filter(F.contains(F.lower(F.col(c).cast("string")), F.lit(part.lower())))
    return out


def hash_sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """Repeatable sample of n rows: the n smallest keyed hashes."""
    return df.orderBy(F.xxhash64(F.col(key), F.lit(seed)), key).limit(n)


def earliest_fraction(df: DataFrame, fraction: float, ts: str = "ts", tie: str = "event_id") -> DataFrame:
    """The earliest `max(1, int(n * fraction))` rows.

    Minute counts locate the minute that holds the last row; only that minute is ordered.
    """
    minute = floor_div(micros(ts), 60_000_000)
    known = df.filter(F.col(ts).isNotNull()).withColumn("_m", minute)
    per_minute = known.groupBy("_m").agg(F.count(F.lit(1)).alias("n"))
    total = per_minute.agg(F.sum("n")).first()[0] or 0
    take = min(total, max(1, int(total * fraction)))
    upto = Window.orderBy("_m").rowsBetween(Window.unboundedPreceding, 0)
    cut = (
        per_minute.select("_m", "n", F.sum("n").over(upto).alias("cum"))
        .filter(F.col("cum") >= take)
        .orderBy("_m")
        .limit(1)
        .first()
    )
    if cut is None:
        return df.limit(0)
    left = take - (cut["cum"] - cut["n"])
    border = known.filter(F.col("_m") == cut["_m"])
    rank = F.row_number().over(Window.partitionBy("_m").orderBy(ts, tie))
    border = border.withColumn("_r", rank).filter(F.col("_r") <= left).drop("_r")
    return known.filter(F.col("_m") < cut["_m"]).unionByName(border).drop("_m")
