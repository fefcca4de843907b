"""Ordered operations that stay whole when one key holds much of the data.

A plain window puts a whole key into one task. The helpers below cut a key
into ordered buckets, work inside each bucket, and carry a small summary (one
row per key and bucket) across the bucket borders, so results are exactly
those of the uncut window.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tollspan.session import durable

EPOCH = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"


def micros(ts: str) -> Column:
    """Microseconds since 1970 of a zone-less timestamp column."""
    return F.expr(f"timestampdiff(MICROSECOND, {EPOCH}, {ts})")


def seconds_between(start: str, end: str) -> Column:
    return F.expr(f"timestampdiff(MICROSECOND, {start}, {end}) / 1000000.0D")


def floor_div(value: Column, step: int) -> Column:
    """Exact integer floor division of a bigint column."""
    return ((value - F.pmod(value, F.lit(step))) / F.lit(step)).cast("bigint")


def time_bucket_id(ts: str, seconds: int) -> Column:
    """Number of the fixed-length time bucket a row falls in."""
    return floor_div(micros(ts), seconds * 1_000_000)


def previous_row(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    fields: Sequence[str],
    *,
    bucket: str = "_bucket",
    prefix: str = "prev_",
) -> DataFrame:
    """`lag` of `fields` per key, computed bucket by bucket.

    `order` columns must be non-null and the buckets must follow that order.
    """
    part = [*keys, bucket]
    within = Window.partitionBy(*part).orderBy(*order)
    payload = F.struct(*[F.col(f) for f in fields])
    marked = df.select(
        "*", F.lag(payload).over(within).alias("_lag"), F.row_number().over(within).alias("_rn")
    )
    last = df.groupBy(*part).agg(
        F.max(F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)], payload.alias("p"))).alias("_m")
    )
    carry = last.select(
        *part,
        F.lag("_m.p").over(Window.partitionBy(*keys).orderBy(bucket)).alias("_carry"),
    )
    joined = marked.join(carry, part, "left").withColumn(
        "_prev", F.when(F.col("_rn") == 1, F.col("_carry")).otherwise(F.col("_lag"))
    )
    return joined.select(
        *[joined[c] for c in df.columns], *[F.col(f"_prev.{f}").alias(prefix + f) for f in fields]
    )


def running_totals(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    sums: dict[str, str],
    *,
    bucket: str = "_bucket",
    bucket_desc: bool = False,
) -> DataFrame:
    """Running sums (`{output: input}`) per key in the given total order, current row included.

    The order must be that of the buckets, ascending or (`bucket_desc`) descending.
    """
    part = [*keys, bucket]
    frame = (Window.unboundedPreceding, Window.currentRow)
    within = Window.partitionBy(*part).orderBy(*order).rowsBetween(*frame)
    local = df.select("*", *[F.sum(src).over(within).alias(f"_l_{out}") for out, src in sums.items()])
    totals = df.groupBy(*part).agg(*[F.sum(src).alias(f"_t_{out}") for out, src in sums.items()])
    step = F.desc(bucket) if bucket_desc else F.asc(bucket)
    before = Window.partitionBy(*keys).orderBy(step).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *part, *[F.coalesce(F.sum(f"_t_{out}").over(before), F.lit(0)).alias(f"_o_{out}") for out in sums]
    )
    joined = local.join(offsets, part, "inner")
    return joined.select(
        *[joined[c] for c in df.columns],
        *[(F.col(f"_l_{out}") + F.col(f"_o_{out}")).alias(out) for out in sums],
    )


def spread_totals(df: DataFrame, keys: Sequence[str], value: str, sums: dict[str, str], *, desc: bool = False) -> DataFrame:
    """Running sums (`{output: input}`) per key in the order of `value`, current row included, however values lie.

    Rows are dealt out by sampled bounds on (keys, value), so each task has about as many whether one key or one
    narrow range of values holds most of them. A task sums what it has and takes over one offset a key from the
    tasks before. `value` must not repeat within a key.
    """
    placed = df.repartitionByRange(*keys, value).withColumn("_bucket", F.spark_partition_id())
    # written, as numbers of partitions may differ when they are worked out again
    order = F.desc(value) if desc else F.asc(value)
    return running_totals(durable(placed), keys, [order], sums, bucket_desc=desc).drop("_bucket")


def halo_copies(df: DataFrame, ts: str, seconds: int, halo_seconds: float) -> DataFrame:
    """Cut time into buckets; a row near a bucket's end is repeated, as context, in the next one.

    Adds `_bucket` and `_context`. Any look-back of up to `halo_seconds` is then
    answered inside a bucket, with no second pass over the data.
    """
    if halo_seconds > seconds:
        raise ValueError("the halo must not be longer than a bucket")
    late = time_bucket_id(ts, seconds)
    reach = floor_div(micros(ts) + F.lit(int(halo_seconds * 1_000_000)), seconds * 1_000_000)
    pairs = df.select("*", late.alias("_own"), reach.alias("_reach"))
    return pairs.select(
        *df.columns, "_own", F.explode(F.sequence("_own", "_reach")).alias("_bucket")
    ).select(*df.columns, "_bucket", (F.col("_bucket") > F.col("_own")).alias("_context"))


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float]) -> DataFrame:
    """Exact linear-interpolated quantiles per key: `{output: probability}`; null values do not count.

    Equal values are counted before the shuffle; see `quantiles_of_counts`.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    return quantiles_of_counts(counts, keys, probs)


def quantiles_of_counts(counts: DataFrame, keys: Sequence[str], probs: dict[str, float]) -> DataFrame:
    """Exact quantiles per key from `(keys, _v, _n)`, a row for each distinct value.

    Values are dealt out by sampled bounds (`spread_totals`), so no width of a cell has to fit them: they may lie
    within one unit or over a thousand millions, and one key may hold most of them.
    """
    keys = list(keys) or ["_g"]
    if "_g" in keys:
        counts = counts.withColumn("_g", F.lit(1))
    placed = durable(spread_totals(counts.select(*keys, "_v", "_n"), keys, "_v", {"_cum": "_n"}))
    totals = placed.groupBy(*keys).agg(F.max("_cum").alias("_total"))

    def rank(p: float) -> Column:
        return F.lit(p) * (F.col("_total") - 1)

    def value_at(r: Column) -> Column:
        hit = (F.col("_cum") > r) & (F.col("_cum") - F.col("_n") <= r)
        return F.max(F.when(hit, F.col("_v")))

    picks = []
    for out, p in probs.items():
        picks += [value_at(F.floor(rank(p))).alias(f"_lo_{out}"), value_at(F.ceil(rank(p))).alias(f"_hi_{out}")]
    picked = placed.join(totals, keys).groupBy(*keys, "_total").agg(*picks)
    return picked.select(
        *[k for k in keys if k != "_g"],
        *[
            (
                F.col(f"_lo_{out}")
                + (F.col(f"_hi_{out}") - F.col(f"_lo_{out}")) * (rank(p) - F.floor(rank(p)))
            ).alias(out)
            for out, p in probs.items()
        ],
    )
