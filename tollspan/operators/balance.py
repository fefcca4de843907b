"""Minority oversampling of the training rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tollspan.operators.nearest import nearest
from tollspan.session import durable
from tollspan.skew import running_totals


class Unbalanceable(ValueError):
    """Rows that no oversampling can balance: one class only, or one row of the smaller class."""


def neighbours(rows: DataFrame, features: Sequence[str], k: int) -> DataFrame:
    """Exact k nearest other rows by Euclidean distance over `features`: (row_id, rank, near_id), ties by the smaller id."""
    at = F.array(*[F.col(c).cast("double") for c in features])
    return nearest(rows.select(F.lit(0).alias("group"), F.col("row_id").alias("id"), at.alias("x")), k).select(
        F.col("id").alias("row_id"), "rank", "near_id"
    )


def real_rows(train: DataFrame, features: Sequence[str], time: str = "interval_start") -> DataFrame:
    """The train rows as they stand in a balanced table."""
    values = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in features]
    return train.select("row_id", time, "target", *values, F.lit(False).alias("synthetic"))


def _in_order(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.repartition(*keys).sortWithinPartitions(*keys)


def class_sizes(train: DataFrame) -> tuple[int, int, int]:
    """The smaller class, its rows and those of the larger class."""
    counts = {r["target"]: r["n"] for r in train.groupBy("target").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(counts) < 2:
        raise Unbalanceable("training rows hold one class only")
    minor = min(counts, key=lambda c: (counts[c], -c))
    if counts[minor] < 2:
        raise Unbalanceable("too few minority rows to interpolate")
    return minor, counts[minor], max(counts.values())


def minority_neighbours(train: DataFrame, features: Sequence[str], k: int) -> DataFrame:
    """The `k` nearest of each minority row, written once for every `smote` of these rows with as many or fewer."""
    minor, n_min, _ = class_sizes(train)
    pool = real_rows(train, features).filter(F.col("target") == minor)
    return durable(neighbours(pool, features, max(1, min(k, n_min - 1))))


def smote(
    train: DataFrame, features: Sequence[str], *, ratio: float = 1.0, k: int = 5, seed: int = 42, time: str = "interval_start",
    near: DataFrame | None = None, ordered: bool = False,
) -> DataFrame:
    """Train rows plus interpolated minority rows until minority / majority reaches `ratio`.

    `train` needs a unique bigint `row_id`. Every minority row serves as a base equally
    often; hashes of the seed choose its neighbour and the fraction. New rows have no
    time and `synthetic` is true. `near` are its `minority_neighbours` where they are known. `ordered` deals and
    sorts rows by id and copy: what a forest draws hangs on their order, which joins do not keep from run to run.
    """
    minor, n_min, n_maj = class_sizes(train)
    k = max(1, min(k, n_min - 1))
    wanted = max(0, int(n_maj * ratio) - n_min)
    real = real_rows(train, features, time)
    kept = _in_order(real, "row_id") if ordered else real
    if wanted == 0:
        return kept
    pool = real.filter(F.col("target") == minor).select("row_id", *features)
    near = neighbours(pool, features, k) if near is None else near
    hashed = pool.withColumn("_h", F.xxhash64(F.lit(seed), "row_id")).withColumns(
        {"_bucket": F.shiftright("_h", 52).cast("bigint"), "_one": F.lit(1), "_g": F.lit(1)}
    )
    ranked = running_totals(hashed, ["_g"], [F.col("_h"), F.col("row_id")], {"_pos": "_one"})
    copies = F.lit(wanted // n_min) + (F.col("_pos") <= wanted % n_min).cast("int")
    draws = ranked.filter(copies > 0).withColumn("_copy", F.explode(F.sequence(F.lit(1), copies.cast("int"))))
    draws = draws.withColumns(
        {
            "rank": F.pmod(F.xxhash64(F.lit(seed), F.lit("near"), "row_id", "_copy"), F.lit(k)).cast("int"),
            "_u": F.pmod(F.xxhash64(F.lit(seed), F.lit("step"), "row_id", "_copy"), F.lit(1_000_003)) / 1_000_003,
        }
    )
    other = pool.select(F.col("row_id").alias("near_id"), *[F.col(c).alias(f"_n_{c}") for c in features])
    made = draws.join(near, ["row_id", "rank"]).join(other, "near_id")
    made = _in_order(made, "row_id", "_copy") if ordered else made
    made = made.select(
        F.lit(None).cast("bigint").alias("row_id"),
        F.lit(None).cast(dict(real.dtypes)[time]).alias(time),
        F.lit(minor).cast(dict(real.dtypes)["target"]).alias("target"),
        *[(F.col(c) + F.col("_u") * (F.col(f"_n_{c}") - F.col(c))).alias(c) for c in features],
        F.lit(True).alias("synthetic"),
    )
    return kept.unionByName(made)


def with_row_id(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A repeatable row id from the row's own keys."""
    return df.withColumn("row_id", F.xxhash64(*keys))


def balanced_dataset(train: DataFrame, test: DataFrame, features: Sequence[str], **kw) -> DataFrame:
    """Oversampled train rows and untouched test rows in one table.

    Train rows that cannot be balanced (in busy traffic an accident may follow every interval) stay as they are.
    """
    try:
        made = smote(train, features, **kw)
    except Unbalanceable:
        made = real_rows(train, features, kw.get("time", "interval_start"))
    made = made.withColumn("split", F.lit("train"))
    rest = test.select(*[c for c in made.columns if c in test.columns]).withColumns(
        {"synthetic": F.lit(False), "split": F.lit("test")}
    )
    return made.unionByName(rest, allowMissingColumns=True)
