"""Cluster summaries, comparisons and column statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tollspan.session import durable
from tollspan.skew import exact_quantiles, quantiles_of_counts


def cluster_summary(df: DataFrame, features: Sequence[str], label: str = "cluster_label") -> DataFrame:
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("size"), *[F.avg(c).alias(c) for c in features])


def cluster_descriptives(df: DataFrame, features: Sequence[str], label: str = "cluster_label") -> DataFrame:
    """Count, mean, deviation, minimum and maximum of each feature per cluster."""
    cells = []
    for c in features:
        cells += [
            F.count(c).alias(f"{c}_count"),
            F.avg(c).alias(f"{c}_mean"),
            F.stddev_samp(c).alias(f"{c}_std"),
            F.min(c).alias(f"{c}_min"),
            F.max(c).alias(f"{c}_max"),
        ]
    return df.groupBy(label).agg(*cells)


def normalised_profile(
    summary: DataFrame, features: Sequence[str], how: str = "zscore", label: str = "cluster_label"
) -> DataFrame:
    """Cluster means compared across clusters: population z-score or min-max. One row per cluster comes in."""
    w = Window.partitionBy(F.lit(1))
    out = {}
    for c in features:
        if how == "zscore":
            sd = F.stddev_pop(c).over(w)
            out[c] = (F.col(c) - F.avg(c).over(w)) / F.when(sd == 0, 1.0).otherwise(sd)
        else:
            span = F.max(c).over(w) - F.min(c).over(w)
            out[c] = (F.col(c) - F.min(c).over(w)) / F.when(span == 0, 1.0).otherwise(span)
    return summary.select(label, *[v.alias(c) for c, v in out.items()])


def column_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Count, distinct values, most frequent value, moments and quartiles per column, long form.

    The rows are read once, as (column, value) pairs that are counted before they are shuffled; all the rest comes
    from these counts, for all columns together.
    """
    types = dict(df.dtypes)
    number = [c for c in columns if types[c] in ("double", "float", "int", "bigint", "smallint")]
    pairs = F.array(
        *[
            F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("v"), (F.col(c) if c in number else F.lit(None)).cast("double").alias("x"))
            for c in columns
        ]
    )
    one = df.select(F.explode(pairs).alias("p")).select("p.*").filter(F.col("v").isNotNull())
    per = durable(one.groupBy("column_name", "v", "x").agg(F.count(F.lit(1)).alias("n")))
    mean = F.try_divide(F.sum(F.col("x") * F.col("n")), F.sum("n"))
    found = per.groupBy("column_name").agg(
        F.sum("n").alias("n_values"),
        F.count(F.lit(1)).alias("n_unique"),
        F.max(F.struct("n", "v")).alias("_top"),
        mean.alias("mean"),
        F.min("x").alias("min"),
        F.max("x").alias("max"),
    )
    apart = F.sum(F.col("n") * (F.col("x") - F.col("mean")) * (F.col("x") - F.col("mean")))
    spread = per.filter("x IS NOT NULL").join(found.select("column_name", "mean"), "column_name").groupBy("column_name").agg(
        F.sqrt(F.try_divide(apart, F.when(F.sum("n") > 1, F.sum("n") - 1))).alias("std")
    )
    counts = per.filter("x IS NOT NULL").groupBy("column_name", F.col("x").alias("_v")).agg(F.sum("n").alias("_n"))
    quartiles = quantiles_of_counts(counts, ["column_name"], {"q25": 0.25, "q50": 0.5, "q75": 0.75})
    every = df.sparkSession.createDataFrame([(c,) for c in columns], "column_name string")
    return every.join(found, "column_name", "left").join(spread, "column_name", "left").join(quartiles, "column_name", "left").select(
        "column_name", F.coalesce("n_values", F.lit(0)).alias("n_values"), F.coalesce("n_unique", F.lit(0)).alias("n_unique"),
        F.col("_top.v").alias("top"), F.col("_top.n").alias("freq"), "mean", "std", "min", "q25", "q50", "q75", "max",
    )


def histogram(df: DataFrame, column: str, bins: int, by: Sequence[str] = ()) -> DataFrame:
    """Equal-width bins between the smallest and largest value; the last bin is closed."""
    ends = df.agg(F.min(column).alias("a"), F.max(column).alias("b")).first()
    if ends["a"] is None:
        return df.limit(0).select(*by, F.lit(0).alias("bin"), F.lit(0).cast("bigint").alias("n"))
    a, width = float(ends["a"]), (float(ends["b"]) - float(ends["a"])) / bins or 1.0
    at = F.least(F.floor((F.col(column) - a) / width), F.lit(bins - 1)).cast("int")
    return df.filter(F.col(column).isNotNull()).groupBy(*by, at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def box_stats(df: DataFrame, column: str, by: Sequence[str]) -> DataFrame:
    probs = {"q0": 0.0, "q25": 0.25, "q50": 0.5, "q75": 0.75, "q100": 1.0}
    return exact_quantiles(df, by, column, probs)


def contingency(a: DataFrame, b: DataFrame, key: str = "plate", label: str = "cluster_label") -> DataFrame:
    """Non-zero cells of the cross-table of two clusterings of the same plates."""
    left = a.select(key, F.col(label).alias("label_a"))
    right = b.select(key, F.col(label).alias("label_b"))
    return left.join(right, key).groupBy("label_a", "label_b").agg(F.count(F.lit(1)).alias("n"))


def cross_table(cells: DataFrame, labels_b: Sequence[int]) -> DataFrame:
    """One row per label of the first clustering, one column per label of the second."""
    pivot = [
        F.coalesce(F.sum(F.when(F.col("label_b") == k, F.col("n"))), F.lit(0)).alias(f"b_{k}".replace("-", "neg_"))
        for k in labels_b
    ]
    return cells.groupBy("label_a").agg(*pivot)


def best_overlap(cells: DataFrame) -> DataFrame:
    best = cells.groupBy("label_a").agg(F.max(F.struct("n", (-F.col("label_b")).alias("b"))).alias("m"))
    return best.select("label_a", (-F.col("m.b")).alias("label_b"), F.col("m.n").alias("n"))


def best_matching(cells: DataFrame) -> DataFrame:
    """`label_a, label_b, n`: the one-to-one matching of two clusterings that keeps most plates together.

    Every label of the side with fewer gets one of the other; what is left over has a null partner. Of several
    best matchings that of the smallest `label_b` for the smallest `label_a`, and so on, counts. Only the cells of the
    cross-table, a row for each two labels that meet, leave Spark; an auction over whole numbers matches them.
    """
    found = {(r["label_a"], r["label_b"]): r["n"] for r in cells.collect()}
    rows, columns = sorted({a for a, _ in found}), sorted({b for _, b in found})
    size = max(len(rows), len(columns))
    # a tie is worth less than one plate: labels count as digits below the plates
    worth = [[found.get((a, b), 0) for b in columns] + [0] * (size - len(columns)) for a in rows] + [[0] * size] * (size - len(rows))
    scale = (size + 1) ** (size + 1)
    value = [[w * scale - j * (size + 1) ** (size - 1 - i) for j, w in enumerate(line)] for i, line in enumerate(worth)]
    mate = auction(value)
    out = [(a, columns[mate[i]] if mate[i] < len(columns) else None) for i, a in enumerate(rows)]
    taken = {b for _, b in out}
    out += [(None, b) for b in columns if b not in taken]
    kind = dict(cells.dtypes)
    schema = f"label_a {kind['label_a']}, label_b {kind['label_b']}, n bigint"
    return cells.sparkSession.createDataFrame([(a, b, found.get((a, b), 0)) for a, b in out], schema)


def auction(value: list[list[int]]) -> list[int]:
    """By row the column of the matching with the largest sum, for whole numbers in a square table.

    Rows without a column bid what their best one is worth to them above their second best; bids rise by steps
    that shrink to one, with values multiplied by more than the number of rows, so the last matching is the best.
    """
    n = len(value)
    value = [[v * (n + 1) for v in line] for line in value]
    price, step = [0] * n, max((abs(v) for line in value for v in line), default=1) // 2 or 1
    while True:
        owner: list[int | None] = [None] * n
        mate: list[int | None] = [None] * n
        free = list(range(n))
        while free:
            i = free.pop()
            gains = [v - c for v, c in zip(value[i], price, strict=True)]
            best = max(range(n), key=gains.__getitem__)
            second = max((g for j, g in enumerate(gains) if j != best), default=gains[best])
            price[best] += gains[best] - second + step
            if owner[best] is not None:
                mate[owner[best]] = None
                free.append(owner[best])
            owner[best], mate[i] = i, best
        if step == 1:
            return [int(m) for m in mate]
        step = max(1, step // 5)


def flow_between(cells: DataFrame) -> DataFrame:
    """Share of each source cluster that goes to each target cluster."""
    total = cells.groupBy("label_a").agg(F.sum("n").alias("t"))
    return cells.join(total, "label_a").select("label_a", "label_b", "n", (F.col("n") / F.col("t")).alias("share"))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), column)


def assignment_coverage(labels: DataFrame, label: str = "cluster_label") -> DataFrame:
    """Assigned and unknown plates, and the share of rare plates left out."""
    rare, unknown = F.col("is_rare"), F.col(label) == -1
    return labels.agg(
        F.count(F.lit(1)).alias("n_plates"),
        F.count_if(~unknown).alias("n_assigned"),
        F.count_if(unknown).alias("n_unknown"),
        F.count_if(rare).alias("n_rare"),
        F.count_if(rare & unknown).alias("n_rare_excluded"),
        F.coalesce(F.try_divide(F.count_if(rare & unknown) * 100.0, F.count_if(rare)), F.lit(0.0)).alias("rare_excluded_pct"),
    )


def unpivot_metrics(df: DataFrame, ids: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    return df.unpivot(list(ids), list(metrics), "metric", "value").filter(F.col("value").isNotNull())
