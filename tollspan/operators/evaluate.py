"""Temporal splits, thresholds and scores, all as plain aggregations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tollspan.session import durable
from tollspan.skew import spread_totals


def _boundary(df: DataFrame, share: float, time: str):
    """First test time: the last `max(1, round(n * share))` distinct times are test, one at least is train."""
    times = df.filter(F.col(time).isNotNull()).select(time).distinct().withColumns({"_g": F.lit(1), "_one": F.lit(1)})
    ranked = durable(spread_totals(times, ["_g"], time, {"_at": "_one"}))
    total = ranked.count()
    if total < 2:
        raise ValueError("a temporal split needs two distinct times")
    n_test = min(max(1, round(total * share)), total - 1)
    return ranked.filter(F.col("_at") == total - n_test + 1).first()[time]


def temporal_split(df: DataFrame, test: float, time: str = "interval_start") -> tuple[DataFrame, DataFrame]:
    """Train and test by time. Only the boundary reaches the driver, so both are plain filters."""
    at = F.lit(_boundary(df, test, time)).cast("timestamp_ntz")
    return df.filter(F.col(time) < at), df.filter(F.col(time) >= at)


def three_way_split(
    df: DataFrame, test: float, val: float, time: str = "interval_start", *, of_whole: bool = False
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Train, validation and test blocks; `of_whole` reads `val` as a share of all times."""
    rest, tested = temporal_split(df, test, time)
    train, valid = temporal_split(rest, val / (1 - test) if of_whole else val, time)
    return train, valid, tested


def require_classes(df: DataFrame, part: str, target: str = "target") -> None:
    seen = {r[0] for r in df.select(target).distinct().collect()}
    if not {0, 1} <= seen:
        raise ValueError(f"{part} holds one class only")


def validation_split(
    df: DataFrame, val: float, time: str = "interval_start", seed: int = 42, key: str = "row_id"
) -> tuple[DataFrame, DataFrame]:
    """Synthetic rows stay in train. Without two distinct times, a hash-seeded draw per class."""
    real = df.filter(~F.coalesce("synthetic", F.lit(False)))
    made = df.filter(F.coalesce("synthetic", F.lit(False)))
    try:
        train, valid = temporal_split(real, val, time)
    except ValueError:
        draw = F.pmod(F.xxhash64(F.lit(seed), "target", key), F.lit(1_000_000)) / 1_000_000
        train, valid = real.filter(draw >= val), real.filter(draw < val)
    return train.unionByName(made), valid


# ---- ROC -------------------------------------------------------------------------------


def score_counts(df: DataFrame, score: str = "score", target: str = "target") -> DataFrame:
    """Positives and negatives per distinct score; equal scores meet before the shuffle."""
    return (
        df.filter(F.col(score).isNotNull())
        .groupBy(F.col(score).alias("score"))
        .agg(F.count_if(F.col(target) == 1).alias("pos"), F.count_if(F.col(target) == 0).alias("neg"))
    )


def roc_points(df: DataFrame, score: str = "score", target: str = "target") -> DataFrame:
    """True and false positives at every distinct threshold (score >= threshold)."""
    counts = score_counts(df, score, target).withColumn("_g", F.lit(1))
    out = spread_totals(counts, ["_g"], "score", {"tp": "pos", "fp": "neg"}, desc=True)
    totals = df.filter(F.col(score).isNotNull()).agg(
        F.count_if(F.col(target) == 1).alias("p"), F.count_if(F.col(target) == 0).alias("n")
    ).first()
    return out.select(
        F.col("score").alias("threshold"),
        "tp",
        "fp",
        F.try_divide(F.col("fp"), F.lit(totals["n"])).alias("far"),
        F.try_divide(F.col("tp"), F.lit(totals["p"])).alias("sensitivity"),
    )


def far_threshold(
    df: DataFrame, far_cap: float = 0.2, mode: str = "max_sensitivity", score: str = "score", target: str = "target"
) -> DataFrame:
    """Threshold of the best sensitivity under a false-alarm cap, or of the false-alarm rate closest to it.

    One class gives 0.5. A NULL threshold means no alarm at all, where even the highest
    score breaks the cap.
    """
    cap = min(max(far_cap, 0.0), 1.0)
    classes = df.agg(F.max(target).alias("hi"), F.min(target).alias("lo")).first()
    spark = df.sparkSession
    schema = "threshold double, far double, sensitivity double"
    if classes["hi"] is None or classes["hi"] == classes["lo"]:
        return spark.createDataFrame([(0.5, None, None)], schema)
    silent = spark.createDataFrame([(None, 0.0, 0.0)], schema)
    points = roc_points(df, score, target).select("threshold", "far", "sensitivity").unionByName(silent)
    if mode == "closest":
        ranked = points.orderBy(F.abs(F.col("far") - cap), F.desc("sensitivity"), F.desc("threshold"))
    else:
        ranked = points.filter(F.col("far") <= cap + 1e-12).orderBy(
            F.desc("sensitivity"), "far", F.desc("threshold")
        )
    return ranked.limit(1)


def roc_auc(df: DataFrame, score: str = "score", target: str = "target", one_class: float | None = 0.5) -> DataFrame:
    """Exact area under the ROC curve; a tie counts one half."""
    counts = score_counts(df, score, target).withColumn("_g", F.lit(1))
    below = spread_totals(counts, ["_g"], "score", {"cum": "neg"})
    wins = F.sum(F.col("pos") * (F.col("cum") - F.col("neg") / 2))
    area = F.try_divide(wins, F.sum("pos").cast("double") * F.sum("neg"))
    return below.agg(F.coalesce(area, F.lit(one_class)).alias("auc"))


# ---- classification quality ---------------------------------------------------------------


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def evaluation(df: DataFrame, predicted: Column, target: str = "target", by: Sequence[str] = ()) -> DataFrame:
    """Confusion counts and the rates read off them; a zero denominator gives 0."""
    y, hat = F.col(target), predicted.cast("int")
    counts = df.groupBy(*by).agg(
        F.count_if((y == 1) & (hat == 1)).alias("tp"),
        F.count_if((y == 0) & (hat == 1)).alias("fp"),
        F.count_if((y == 0) & (hat == 0)).alias("tn"),
        F.count_if((y == 1) & (hat == 0)).alias("fn"),
    )
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    return counts.withColumns(
        {
            "accuracy": _ratio(tp + tn, tp + fp + tn + fn),
            "precision": _ratio(tp, tp + fp),
            "recall": _ratio(tp, tp + fn),
            "f1": _ratio(2 * tp, 2 * tp + fp + fn),
            "far": _ratio(fp, fp + tn),
            "sensitivity": _ratio(tp, tp + fn),
            "fnr": _ratio(fn, fn + tp),
        }
    )


def objective(name: str) -> Column:
    """Value to maximise for a named objective over evaluation columns."""
    # Objectives; the false-alarm rate (sensitivity breaks its ties) and the miss rate are minimised.
    table = {
        "accuracy": F.col("accuracy"),
        "precision": F.col("precision"),
        "recall": F.col("recall"),
        "f1": F.col("f1"),
        "sensitivity": F.col("sensitivity"),
        "auc": F.col("auc"),
        "far": -(F.col("far") - F.lit(0.001) * F.col("sensitivity")),
        "fnr": -F.col("fnr"),
    }
    return table[name]


def class_distribution(df: DataFrame, target: str = "target", by: Sequence[str] = ()) -> DataFrame:
    """Count and percentage per class, also within a split."""
    n = df.groupBy(*by, target).agg(F.count(F.lit(1)).alias("n"))
    whole = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(1))
    return n.withColumn("percent", F.round(F.col("n") * 100 / F.sum("n").over(whole), 2))


def dataset_summary(df: DataFrame, time: str = "interval_start", target: str = "target") -> DataFrame:
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.lit(len(df.columns)).alias("n_columns"),
        F.min(time).alias("first_time"),
        F.max(time).alias("last_time"),
        F.count_if(F.col(target) == 1).alias("n_positive"),
    )


def importance_above(importance: DataFrame, least: float) -> DataFrame:
    return importance.filter(F.col("importance") >= least)


def top_features(importance: DataFrame, k: int) -> DataFrame:
    return importance.orderBy(F.desc("importance"), "variable").limit(k)


def balanced_k(importance: DataFrame, k: int, is_cluster: Column) -> DataFrame:
    """Base features to use beside the cluster ones inside the combined top k."""
    top = top_features(importance, k)
    return top.agg(
        F.count(F.lit(1)).alias("combined_k"),
        F.count_if(is_cluster).alias("cluster_in_top"),
        F.count_if(~is_cluster).alias("base_k"),
    )


def suggest_k(metrics: DataFrame) -> DataFrame:
    """K of the best value of each metric present; the first K on ties."""
    # Metrics and whether the largest value is best.
    rules = {"silhouette": True, "davies_bouldin": False, "calinski_harabasz": True, "bic": False, "aic": False}
    picks = []
    for name, high in rules.items():
        if name in metrics.columns:
            order = F.struct((F.col(name) if high else -F.col(name)).alias("v"), (-F.col("k")).alias("k"))
            picks.append((-F.max(F.when(F.col(name).isNotNull(), order))["k"]).alias(f"k_{name}"))
    return metrics.agg(*picks)
