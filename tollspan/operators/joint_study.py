"""Studies of many forests in one go: all sections (or windows), feature sets and trials together.

Splits, class counts, bins, importance, oversampling, growth, thresholds and scores are each one set of jobs for
all groups, so a study over a thousand sections takes as many jobs as one over two. What reaches the driver has a
size given by the study (groups, features, models), not by the rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tollspan.operators import grove
from tollspan.operators.nearest import nearest
from tollspan.session import durable
from tollspan.skew import running_totals, spread_totals
from tollspan.sources.ingest import cluster_features, numeric_features

TRAIN, VALID, TEST = 0, 1, 2
ONE_TIME = "a temporal split needs two distinct times"
ONE_CLASS = "training rows hold one class only"
FEW_ROWS = "too few minority rows to interpolate"
NO_FEATURE = "no base feature within this K"


def _split(rows: DataFrame, test: float, val: float, time: str) -> DataFrame:
    """Rows with `part`: each group's last times are test, those before validation, shares of the group's times."""
    times = rows.filter(F.col(time).isNotNull()).select("group", time).distinct()
    ranked = times.select(
        "group", time, F.row_number().over(Window.partitionBy("group").orderBy(time)).alias("at"),
        F.count(F.lit(1)).over(Window.partitionBy("group")).alias("n"),
    )

    def last(n: str, share: float):
        return F.least(F.greatest(F.lit(1), F.bround(F.col(n) * share).cast("bigint")), F.col(n) - 1)

    sized = ranked.withColumn("rest", F.col("n") - last("n", test)).withColumn("train", F.col("rest") - last("rest", val / (1 - test)))
    bounds = sized.filter("n > 1 AND rest > 1").groupBy("group").agg(
        F.min(F.when(F.col("at") > F.col("train"), F.col(time))).alias("_from"), F.min(F.when(F.col("at") > F.col("rest"), F.col(time))).alias("_test")
    )
    part = F.when(F.col(time) >= F.col("_test"), TEST).when(F.col(time) >= F.col("_from"), VALID).otherwise(TRAIN)
    return rows.filter(F.col(time).isNotNull()).join(bounds, "group").withColumn("part", part).drop("_from", "_test")


def _synthetic(train: DataFrame, minor: DataFrame, variants: list[tuple], trials: list[tuple], k: int, seed: int) -> DataFrame:
    """`group, row_id, model, target, x`: rows between minority rows and neighbours found in each variant's features.

    `variants` are `(group, variant, number, features)` with a number that stands for group and variant, `trials`
    `(number, model, wanted, smallest class, neighbours)`. Every minority row serves equally often; hashes of the
    seed choose its neighbour and the fraction. Neighbours are found once for all trials.
    """
    spark = train.sparkSession
    sets = spark.createDataFrame(variants, "group int, variant int, number int, chosen array<int>")
    asked = spark.createDataFrame(trials, "number int, model int, wanted bigint, smallest bigint, k int")
    pool = durable(train.join(minor, ["group", "target"]).select("group", F.col("row_id").alias("id"), "target", "x"))
    own = pool.join(sets, "group").select(F.col("number").alias("group"), "id", F.transform("chosen", lambda i: F.col("x")[i]).alias("x"))
    near = durable(nearest(own, k))
    hashed = own.select(F.col("group").alias("number"), "id", F.xxhash64(F.lit(seed), "id").alias("_h")).withColumns(
        {"_bucket": F.shiftright("_h", 52).cast("bigint"), "_one": F.lit(1)}
    )
    ranked = running_totals(hashed, ["number"], [F.col("_h"), F.col("id")], {"_pos": "_one"})
    copies = F.floor(F.col("wanted") / F.col("smallest")) + (F.col("_pos") <= F.col("wanted") % F.col("smallest")).cast("bigint")
    drawn = ranked.join(asked, "number").withColumn("_n", copies).filter("_n > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_n").cast("int"))))
    drawn = drawn.withColumns(
        {
            "rank": F.pmod(F.xxhash64(F.lit(seed), F.lit("near"), "id", "_copy"), F.col("k")).cast("int"),
            "_u": F.pmod(F.xxhash64(F.lit(seed), F.lit("step"), "id", "_copy"), F.lit(1_000_003)) / 1_000_003,
        }
    )
    pairs = drawn.join(near.withColumnRenamed("group", "number"), ["number", "id", "rank"]).join(sets.select("number", "group"), "number")
    one = pool.select("group", "id", "target", "x")
    two = pool.select("group", F.col("id").alias("near_id"), F.col("x").alias("y"))
    both = pairs.join(one, ["group", "id"]).join(two, ["group", "near_id"])
    return both.select(
        "group", F.xxhash64(F.lit(seed), "id", "_copy").alias("row_id"), "model", "target",
        F.transform(F.arrays_zip("x", "y"), lambda p: p["x"] + F.col("_u") * (p["y"] - p["x"])).alias("x"),
    )


def _thresholds(counts: DataFrame, far_cap: float) -> DataFrame:
    """`group, model, threshold, tp, fp, p, n`: best sensitivity under the cap on validation, by model."""
    key = ["group", "model"]
    valid = counts.filter(F.col("part") == VALID)
    sums = valid.groupBy(*key).agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    points = spread_totals(valid, key, "score", {"tp": "pos", "fp": "neg"}, desc=True)
    silent = sums.select(*key, F.lit(None).cast("double").alias("score"), F.lit(0).cast("bigint").alias("tp"), F.lit(0).cast("bigint").alias("fp"))
    every = points.select(*key, "score", "tp", "fp").unionByName(silent).join(sums, key)
    cap = min(max(far_cap, 0.0), 1.0)
    allowed = every.filter((F.col("p") > 0) & (F.col("n") > 0) & (F.col("fp") / F.col("n") <= cap + 1e-12))
    best = allowed.groupBy(*key).agg(F.max(F.struct("tp", (-F.col("fp")).alias("less"), "score")).alias("b"))
    chosen = sums.join(best, key, "left")
    one_class = (F.col("p") == 0) | (F.col("n") == 0)
    at = F.when(one_class, F.lit(0.5)).otherwise(F.col("b.score"))
    return chosen.select(*key, at.alias("threshold"), F.col("b.tp").alias("tp"), (-F.col("b.less")).alias("fp"), "p", "n")


def _areas(counts: DataFrame) -> DataFrame:
    """Exact area under the ROC curve by group, model and part; one class gives 0.5."""
    key = ["group", "model", "part"]
    below = spread_totals(counts, key, "score", {"cum": "neg"})
    area = F.try_divide(F.sum(F.col("pos") * (F.col("cum") - F.col("neg") / 2)), F.sum("pos").cast("double") * F.sum("neg"))
    return below.groupBy(*key).agg(F.coalesce(area, F.lit(0.5)).alias("auc"))


def _rates(tp: int, fp: int, p: int, n: int) -> dict:
    tn, fn = n - fp, p - tp

    def ratio(a: float, b: float) -> float:
        return a / b if b else 0.0

    return {
        "accuracy": ratio(tp + tn, p + n), "precision": ratio(tp, tp + fp), "recall": ratio(tp, p), "f1": ratio(2 * tp, 2 * tp + fp + fn),
        "far": ratio(fp, n), "sensitivity": ratio(tp, p), "fnr": ratio(fn, p),
    }


def forest_study(
    rows: DataFrame,
    names: dict[int, str],
    ks: Iterable[int] | None,
    draw: Callable[[np.random.Generator], dict],
    value_of: Callable[[dict, str], float | None],
    *,
    trials: int = 20,
    far_cap: float = 0.2,
    objective: str = "far",
    ratios: tuple[float, float] = (0.1, 1.0),
    neighbours: tuple[int, int] = (1, 5),
    seed: int = 42,
    test: float = 0.2,
    val: float = 0.2,
    rank_trees: int = 100,
    rank_depth: int = 10,
    time: str = "interval_start",
) -> list[dict]:
    """One result per group, K and feature family (Base, Base+Cluster): the best of `trials` draws on validation, tested.

    `rows` has an int `group`, a bigint `row_id` (unique in a group), `target` and the features. K None stands
    for all features. A group that cannot be split or fitted gives rows with its error; the others do not wait.
    """
    features = numeric_features(rows, exclude=["row_id", "group"])
    clusters = set(cluster_features(features))
    ks = list(ks) if ks else [len(features)]
    filled = F.array(*[F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(0.0)) for c in features])
    held = durable(_split(rows.select("group", "row_id", time, F.col("target").cast("int").alias("target"), filled.alias("x")), test, val, time).drop(time))
    by_class: dict[int, dict[int, int]] = {}
    parts = held.groupBy("group", "part", "target").agg(F.count(F.lit(1)).alias("n")).collect()
    for r in parts:
        if r["part"] == TRAIN and r["target"] is not None:
            by_class.setdefault(r["group"], {})[r["target"]] = r["n"]
    split = {r["group"] for r in parts}
    out: list[dict] = []

    def failed(group: int, error: str, todo: Iterable[tuple[int, str]]) -> None:
        out.extend({"section": names[group], "result_type": t, "k": k, "error": error} for k, t in todo)

    every = [(k, t) for k in ks for t in ("Base", "Base+Cluster")]
    fit: list[int] = []
    for g in names:
        n = by_class.get(g, {})
        error = None if g in split else ONE_TIME
        error = error or (None if len(n) == 2 else ONE_CLASS) or (None if min(n.values()) > 1 else FEW_ROWS)
        if error:
            failed(g, error, every)
        else:
            fit.append(g)
    if not fit:
        return out

    train = held.filter((F.col("part") == TRAIN) & F.col("target").isin(0, 1) & F.col("group").isin(fit))
    cuts = grove.cut_points(train, len(features))
    known = held.filter(F.col("target").isin(0, 1) & F.col("group").isin(fit)).withColumn("model", F.lit(None).cast("int"))
    known = durable(grove.with_bins(known, cuts).repartitionByRange("group", "row_id"))
    learn = known.filter(F.col("part") == TRAIN).drop("part")

    def balanced(n0: int, n1: int) -> tuple[float, float]:
        return (n0 + n1) / (2 * n0), (n0 + n1) / (2 * n1)

    all_features = list(range(len(features)))
    rankers = [grove.Forest(g, 0, all_features, rank_trees, rank_depth, balanced(by_class[g][0], by_class[g][1]), seed) for g in fit]
    grove.grow(learn, rankers)

    rng = np.random.default_rng(seed)
    drawn = [(draw(rng), float(rng.uniform(*ratios)), int(rng.integers(neighbours[0], neighbours[1] + 1))) for _ in range(trials)]
    sets: list[tuple[int, int, str, list[int]]] = []  # group, k, result type, features
    for forest in rankers:
        gains = forest.importance(len(features))
        ranked = sorted(all_features, key=lambda i: (-gains[i], features[i]))
        base = [i for i in ranked if features[i] not in clusters]
        for k in ks:
            both = ranked[:k]
            for kind, chosen in (("Base", base[: len([i for i in both if features[i] not in clusters])]), ("Base+Cluster", both)):
                if chosen:
                    sets.append((forest.group, k, kind, chosen))
                else:
                    failed(forest.group, NO_FEATURE, [(k, kind)])

    forests, asked, variants, smaller = [], [], [], {}
    for number, (g, _, _, chosen) in enumerate(sets):
        n = by_class[g]
        small = min(n, key=lambda c: (n[c], -c))
        smaller[g] = small
        variants.append((g, number, number, chosen))
        for t, (params, ratio, near) in enumerate(drawn):
            model = number * trials + t
            wanted = max(0, int(n[1 - small] * ratio) - n[small])
            made = {small: n[small] + wanted, 1 - small: n[1 - small]}
            depth = int(params.get("max_depth", 10))
            forests.append(grove.Forest(g, model, chosen, int(params.get("n_trees", 100)), depth, balanced(made[0], made[1]), seed))
            if wanted:
                asked.append((number, model, wanted, n[small], max(1, min(near, n[small] - 1))))
    everything = learn
    if asked:
        minor = held.sparkSession.createDataFrame(list(smaller.items()), "group int, target int")
        made = _synthetic(train, minor, variants, asked, max(a[4] for a in asked), seed)
        made = grove.with_bins(made, cuts).repartitionByRange("group", "row_id")
        everything = durable(learn.select("group", "row_id", "model", "target", "bins").unionByName(made))
    grove.grow(everything, forests)

    counts = durable(grove.score_counts(known.filter(F.col("part") > TRAIN), forests))
    points = {(r["group"], r["model"]): r for r in _thresholds(counts, far_cap).collect()}
    areas = {(r["group"], r["model"], r["part"]): r["auc"] for r in _areas(counts).collect()}
    winners = []
    for number, (g, k, kind, _) in enumerate(sets):
        best = None
        for t, (params, ratio, near) in enumerate(drawn):
            model = number * trials + t
            at = points.get((g, model))
            if at is None:
                continue
            rates = _rates(at["tp"] or 0, at["fp"] or 0, at["p"], at["n"]) if at["tp"] is not None else {"far": None, "sensitivity": None}
            rates["auc"] = areas.get((g, model, VALID), 0.5)
            value = value_of({**_rates(0, 0, 0, 0), **rates}, objective)
            if best is None or value > best["val_objective"]:
                best = {
                    "section": names[g], "result_type": kind, "k": k, "group": g, "number": model, "val_objective": value, "threshold": at["threshold"],
                    "params": str({**params, "ratio": round(ratio, 4), "neighbours": near}), "trials": trials, "pruned": 0,
                }
        if best is None:
            failed(g, "no row to choose a threshold on", [(k, kind)])
        else:
            winners.append(best)
    if winners:
        chosen = held.sparkSession.createDataFrame([(w["group"], w["number"], w["threshold"]) for w in winners], "group int, model int, threshold double")
        tested = counts.filter(F.col("part") == TEST).join(chosen, ["group", "model"])
        alarm = F.coalesce(F.col("score") >= F.col("threshold"), F.lit(False))
        found = tested.groupBy("group", "model").agg(
            F.sum(F.when(alarm, F.col("pos")).otherwise(0)).alias("tp"), F.sum(F.when(alarm, F.col("neg")).otherwise(0)).alias("fp"),
            F.sum("pos").alias("p"), F.sum("neg").alias("n"),
        )
        at = {(r["group"], r["model"]): r for r in found.collect()}
        for w in winners:
            r = at.get((w["group"], w["number"]))
            rates = _rates(r["tp"], r["fp"], r["p"], r["n"]) if r else {}
            out.append({**w, **rates, "auc": areas.get((w["group"], w["number"], TEST)) if r else None, "error": None})
    order = {n: i for i, n in enumerate(names.values())}
    return sorted(out, key=lambda r: (order[r["section"]], r["k"], r["result_type"]))
