"""Hyper-parameter sweeps and model studies over sections and windows."""

from __future__ import annotations

import threading
from collections.abc import Callable, Iterable, Sequence

import numpy as np
from pyspark.errors import IllegalArgumentException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tollspan.operators import balance, evaluate, models
from tollspan.operators.clean import filter_section, section_keys
from tollspan.operators.cluster import together
from tollspan.operators.joint_study import forest_study
from tollspan.session import durable
from tollspan.sources.ingest import cluster_features, numeric_features

# Default search ranges.
SPACES = {
    "forest": {"n_trees": (50, 200), "max_depth": (3, 20)},
    "boosting": {"n_trees": (50, 200), "max_depth": (2, 10), "rate": (0.01, 0.3), "subsample": (0.5, 1.0)},
    "svm": {"c": (0.1, 10.0)},
}
RESULT = (
    "section string, result_type string, k int, model string, trials int, pruned int, params string, threshold double, "
    "val_objective double, f1 double, far double, sensitivity double, accuracy double, auc double, error string"
)
#: Tree nodes that the models of fits under way may hold on the driver.
MOST_NODES = 1 << 22
#: Data that cannot be fitted. A lost executor or lack of memory is none of these and ends the run.
UNFIT = (ValueError, IllegalArgumentException)


class NoTrial(ValueError):
    """No draw of a search could be fitted."""


_FIELDS = [part.split()[0] for part in RESULT.split(", ")]


def draw_params(kind: str, rng: np.random.Generator, space: dict | None = None) -> dict:
    out = {}
    for name, (a, b) in (space or SPACES[kind]).items():
        whole = isinstance(a, int) and isinstance(b, int)
        out[name] = int(rng.integers(a, b + 1)) if whole else float(rng.uniform(a, b))
    return out


def _rates(scored: DataFrame, threshold: float | None, auc: bool = True) -> dict:
    alarm = F.lit(False) if threshold is None else F.col("score") >= threshold
    row = evaluate.evaluation(scored, alarm).first().asDict()
    row["auc"] = evaluate.roc_auc(scored).first()["auc"] if auc else None
    return row


def _objective(rates: dict, name: str) -> float | None:
    """Value to maximise; a rate that a single class leaves undefined counts as 0, so such a trial is no failure."""
    rates = {k: 0.0 if v is None else v for k, v in rates.items()}
    if name == "far":
        return -(rates["far"] - 0.001 * rates["sensitivity"])
    return -rates[name] if name == "fnr" else rates[name]


def search(
    train: DataFrame,
    val: DataFrame,
    test: DataFrame,
    features: Sequence[str],
    kind: str = "forest",
    *,
    trials: int = 20,
    far_cap: float = 0.2,
    objective: str = "far",
    ratios: tuple[float, float] = (0.1, 1.0),
    neighbours: tuple[int, int] = (1, 5),
    space: dict | None = None,
    seed: int = 42,
) -> dict:
    """Seeded random search: balance, fit, threshold and score on validation; then test the best.

    The number of neighbours of synthetic rows is drawn too. Test rows never take part in the choice. A draw
    that cannot be fitted (too few rows of a class for it) is counted as pruned; any other failure ends the sweep.
    Neighbours are found once for all draws, and several draws are fitted at a time. Train and validation rows are
    written first, so that no job of a draw carries the plan that made them.
    """
    train, val = durable(train), durable(val)
    rng = np.random.default_rng(seed)
    drawn = [
        (draw_params(kind, rng, space), float(rng.uniform(*ratios)), int(rng.integers(neighbours[0], neighbours[1] + 1))) for _ in range(trials)
    ]
    try:
        rows = sum(balance.class_sizes(train)[1:])
        near = balance.minority_neighbours(train, features, max((k for _, _, k in drawn), default=1))
    except UNFIT as e:
        raise NoTrial("every trial failed") from e
    best, pruned, one = None, 0, threading.Lock()

    def tried(number: int) -> None:
        nonlocal best, pruned
        params, ratio, k = drawn[number]
        kept: list[DataFrame] = []
        try:
            made = balance.smote(train, features, k=k, ratio=ratio, seed=seed, near=near, ordered=True).persist()
            kept.append(made)
            model = models.fit_model(made, features, kind, params, seed)
            scored = models.with_score(model, val, features).select("target", "score").persist()
            kept.append(scored)
            point = evaluate.far_threshold(scored, far_cap).first()
            threshold, rates = point["threshold"], point.asDict()
            if objective not in ("far", "sensitivity"):
                rates = _rates(scored, threshold, auc=objective == "auc")
            value = _objective(rates, objective)
        except UNFIT:
            with one:
                pruned += 1
            return
        finally:
            for df in kept:
                df.unpersist()
        with one:  # only the best model stays; the first of equal ones
            if best is None or (value, -number) > (best["val_objective"], -best["number"]):
                best = {"params": {**params, "ratio": round(ratio, 4), "neighbours": k}, "threshold": threshold, "val_objective": value, "model": model, "number": number}

    for part in _rounds([_most_nodes(kind, params, rows, ratio) for params, ratio, _ in drawn]):
        together(train.sparkSession, [lambda number=number: tried(number) for number in part])
    if best is None:
        raise NoTrial("every trial failed")
    del best["number"]
    scored = models.with_score(best["model"], test, features).select("target", "score")
    return {**best, **_rates(scored, best["threshold"]), "trials": trials, "pruned": pruned}


def _most_nodes(kind: str, params: dict, rows: int, ratio: float) -> int:
    """Nodes that a model's trees have at most: two for each train row, and no level holds more than twice the one above."""
    if kind == "svm":
        return 0
    leaves = rows + int(rows * ratio)
    return int(params.get("n_trees", 100)) * min(2 * leaves, 2 ** (int(params.get("max_depth", 10)) + 1))


def _rounds(nodes: Sequence[int]) -> list[list[int]]:
    """Numbers of the models to fit together: as many as MOST_NODES has room for, one at least."""
    out: list[list[int]] = []
    room = 0
    for number, n in enumerate(nodes):
        if not out or room + n > MOST_NODES:
            out.append([])
            room = 0
        out[-1].append(number)
        room += n
    return out


def outcome(train: DataFrame, val: DataFrame, test: DataFrame, features: Sequence[str], *, trials: int = 20, **kw) -> dict:
    """What `search` finds; where no draw can be fitted (one class only, say) all trials are pruned and nothing else is known."""
    try:
        return search(train, val, test, features, trials=trials, **kw)
    except NoTrial:
        return {"trials": trials, "pruned": trials}


def _result(section: str, result_type: str, k: int, kind: str, run: Callable[[], dict]) -> tuple:
    row = {"section": section, "result_type": result_type, "k": k, "model": kind, "error": None}
    try:
        found = run()
        row.update({f: found.get(f) for f in _FIELDS if f in found and f != "model"}, params=str(found["params"]))
    except UNFIT as e:
        row["error"] = str(e)
    return tuple(row.get(f) for f in _FIELDS)


def k_values(first: int, last: int, step: int, available: int) -> list[int]:
    """K list with the final K appended, clipped to the features there are."""
    top = max(1, min(last, available))
    return sorted({min(k, top) for k in [*range(first, last + 1, step), last]})


def top_k_rows(
    data: DataFrame, ks: Iterable[int], kind: str, section: str = "all", test: float = 0.2, val: float = 0.2, **kw
) -> list[tuple]:
    """Base against base plus cluster for each K, features taken in order of importance on train."""
    features = numeric_features(data, exclude=["row_id"])
    clusters = set(cluster_features(features))
    train, valid, tested = (d.persist() for d in evaluate.three_way_split(data, test, val, of_whole=True))
    ranked = [r["variable"] for r in models.feature_importance(train, features).collect()]
    base = [c for c in ranked if c not in clusters]
    rows = []
    for k in ks:
        both = ranked[:k]
        base_k = k - sum(c in clusters for c in both)
        for name, chosen in (("Base", base[:base_k]), ("Base+Cluster", both)):
            if not chosen:
                rows.append(_result(section, name, k, kind, lambda: _fail("no base feature within this K")))
                continue
            rows.append(_result(section, name, k, kind, lambda c=chosen: search(train, valid, tested, c, kind, **kw)))
    for d in (train, valid, tested):
        d.unpersist()
    return rows


def _fail(text: str) -> dict:
    raise ValueError(text)


def _joint(rows: DataFrame, names: dict[int, str], ks: Iterable[int] | None, space: dict | None = None, **kw) -> list[tuple]:
    """Result rows of a forest study over all groups of `rows` together."""
    found = forest_study(rows, names, ks, lambda rng: draw_params("forest", rng, space), _objective, **kw)
    return [tuple({"model": "forest", **r}.get(f) for f in _FIELDS) for r in found]


def top_k_sweep(data: DataFrame, ks: Iterable[int], kind: str = "forest", **kw) -> DataFrame:
    """Base against base plus cluster for each K. Forests grow together, other kinds one after the other."""
    if kind == "forest":
        rows = _joint(data.withColumn("group", F.lit(0)), {0: "all"}, ks, **kw)
    else:
        rows = top_k_rows(data, ks, kind, **kw)
    return data.sparkSession.createDataFrame(rows, RESULT)


def section_study(
    data: DataFrame, sections: Sequence[tuple[str, str]], ks: Iterable[int] | None = None, kind: str = "forest", **kw
) -> DataFrame:
    """Each section on its own, for one K or several; a section that cannot be fitted is an error row.

    The forests of all sections grow together. Other kinds take one section after the other.
    """
    if kind == "forest":
        first, last = section_keys(data.columns)
        named = [(i, str(a), str(b)) for i, (a, b) in enumerate(sections)]
        of = data.sparkSession.createDataFrame(named, "group int, _first string, _last string")
        same = F.col(first).cast("string") == F.col("_first")
        if last:
            same = same & (F.col(last).cast("string") == F.col("_last"))
        rows = data.join(of, same).drop("_first", "_last")
        return data.sparkSession.createDataFrame(_joint(rows, {i: f"{a}-{b}" for i, a, b in named}, ks, **kw), RESULT)
    rows: list[tuple] = []
    for first, last in sections:
        part = filter_section(data, first, last)
        name = f"{first}-{last}"
        every = len(numeric_features(data, exclude=["row_id"]))
        try:
            rows += top_k_rows(part, ks or [every], kind, name, **kw)
        except UNFIT as e:
            for kind_of in ("Base", "Base+Cluster"):
                rows.append(_result(name, kind_of, every, kind, lambda e=e: _fail(str(e))))
    return data.sparkSession.createDataFrame(rows, RESULT)


def window_study(data: DataFrame, windows: DataFrame, n: int, ks: Iterable[int], kind: str = "forest", **kw) -> DataFrame:
    """Models for the `n` busiest windows: the section's rows within each window. Forests grow together."""
    spark: SparkSession = data.sparkSession
    rows: list[tuple] = []
    ks = list(ks)
    kept = ("gantry_last", "gantry_next", "window_start", "window_end")
    top = [tuple(w[c] for c in kept) for w in windows.limit(n).select(*kept).collect()]

    def name(w: tuple) -> str:
        return f"{w[0]}-{w[1]} from {w[2]}"

    if kind == "forest":
        if not top:
            return spark.createDataFrame([], RESULT)
        of = spark.createDataFrame([(i, str(w[0]), str(w[1]), str(w[2]), str(w[3])) for i, w in enumerate(top)],
                                   "group int, _a string, _b string, _from string, _to string")
        inside = F.col("interval_start").between(F.col("_from").cast("timestamp_ntz"), F.col("_to").cast("timestamp_ntz"))
        same = (F.col("gantry_last").cast("string") == F.col("_a")) & (F.col("gantry_next").cast("string") == F.col("_b"))
        held = data.join(of, same & inside).drop("_a", "_b", "_from", "_to")
        return spark.createDataFrame(_joint(held, {i: name(w) for i, w in enumerate(top)}, ks, **kw), RESULT)
    for w in top:
        part = filter_section(data, w[0], w[1]).filter(
            F.col("interval_start").between(F.lit(w[2]).cast("timestamp_ntz"), F.lit(w[3]).cast("timestamp_ntz"))
        )
        try:
            rows += top_k_rows(part, ks, kind, name(w), **kw)
        except UNFIT as e:
            rows.append(_result(name(w), "Base", ks[0], kind, lambda e=e: _fail(str(e))))
    return spark.createDataFrame(rows, RESULT)
