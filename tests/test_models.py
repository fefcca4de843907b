"""Properties of clustering, balancing and model selection."""

from __future__ import annotations

import threading

import numpy as np
import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from tollspan.operators import balance, cluster, density, evaluate, models, nearest, study
from tollspan.plans import QUERIES, q_model


@pytest.fixture(scope="module")
def blobs(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(c, 0.3, (60, 2)) for c in ((0, 0), (4, 0), (0, 5))])
    return spark.createDataFrame([(f"p{i:03d}", float(a), float(b)) for i, (a, b) in enumerate(x)], "plate string, a double, b double").persist()


def test_rare_plate_is_unknown_iff_far(spark, blobs):
    rare = spark.createDataFrame([("near", 4.0, 0.1), ("far", 50.0, 50.0)], "plate string, a double, b double")
    stats = cluster.standardise(blobs, blobs, ["a", "b"])
    labels, limit = cluster.label_plates(blobs, rare, ["a", "b"], cluster.fit_kmeans(stats, 3, restarts=2))
    got = {r["plate"]: r for r in labels.filter("is_rare").collect()}
    assert got["far"]["cluster_label"] == -1 and got["near"]["cluster_label"] >= 0
    assert all((r["cluster_label"] == -1) == (r["confidence_score"] > limit) for r in got.values())
    assert labels.filter("NOT is_rare AND cluster_label < 0").count() == 0


@pytest.mark.parametrize("kind", ["full", "tied", "diag", "spherical"])
def test_mixture_finds_blobs(blobs, kind):
    x = cluster.standardise(blobs, blobs, ["a", "b"])
    m = cluster.fit_mixture(x, 3, kind)
    out = cluster.with_responsibilities(x, m)
    sums = out.select(F.aggregate("resp", F.lit(0.0), lambda s, v: s + v).alias("s")).collect()
    assert all(abs(r["s"] - 1) < 1e-9 for r in sums)
    assert sorted(r["count"] for r in out.groupBy("cluster_label").count().collect()) == [60, 60, 60]
    assert m.weights.sum() == pytest.approx(1.0) and m.bic > m.aic


def test_own_and_builtin_mixture_agree(blobs):
    x = cluster.standardise(blobs, blobs, ["a", "b"])
    ours, theirs = cluster.fit_mixture(x, 3, "full"), cluster.fit_gaussian_mixture(x, 3, restarts=2)
    assert np.allclose(ours.means, theirs.means, atol=1e-2)
    assert ours.log_likelihood == pytest.approx(theirs.log_likelihood, rel=1e-2)


def _density_by_hand(keys, x, eps, min_samples, least):
    near = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    core = (near <= eps).sum(1) >= min_samples
    group = np.full(len(x), -1)
    for i in np.flatnonzero(core):
        if group[i] < 0:
            group[i], todo = i, [i]
            while todo:
                more = np.flatnonzero(core & (group < 0) & (near[todo.pop()] <= eps))
                group[more] = i
                todo += more.tolist()
    first = {g: min(keys[j] for j in np.flatnonzero(group == g)) for g in set(group[core].tolist())}
    name = [first.get(g) for g in group.tolist()]
    for i in np.flatnonzero(~core):
        at = [(near[i, j], first[group[j]]) for j in np.flatnonzero(core & (near[i] <= eps))]
        name[i] = min(at)[1] if at else None
    sizes = {n: name.count(n) for n in set(name) - {None}}
    order = sorted((n for n in sizes if sizes[n] >= least), key=lambda n: (-sizes[n], n))
    return {k: order.index(n) if n in order else -1 for k, n in zip(keys, name, strict=True)}


def test_density_level_equals_brute_force_wherever_the_origin_is(spark, monkeypatch):
    monkeypatch.setattr(nearest, "CELL_POINTS", 10)  # several cells, and cells of several blocks
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(c, 0.3, (50, 2)) for c in ((0, 0), (3, 0), (0, 4))] + [rng.uniform(-3, 6, (30, 2)), np.tile([[9.0, 9.0]], (80, 1))])
    keys = [f"p{i:03d}" for i in range(len(x))]
    want = _density_by_hand(keys, x, 0.5, 5, 10)
    assert len(set(want.values())) >= 4 and -1 in want.values()
    for move in (0.0, 0.25):
        df = spark.createDataFrame([(k, [float(v) for v in r + move]) for k, r in zip(keys, x, strict=True)], "plate string, x array<double>").repartition(3)
        got = density.density_level(df, "plate", eps=0.5, min_samples=5, min_cluster_size=10)
        assert {r["plate"]: r["cluster_label"] for r in got.collect()} == want
    assert density.density_level(df.limit(0), "plate").count() == 0
    odd = spark.createDataFrame([("a", None), ("b", [1.0])], "plate string, x array<double>")
    assert {tuple(r) for r in density.density_level(odd, "plate").collect()} == {("a", -1), ("b", -1)}


def test_neighbours_equal_brute_force(blobs):
    rows = blobs.withColumn("row_id", F.substring("plate", 2, 3).cast("bigint"))
    got: dict = {}
    for r in balance.neighbours(rows, ["a", "b"], 4).collect():
        got.setdefault(r["row_id"], {})[r["rank"]] = r["near_id"]
    x = np.array([[r["a"], r["b"]] for r in rows.orderBy("row_id").collect()])
    d = ((x[:, None, :] - x[None, :, :]) ** 2).sum(-1)
    np.fill_diagonal(d, np.inf)
    for i in range(len(x)):
        assert [got[i][j] for j in range(4)] == list(np.argsort(d[i], kind="stable")[:4])


@pytest.fixture(scope="module")
def slots(spark):
    rng = np.random.default_rng(5)
    data = []
    for i in range(240):
        y = int(rng.random() < 0.2)
        data.append((i, f"2024-01-01 {i // 12:02d}:{i % 12 * 5:02d}:00", y, float(rng.normal(2.0 * y, 1)), float(rng.normal())))
    df = spark.createDataFrame(data, "row_id bigint, t string, target int, flow_a double, cluster_b double")
    return df.withColumn("interval_start", F.col("t").cast("timestamp_ntz")).drop("t").persist()


def test_smote_counts_and_bounds(slots):
    out = balance.smote(slots, ["flow_a", "cluster_b"], ratio=0.8, k=3).persist()
    n0, n1 = (slots.filter(F.col("target") == c).count() for c in (0, 1))
    made = out.filter("synthetic")
    assert made.count() == int(n0 * 0.8) - n1
    assert made.filter("target <> 1 OR interval_start IS NOT NULL").count() == 0
    box = slots.filter("target = 1").agg(F.min("flow_a"), F.max("flow_a"), F.min("cluster_b"), F.max("cluster_b")).first()
    assert made.filter(~F.col("flow_a").between(box[0], box[1]) | ~F.col("cluster_b").between(box[2], box[3])).count() == 0
    assert out.filter("NOT synthetic").count() == n0 + n1


def test_validation_keeps_synthetic_in_train(slots):
    rows = slots.withColumn("synthetic", F.col("row_id") % 4 == 0)
    train, val = evaluate.validation_split(rows, 0.25)
    assert val.filter("synthetic").count() == 0
    assert train.count() + val.count() == rows.count()


@pytest.mark.parametrize(("kind", "params"), [("forest", {"n_trees": 5, "max_depth": 3}), ("boosting", {"n_trees": 3, "max_depth": 2}),
                                              ("svm", {"max_iter": 5}), ("svm", {"kernel": "rbf", "width": 8, "max_iter": 5})])
def test_models_score_and_reload(spark, slots, tmp_path, kind, params):
    features = ["flow_a", "cluster_b"]
    model = models.fit_model(slots, features, kind, params)
    path = models.save_model(model, str(tmp_path), "run")
    a = models.with_score(model, slots, features).orderBy("row_id").select("score").collect()
    b = models.with_score(models.load_model(spark, path), slots, features).orderBy("row_id").select("score").collect()
    assert a == b and all(0.0 <= r["score"] <= 1.0 for r in a)


def test_models_work_in_an_observed_session(slots):
    assert slots.observe(Observation("seen"), F.count(F.lit(1)).alias("n")).count() == 240
    for kind, params in (("forest", {"n_trees": 2, "max_depth": 2}), ("svm", {"max_iter": 2})):
        model = models.fit_model(slots, ["flow_a", "cluster_b"], kind, params)
        assert models.with_score(model, slots, ["flow_a", "cluster_b"]).count() == 240


def test_search_respects_false_alarm_cap(slots):
    train, val, test = evaluate.three_way_split(slots, 0.2, 0.3)
    found = study.search(train, val, test, ["flow_a", "cluster_b"], trials=1, far_cap=0.2, space={"n_trees": (5, 6), "max_depth": (2, 3)})
    scored = models.with_score(found["model"], val, ["flow_a", "cluster_b"])
    alarm = F.lit(False) if found["threshold"] is None else F.col("score") >= found["threshold"]
    assert evaluate.evaluation(scored, alarm).first()["far"] <= 0.2 + 1e-12
    assert found["pruned"] == 0


def test_k_values_append_and_clip():
    assert study.k_values(5, 20, 5, 12) == [5, 10, 12]
    assert study.k_values(5, 12, 5, 50) == [5, 10, 12]


def test_sweep_records_both_types_and_errors(slots):
    out = study.top_k_sweep(slots, [1, 2], trials=1, space={"n_trees": (4, 5), "max_depth": (2, 3)}).collect()
    assert {r["result_type"] for r in out} == {"Base", "Base+Cluster"}
    failed = study.section_study(slots.withColumns({"gantry_last": F.lit("1"), "gantry_next": F.lit("2")}), [("8", "9")]).collect()
    assert len(failed) == 2 and all(r["error"] for r in failed)


def test_train_rows_of_one_class_stay_as_they_are(slots):
    features = ["flow_a", "cluster_b"]
    one, test = slots.filter("target = 1"), slots.filter("target = 0")
    out = balance.balanced_dataset(one, test, features)
    assert out.filter("split = 'train' AND NOT synthetic").count() == one.count()
    assert out.filter("split = 'test' AND NOT synthetic").count() == test.count()
    assert out.count() == slots.count()
    with pytest.raises(ValueError):
        balance.smote(one, features)


def test_search_without_a_fit_prunes_every_trial(slots):
    one = slots.filter("target = 1")
    assert study.outcome(one, one, one, ["flow_a"], trials=2) == {"trials": 2, "pruned": 2}


def test_parameter_sweep_covers_the_whole_search_ranges(spark, slots, monkeypatch):
    """All trials of a sweep, drawn from the library's own ranges; fits are small here and only note what was asked."""
    asked, fit = [], models.fit_model

    def noted(train, features, kind, params, seed):
        asked.append(params)
        return fit(train, features, kind, {"n_trees": 2, "max_depth": 2}, seed)

    monkeypatch.setattr(models, "fit_model", noted)
    monkeypatch.setattr(q_model, "dataset", lambda spark, sf: slots)
    found = QUERIES["ML23_parameter_sweep"](spark, "").first()
    assert (found["trials"], found["pruned"], len(asked)) == (20, 0, 20)
    trees, depths = [p["n_trees"] for p in asked], [p["max_depth"] for p in asked]
    assert 50 <= min(trees) < 80 and 170 < max(trees) <= 200
    assert 3 <= min(depths) < 6 and 17 < max(depths) <= 20


def test_sweep_finds_neighbours_once_for_the_same_rows(slots, monkeypatch):
    features = ["flow_a", "cluster_b"]
    near = balance.minority_neighbours(slots, features, 5)

    def made(**kw):
        out = balance.smote(slots, features, ratio=0.8, k=3, **kw).select("row_id", "target", "synthetic", *features)
        return sorted((tuple(r) for r in out.collect()), key=repr)

    assert made() == made(near=near) == made(near=near, ordered=True)
    searched, find = [], balance.nearest
    monkeypatch.setattr(balance, "nearest", lambda rows, k: (searched.append(k), find(rows, k))[1])
    train, val, test = evaluate.three_way_split(slots, 0.2, 0.3)
    space = {"n_trees": (2, 9), "max_depth": (2, 3)}
    one, two = (study.search(train, val, test, features, trials=4, space=space, objective=o) for o in ("auc", "auc"))
    assert len(searched) == 2 and one.pop("model") and two.pop("model") and one == two


def test_draws_that_need_much_room_are_fitted_alone(slots, monkeypatch):
    monkeypatch.setattr(study, "MOST_NODES", 100)
    assert study._rounds([60, 30, 20, 500, 1, 99, 1]) == [[0, 1], [2], [3], [4, 5], [6]]
    assert study._most_nodes("forest", {"n_trees": 10, "max_depth": 20}, 50, 0.5) == 1500
    assert study._most_nodes("forest", {"n_trees": 10, "max_depth": 3}, 50, 0.5) == 160
    train, val, test = evaluate.three_way_split(slots, 0.2, 0.3)
    space = {"n_trees": (2, 9), "max_depth": (2, 3)}
    alone = study.search(train, val, test, ["flow_a", "cluster_b"], trials=4, space=space)
    monkeypatch.undo()
    together = study.search(train, val, test, ["flow_a", "cluster_b"], trials=4, space=space)
    assert alone.pop("model") and together.pop("model") and alone == together


def test_sweep_fits_run_together(blobs, monkeypatch):
    """Fits wait for one another here, so one after the other they would not end."""
    x = cluster.standardise(blobs, blobs, ["a", "b"])
    meeting = threading.Barrier(4, timeout=60)

    class Waiting(cluster.KMeans):
        def fit(self, data):
            meeting.wait()
            return super().fit(data)

    monkeypatch.setattr(cluster, "KMeans", Waiting)
    got = cluster.sweep_kmeans(x, [2, 3], restarts=2).collect()
    assert [r["k"] for r in got] == [2, 3] and got[1]["silhouette"] > max(0.9, got[0]["silhouette"])


def test_mixtures_share_their_passes(blobs, monkeypatch):
    x = cluster.standardise(blobs, blobs, ["a", "b"])
    kinds = ("full", "tied", "diag", "spherical")
    alone = {kind: cluster.fit_mixture(x, 3, kind, restarts=2).log_likelihood for kind in kinds}
    passes, sums = [], cluster._weighted_sums
    monkeypatch.setattr(cluster, "_weighted_sums", lambda data, m: (passes.append(1), sums(data, m))[1])
    longest = 0
    for kind in kinds:
        passes.clear()
        cluster.fit_mixture(x, 3, kind, restarts=2)
        longest = max(longest, len(passes))
    passes.clear()
    got = {r["kind"]: r["log_likelihood"] for r in cluster.sweep_mixture(x, [3], kinds, restarts=2).collect()}
    assert got == pytest.approx(alone) and len(passes) == longest
