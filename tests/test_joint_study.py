"""Forests grown together equal forests grown alone; joint splits, thresholds and neighbours equal the plain forms."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tollspan.operators import evaluate, grove, joint_study, nearest, study


@pytest.fixture(scope="module")
def groups(spark):
    """Three groups of rows with four features, the first far larger; column `x` holds the features."""
    rng = np.random.default_rng(9)
    rows = []
    for group, n in ((0, 600), (1, 80), (2, 60)):
        for i in range(n):
            y = int(rng.random() < 0.3)
            rows.append((group, group * 10_000 + i, y, [float(v) for v in (rng.normal(1.5 * y), rng.normal(), rng.normal(-y), rng.integers(0, 3))]))
    return spark.createDataFrame(rows, "group int, row_id bigint, target int, x array<double>").repartition(5).persist()


@pytest.fixture(scope="module")
def bins(groups):
    rows = groups.withColumn("model", F.lit(None).cast("int"))
    return grove.with_bins(rows, grove.cut_points(groups, 4)).persist()


def _forests():
    made = [grove.Forest(g, m, [0, 1, 2, 3], 3, 3, (1.0, 2.0), seed=m) for g in range(3) for m in range(2)]
    return made


def test_forests_grow_alike_together_and_alone(bins):
    together = _forests()
    grove.grow(bins, together)
    for alone in _forests():
        grove.grow(bins.filter(F.col("group") == alone.group).coalesce(1), [alone])
        assert alone.trees == next(f for f in together if (f.group, f.model) == (alone.group, alone.model)).trees
    assert all(len(t.feature) > 1 for f in together for t in f.trees)


def test_little_room_takes_more_passes_and_gives_the_same(bins, monkeypatch):
    one, two = _forests(), _forests()
    grove.grow(bins, one)
    monkeypatch.setattr(grove, "MOST_COUNTS", 500)
    grove.grow(bins, two)
    assert [f.trees for f in one] == [f.trees for f in two]


def test_root_split_is_the_best_of_all(bins):
    forest = grove.Forest(0, 0, [0, 1, 2, 3], 1, 1, (1.0, 2.5))
    forest.tries = lambda tree, node: np.arange(4)
    rows = bins.filter("group = 0").toPandas()
    b = np.array([list(v) for v in rows["bins"]])
    y, ids = rows["target"].to_numpy(), rows["row_id"].to_numpy()
    forest.trees = [grove.Tree()]
    grove.grow_level(forest, 0, grove.counts_of(forest, 0, b, y, ids), False)
    times = grove.draws(ids, forest.seed, 0)
    w = times * np.where(y == 1, 2.5, 1.0)

    def impurity(m):
        p = w[m & (y == 1)].sum() / w[m].sum()
        return w[m].sum() * 2 * p * (1 - p)

    best = min(
        (impurity(b[:, f] <= c) + impurity(b[:, f] > c), f, c)
        for f in range(4) for c in range(31) if 0 < times[b[:, f] <= c].sum() < times.sum()
    )
    assert (forest.trees[0].feature[0], forest.trees[0].cut[0]) == best[1:]


def test_draws_are_poisson_and_fixed():
    ids = np.arange(200_000)
    n = grove.draws(ids, 42, 3)
    assert abs(n.mean() - 1) < 0.01 and abs(n.var() - 1) < 0.02
    assert (grove.draws(ids[::-1], 42, 3)[::-1] == n).all()
    assert abs(np.corrcoef(n, grove.draws(ids, 42, 4))[0, 1]) < 0.01


def test_scores_are_those_of_a_walk(bins):
    forest = grove.Forest(1, 0, [0, 2], 4, 3)
    grove.grow(bins, [forest])
    rows = bins.filter("group = 1").toPandas()
    b = np.array([list(v) for v in rows["bins"]])
    got = forest.scores(b)
    for row, score in zip(b, got, strict=True):
        total = 0.0
        for t in forest.trees:
            i = 0
            while t.feature[i] >= 0:
                i = t.left[i] if row[t.feature[i]] <= t.cut[i] else t.right[i]
            total += t.counts[i][1] / max(1, sum(t.counts[i]))
        assert score == pytest.approx(total / 4)
    assert forest.importance(4)[[1, 3]].sum() == 0 and forest.importance(4).sum() == pytest.approx(1)


def test_thresholds_and_areas_equal_the_single_forms(spark):
    rng = np.random.default_rng(4)
    rows = [(g, m, p, round(float(rng.random()), 2), int(rng.random() < 0.4)) for g in range(2) for m in range(2) for p in (1, 2) for _ in range(60)]
    rows += [(3, 0, 1, 0.4, 0), (3, 0, 1, 0.7, 0)]
    df = spark.createDataFrame(rows, "group int, model int, part int, score double, target int").persist()
    counts = df.groupBy("group", "model", "part", "score").agg(F.sum("target").alias("pos"), F.sum(1 - F.col("target")).alias("neg"))
    at = {(r["group"], r["model"]): r for r in joint_study._thresholds(counts, 0.2).collect()}
    areas = {(r["group"], r["model"], r["part"]): r["auc"] for r in joint_study._areas(counts).collect()}
    for g, m in at:
        own = df.filter((F.col("group") == g) & (F.col("model") == m) & (F.col("part") == 1))
        want = evaluate.far_threshold(own, 0.2).first()
        assert at[g, m]["threshold"] == want["threshold"]
        if want["far"] is not None:
            assert at[g, m]["fp"] / at[g, m]["n"] == want["far"] and at[g, m]["tp"] / at[g, m]["p"] == want["sensitivity"]
        assert areas[g, m, 1] == pytest.approx(evaluate.roc_auc(own).first()["auc"])


@pytest.fixture(scope="module")
def sections(spark):
    rng = np.random.default_rng(6)
    rows = []
    for a, b in (("1", "2"), ("2", "3"), ("7", "8")):
        for i in range(200):
            y = int(rng.random() < 0.25) if a != "7" else 0
            rows.append((a, b, f"2024-01-01 {i // 12:02d}:{i % 12 * 5:02d}:00", y, float(rng.normal(1.5 * y)), float(rng.normal()), float(rng.normal(y))))
    df = spark.createDataFrame(rows, "gantry_last string, gantry_next string, t string, target int, flow_a double, flow_b double, cluster_c double")
    df = df.withColumn("interval_start", F.col("t").cast("timestamp_ntz")).drop("t")
    return df.withColumn("row_id", F.xxhash64("gantry_last", "interval_start")).persist()


def test_joint_split_equals_three_way_split(sections):
    rows = sections.withColumn("group", F.col("gantry_last").cast("int"))
    got = joint_study._split(rows, 0.2, 0.25, "interval_start")
    for g in (1, 2, 7):
        parts = evaluate.three_way_split(rows.filter(F.col("group") == g), 0.2, 0.25, of_whole=True)
        for number, part in enumerate(parts):
            mine = got.filter((F.col("group") == g) & (F.col("part") == number)).select("row_id").collect()
            assert sorted(r[0] for r in mine) == sorted(r[0] for r in part.select("row_id").collect())


def test_section_study_has_every_section_and_k(sections):
    small = {"trials": 2, "space": {"n_trees": (4, 6), "max_depth": (2, 3)}, "rank_trees": 5, "rank_depth": 3}
    asked = [("1", "2"), ("2", "3"), ("7", "8"), ("8", "9")]
    out = study.section_study(sections, asked, [1, 3], **small).collect()
    assert len(out) == len(asked) * 2 * 2
    good = [r for r in out if r["section"] in ("1-2", "2-3") and r["error"] is None]
    assert len(good) >= 6 and all(r["far"] is not None and r["trials"] == 2 for r in good)
    assert {r["error"] for r in out if r["section"] == "7-8"} == {joint_study.ONE_CLASS}
    assert {r["error"] for r in out if r["section"] == "8-9"} == {joint_study.ONE_TIME}
    # a section's rows do not depend on the others in the study
    alone = study.section_study(sections, [("2", "3")], [1, 3], **small).collect()
    assert [tuple(r) for r in alone] == [tuple(r) for r in out if r["section"] == "2-3"]


def test_nearest_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(nearest, "CELL_POINTS", 40)
    rng = np.random.default_rng(2)
    rows = []
    for g, n in (("a", 500), ("b", 30), ("c", 3), ("d", 1)):
        x = rng.normal(size=(n, 3)).round(1)
        if g == "a":  # copies of a row, and a second heap far away
            x[:200] = x[0]
            x[200:300] += 8
        rows += [(g, i, [float(v) for v in r]) for i, r in enumerate(x)]
    df = spark.createDataFrame([*rows, (None, 1, [0.0] * 3), ("a", None, [0.0] * 3), ("b", 77, None)], "group string, id bigint, x array<double>")
    got: dict = {}
    for r in nearest.nearest(df, 4).collect():
        got.setdefault((r["group"], r["id"]), {})[r["rank"]] = r["near_id"]
    for g in "abcd":
        x = np.array([r[2] for r in rows if r[0] == g])
        for i in range(len(x)):
            d = np.sqrt(((x - x[i]) ** 2).sum(1))
            d[i] = np.inf
            want = [int(j) for j in np.argsort(d, kind="stable")[:4] if d[j] < np.inf]
            have = got.get((g, i), {})
            assert [have[j] for j in range(len(have))] == want
    assert nearest.nearest(df.limit(0), 4).count() == 0


def test_copies_of_a_row_share_one_point(spark):
    rows = spark.range(4000).select(F.lit(0).alias("group"), "id", F.array((F.col("id") % 3).cast("double"), F.lit(1.0)).alias("x"))
    points = nearest._points(rows, 6)
    assert points.count() == 3 and points.select(F.max(F.size("ids"))).first()[0] == 6
    found = nearest.nearest(rows, 5)
    assert found.count() == 20_000 and found.filter("id % 3 <> near_id % 3").count() == 0
