"""Queries: evaluation, exploration, results and sources."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from tollspan.operators import clean, evaluate, explore, flow, results, sections
from tollspan.plans.q_scalars import _TIME, _dec
from tollspan.plans.registry import NUDGE, cte, query, rounded
from tollspan.plans.views import view
from tollspan.session import fresh_path
from tollspan.sources import ingest

# ---- ROC, thresholds, evaluation --------------------------------------------------------

cte(
    "roc",
    """SELECT score AS threshold, CAST(sum(pos) OVER (ORDER BY score DESC) AS BIGINT) AS tp, CAST(sum(neg) OVER (ORDER BY score DESC) AS BIGINT) AS fp,
sum(pos) OVER () AS p, sum(neg) OVER () AS n FROM (SELECT score, count(*) FILTER (target = 1) AS pos, count(*) FILTER (target = 0) AS neg
FROM scores GROUP BY 1) q""",
    "scores",
)


@query("WN10_roc_points", "SELECT threshold, tp, fp, r4(fp / n) AS far, r4(tp / p) AS sensitivity FROM roc", "roc")
def _(spark, sf):
    out = evaluate.roc_points(view(spark, sf, "scores"))
    return out.select("threshold", "tp", "fp", *[F.round(F.col(c) + NUDGE, 4).alias(c) for c in ("far", "sensitivity")])


@query(
    "ML19_far_threshold",
    """(SELECT 'cap' AS kind, threshold, r4(fp / n) AS far, r4(tp / p) AS sensitivity FROM roc WHERE fp / n <= 0.2 + 1e-12
    ORDER BY tp DESC, fp, threshold DESC LIMIT 1) UNION ALL
    (SELECT 'closest', threshold, r4(fp / n), r4(tp / p) FROM roc ORDER BY abs(fp / n - 0.1e0), tp DESC, threshold DESC LIMIT 1)""",
    "roc",
)
def _(spark, sf):
    s = view(spark, sf, "scores")
    cap = evaluate.far_threshold(s, 0.2).withColumn("kind", F.lit("cap"))
    near = evaluate.far_threshold(s, 0.1, "closest").withColumn("kind", F.lit("closest"))
    out = cap.unionByName(near)
    return out.select(
        "kind", "threshold", *[F.round(F.col(c) + NUDGE, 4).alias(c) for c in ("far", "sensitivity")]
    )


@query(
    "ML21_roc_auc",
    """SELECT r4(sum(pos * (below + neg / 2)) / (sum(pos) * sum(neg))) AS auc FROM (SELECT pos, neg, sum(neg) OVER (ORDER BY score) - neg AS below FROM (
    SELECT score, count(*) FILTER (target = 1) AS pos, count(*) FILTER (target = 0) AS neg FROM scores GROUP BY 1) q) r""",
    "scores",
)
def _(spark, sf):
    return rounded(evaluate.roc_auc(view(spark, sf, "scores")))


_RATES = """count(*) FILTER (target = 1 AND hat = 1) AS tp, count(*) FILTER (target = 0 AND hat = 1) AS fp,
count(*) FILTER (target = 0 AND hat = 0) AS tn, count(*) FILTER (target = 1 AND hat = 0) AS fn"""
cte("conf", f"SELECT event_id % 3 AS fold, {_RATES} FROM (SELECT *, CASE WHEN score >= 0.7 THEN 1 ELSE 0 END AS hat FROM scores) q GROUP BY 1", "scores")


@query(
    "ML20_evaluation",
    """SELECT fold, tp, fp, tn, fn, r4((tp + tn) / (tp + fp + tn + fn)) AS accuracy, r4(coalesce(tp / nullif(tp + fp, 0), 0)) AS precision,
    r4(coalesce(tp / nullif(tp + fn, 0), 0)) AS recall, r4(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0)) AS f1,
    r4(coalesce(fp / nullif(fp + tn, 0), 0)) AS far, r4(coalesce(tp / nullif(tp + fn, 0), 0)) AS sensitivity,
    r4(coalesce(fn / nullif(fn + tp, 0), 0)) AS fnr FROM conf""",
    "conf",
)
def _(spark, sf):
    s = view(spark, sf, "scores").withColumn("fold", F.col("event_id") % 3)
    return rounded(evaluate.evaluation(s, F.col("score") >= 0.7, by=["fold"]))


@query(
    "ML22_objectives",
    """SELECT fold, r4(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0)) AS f1,
    r4(0.001 * coalesce(tp / nullif(tp + fn, 0), 0) - coalesce(fp / nullif(fp + tn, 0), 0)) AS far FROM conf""",
    "conf",
)
def _(spark, sf):
    s = view(spark, sf, "scores").withColumn("fold", F.col("event_id") % 3)
    out = evaluate.evaluation(s, F.col("score") >= 0.7, by=["fold"])
    return rounded(out.select("fold", *[evaluate.objective(n).alias(n) for n in ("f1", "far")]))


cte("times", "SELECT ts, row_number() OVER (ORDER BY ts) AS r, count(*) OVER () AS n FROM (SELECT DISTINCT ts FROM scores) q", "scores")
cte("split_test", "SELECT ts, r > n - least(greatest(1, CAST(round_even(n * 0.2, 0) AS BIGINT)), n - 1) AS test FROM times", "times")
cte(
    "split_rest",
    "SELECT ts, row_number() OVER (ORDER BY ts) AS r, count(*) OVER () AS n FROM split_test WHERE NOT test",
    "split_test",
)
cte(
    "split3",
    """SELECT ts, 'test' AS part FROM split_test WHERE test UNION ALL
SELECT ts, CASE WHEN r > n - greatest(1, CAST(round_even(n * 0.25, 0) AS BIGINT)) THEN 'val' ELSE 'train' END FROM split_rest""",
    "split_test split_rest",
)


@query(
    "WN11_temporal_split",
    "SELECT event_id, CASE WHEN test THEN 'test' ELSE 'train' END AS part FROM scores JOIN split_test USING (ts)",
    "scores split_test",
)
def _(spark, sf):
    train, test = evaluate.temporal_split(view(spark, sf, "scores"), 0.2, "ts")
    return train.select("event_id", F.lit("train").alias("part")).unionByName(
        test.select("event_id", F.lit("test").alias("part"))
    )


def _parts(spark, sf):
    names = ("train", "val", "test")
    frames = evaluate.three_way_split(view(spark, sf, "scores"), 0.2, 0.25, "ts")
    out = None
    for name, df in zip(names, frames):
        df = df.withColumn("part", F.lit(name))
        out = df if out is None else out.unionByName(df)
    return out


@query("ML17_three_way_split", "SELECT event_id, target, part FROM scores JOIN split3 USING (ts)", "scores split3")
def _(spark, sf):
    return _parts(spark, sf).select("event_id", "target", "part")


@query(
    "ML18_validation_split",
    """SELECT event_id, synthetic, CASE WHEN NOT synthetic AND r > n - greatest(1, CAST(round_even(n * 0.25, 0) AS BIGINT)) THEN 'val' ELSE 'train' END AS part
    FROM (SELECT event_id, ts, event_id % 5 = 0 AS synthetic FROM scores) s LEFT JOIN (SELECT ts, row_number() OVER (ORDER BY ts) AS r,
    count(*) OVER () AS n FROM (SELECT DISTINCT ts FROM scores WHERE event_id % 5 > 0) q) t USING (ts)""",
    "scores",
)
def _(spark, sf):
    s = view(spark, sf, "scores").withColumn("synthetic", F.col("event_id") % 5 == 0)
    train, val = evaluate.validation_split(s, 0.25, "ts", key="event_id")
    return train.select("event_id", "synthetic", F.lit("train").alias("part")).unionByName(
        val.select("event_id", "synthetic", F.lit("val").alias("part"))
    )


@query(
    "AG23_class_distribution",
    """SELECT part, target, count(*) AS n, round(count(*) * 100 / CAST(sum(count(*)) OVER (PARTITION BY part) AS DOUBLE), 2) AS percent
    FROM scores JOIN split3 USING (ts) GROUP BY 1, 2""",
    "scores split3",
)
def _(spark, sf):
    return evaluate.class_distribution(_parts(spark, sf), by=["part"])


@query(
    "AG26_dataset_summary",
    """SELECT count(*) AS n_rows, 4 AS n_columns, min(ts) AS first_time, max(ts) AS last_time,
    count(*) FILTER (target = 1) AS n_positive FROM scores""",
    "scores",
)
def _(spark, sf):
    return evaluate.dataset_summary(view(spark, sf, "scores"), "ts")


@query(
    "ST01_union_splits",
    "SELECT event_id, target FROM scores",
    "scores",
)
def _(spark, sf):
    a, b = evaluate.temporal_split(view(spark, sf, "scores"), 0.3, "ts")
    return a.unionByName(b).select("event_id", "target")


@query(
    "ST03_complement",
    "SELECT plate, count(*) AS total_passes FROM detections GROUP BY 1 HAVING count(*) < 66",
    "detections",
)
def _(spark, sf):
    per = view(spark, sf, "detections").groupBy("plate").agg(F.count(F.lit(1)).alias("total_passes"))
    return clean.split_frequent(per, passes=66)[1]


# ---- clusters and columns -----------------------------------------------------------------

cte("labelled", "SELECT d.*, cluster_label FROM detections d JOIN plate_labels l ON d.plate = l.plate", "detections plate_labels")


def labelled(spark, sf):
    return view(spark, sf, "detections").join(view(spark, sf, "plate_labels"), "plate")


@query(
    "AG20_cluster_summary",
    "SELECT cluster_label, count(*) AS size, r4(avg(speed_kmh)) AS speed_kmh, r4(avg(lane)) AS lane FROM labelled GROUP BY 1",
    "labelled",
)
def _(spark, sf):
    return rounded(explore.cluster_summary(labelled(spark, sf), ["speed_kmh", "lane"]))


@query(
    "AG21_cluster_descriptives",
    """SELECT cluster_label, count(speed_kmh) AS speed_kmh_count, r4(avg(speed_kmh)) AS speed_kmh_mean, r4(stddev_samp(speed_kmh)) AS speed_kmh_std,
    r4(min(speed_kmh)) AS speed_kmh_min, r4(max(speed_kmh)) AS speed_kmh_max FROM labelled GROUP BY 1""",
    "labelled",
)
def _(spark, sf):
    return rounded(explore.cluster_descriptives(labelled(spark, sf), ["speed_kmh"]))


@query(
    "AG22_normalised_profile",
    """SELECT cluster_label, r4((v - avg(v) OVER ()) / CASE WHEN stddev_pop(v) OVER () = 0 THEN 1 ELSE stddev_pop(v) OVER () END) AS speed_z,
    r4((v - min(v) OVER ()) / CASE WHEN max(v) OVER () = min(v) OVER () THEN 1 ELSE max(v) OVER () - min(v) OVER () END) AS speed_mm
    FROM (SELECT cluster_label, avg(speed_kmh) AS v FROM labelled GROUP BY 1) q""",
    "labelled",
)
def _(spark, sf):
    s = explore.cluster_summary(labelled(spark, sf), ["speed_kmh"])
    z = explore.normalised_profile(s, ["speed_kmh"]).withColumnRenamed("speed_kmh", "speed_z")
    m = explore.normalised_profile(s, ["speed_kmh"], "minmax").withColumnRenamed("speed_kmh", "speed_mm")
    return rounded(z.join(m, "cluster_label"))


_PROFILE = """SELECT '{c}' AS column_name, count({c}) AS n_values, count(DISTINCT {c}) AS n_unique,
    (SELECT v FROM (SELECT CAST({c} AS VARCHAR) AS v, count(*) AS n FROM detections GROUP BY 1) q ORDER BY n DESC, v DESC LIMIT 1) AS top,
    (SELECT max(n) FROM (SELECT count(*) AS n FROM detections GROUP BY {c}) q) AS freq, {rest} FROM detections"""
_NUMBERS = """r4(avg({c})) AS mean, r4(stddev_samp({c})) AS std, r4(min({c})) AS min, r4(quantile_cont({c}, 0.25)) AS q25,
    r4(quantile_cont({c}, 0.5)) AS q50, r4(quantile_cont({c}, 0.75)) AS q75, r4(max({c})) AS max"""
_NONE = ", ".join(f"CAST(NULL AS DOUBLE) AS {n}" for n in ("mean", "std", "min", "q25", "q50", "q75", "max"))


@query(
    "AG27_column_profile",
    " UNION ALL ".join(
        _PROFILE.format(c=c, rest=_NUMBERS.format(c=c) if c in ("speed_kmh", "lane") else _NONE)
        for c in ("speed_kmh", "lane", "gantry", "plate")
    ),
    "detections",
)
def _(spark, sf):
    return rounded(explore.column_profile(view(spark, sf, "detections"), ["speed_kmh", "lane", "gantry", "plate"]))


@query(
    "AG28_histogram",
    """SELECT cluster_label, CAST(least(floor((speed_kmh - a) / ((b - a) / 12)), 11) AS INT) AS bin, count(*) AS n FROM labelled,
    (SELECT min(speed_kmh) AS a, max(speed_kmh) AS b FROM labelled) q GROUP BY 1, 2""",
    "labelled",
)
def _(spark, sf):
    return explore.histogram(labelled(spark, sf), "speed_kmh", 12, ["cluster_label"])


@query(
    "AG28_box_stats",
    f"SELECT cluster_label, {', '.join(f'r4(quantile_cont(speed_kmh, {p / 100})) AS q{p}' for p in (0, 25, 50, 75, 100))} FROM labelled GROUP BY 1",
    "labelled",
)
def _(spark, sf):
    return rounded(explore.box_stats(labelled(spark, sf), "speed_kmh", ["cluster_label"]))


cte(
    "cells",
    """SELECT cluster_label AS label_a, CAST(u AS INT) AS label_b, count(*) AS n FROM (
SELECT cluster_label, CAST(substr(plate, 2) AS INT) % 3 AS u FROM plate_labels) q GROUP BY 1, 2""",
    "plate_labels",
)


def cells(spark, sf):
    a = view(spark, sf, "plate_labels")
    b = a.select("plate", (F.substring("plate", 2, 20).cast("int") % 3).alias("cluster_label"))
    return explore.contingency(a, b)


@query(
    "AG30_contingency",
    f"""SELECT label_a, {", ".join(f"CAST(coalesce(sum(n) FILTER (label_b = {k}), 0) AS BIGINT) AS b_{k}" for k in (0, 1, 2))},
    arg_max(label_b, n * 10 - label_b) AS best_b FROM cells GROUP BY 1""",
    "cells",
)
def _(spark, sf):
    c = cells(spark, sf)
    best = explore.best_overlap(c).select("label_a", F.col("label_b").alias("best_b"))
    return explore.cross_table(c, [0, 1, 2]).join(best, "label_a")


@query(
    "AG30_best_matching",
    """WITH la AS (SELECT DISTINCT label_a FROM cells),
    m AS (SELECT x.label_a AS a0, y.label_a AS a1, z.label_a AS a2,
      coalesce((SELECT n FROM cells WHERE label_a = x.label_a AND label_b = 0), 0) + coalesce((SELECT n FROM cells WHERE label_a = y.label_a AND label_b = 1), 0)
      + coalesce((SELECT n FROM cells WHERE label_a = z.label_a AND label_b = 2), 0) AS s
      FROM la x, la y, la z WHERE x.label_a <> y.label_a AND y.label_a <> z.label_a AND x.label_a <> z.label_a),
    best AS (SELECT * FROM m ORDER BY s DESC,
      (SELECT list(CASE label_a WHEN a0 THEN 0 WHEN a1 THEN 1 WHEN a2 THEN 2 ELSE 3 END ORDER BY label_a) FROM la) LIMIT 1),
    pick AS (SELECT label_a, CASE label_a WHEN a0 THEN 0 WHEN a1 THEN 1 WHEN a2 THEN 2 END AS label_b FROM la, best)
    SELECT label_a, label_b, coalesce(n, 0) AS n FROM pick LEFT JOIN cells USING (label_a, label_b)""",
    "cells",
)
def _(spark, sf):
    return explore.best_matching(cells(spark, sf))


@query(
    "AG31_cluster_flows",
    "SELECT label_a, label_b, n, r4(n / sum(n) OVER (PARTITION BY label_a)) AS share FROM cells",
    "cells",
)
def _(spark, sf):
    return rounded(explore.flow_between(cells(spark, sf)))


@query(
    "AG33_category_counts",
    "SELECT category, count(*) AS n FROM detections GROUP BY 1 ORDER BY n DESC, category",
    "detections",
)
def _(spark, sf):
    return explore.value_counts(view(spark, sf, "detections"), "category")


@query(
    "AG34_assignment_coverage",
    """SELECT count(*) AS n_plates, count(*) FILTER (cluster_label <> -1) AS n_assigned, count(*) FILTER (cluster_label = -1) AS n_unknown,
    count(*) FILTER (rare) AS n_rare, count(*) FILTER (rare AND cluster_label = -1) AS n_rare_excluded,
    r4(count(*) FILTER (rare AND cluster_label = -1) * 100 / count(*) FILTER (rare)) AS rare_excluded_pct FROM (
    SELECT cluster_label, n < 66 AS rare FROM plate_labels JOIN (SELECT plate, count(*) AS n FROM detections GROUP BY 1) c USING (plate)) q""",
    "plate_labels detections",
)
def _(spark, sf):
    per = view(spark, sf, "detections").groupBy("plate").agg(F.count(F.lit(1)).alias("n"))
    rows = view(spark, sf, "plate_labels").join(per, "plate").withColumn("is_rare", F.col("n") < 66)
    return rounded(explore.assignment_coverage(rows))


# ---- results ------------------------------------------------------------------------------

cte(
    "best",
    """SELECT section, result_type, run_id, metric FROM (SELECT *, row_number() OVER (PARTITION BY section, result_type ORDER BY metric DESC, run_id) AS r
FROM runs WHERE metric IS NOT NULL AND error IS NULL) q WHERE r = 1""",
    "runs",
)


@query("WN12_best_rows", "SELECT section, result_type, run_id, metric FROM best", "best")
def _(spark, sf):
    out = sections.best_rows(view(spark, sf, "runs"), ["section", "result_type"], "metric", ["run_id"])
    return out.select("section", "result_type", "run_id", "metric")


@query(
    "WN12_best_flags",
    """SELECT run_id, r1 = 1 AS is_best_section, r2 = 1 AS is_best_type FROM (SELECT run_id,
    row_number() OVER (PARTITION BY section, ok ORDER BY metric DESC, run_id) + CASE WHEN ok THEN 0 ELSE 1000000 END AS r1,
    row_number() OVER (PARTITION BY result_type, ok ORDER BY metric DESC, run_id) + CASE WHEN ok THEN 0 ELSE 1000000 END AS r2
    FROM (SELECT *, metric IS NOT NULL AND error IS NULL AS ok FROM runs) q) z""",
    "runs",
)
def _(spark, sf):
    flags = {"is_best_section": ["section"], "is_best_type": ["result_type"]}
    out = sections.flag_best(view(spark, sf, "runs"), flags, "metric", "run_id")
    return out.select("run_id", "is_best_section", "is_best_type")


@query(
    "RS03_unpivot",
    """SELECT gantry, interval_start, metric, r4(value) AS value FROM (UNPIVOT (SELECT gantry, interval_start, flow_light, speed_light, density_light
    FROM flow_matrix) ON flow_light, speed_light, density_light INTO NAME metric VALUE value) q""",
    "flow_matrix",
)
def _(spark, sf):
    m = flow.flow_matrix(view(spark, sf, "detections"))
    return rounded(
        explore.unpivot_metrics(m, ["gantry", "interval_start"], ["flow_light", "speed_light", "density_light"])
    )


cte(
    "importance",
    """SELECT CASE WHEN CAST(gantry AS INT) % 3 = 0 THEN concat('cluster_', gantry, '_', lane) ELSE concat('flow_', gantry, '_', lane) END AS variable,
count(*) / (SELECT count(*) FROM detections) AS importance FROM detections GROUP BY gantry, lane""",
    "detections",
)


def importance(spark, sf):
    d = view(spark, sf, "detections")
    total = d.count()
    name = F.concat_ws("_", F.when(F.col("gantry").cast("int") % 3 == 0, "cluster").otherwise("flow"), "gantry", "lane")
    return d.groupBy(name.alias("variable")).agg((F.count(F.lit(1)) / F.lit(total)).alias("importance"))


@query(
    "RS06_top_features",
    """SELECT variable, r4(importance) AS importance, (SELECT count(*) FROM (SELECT * FROM importance ORDER BY importance DESC, variable LIMIT 9) t
    WHERE variable LIKE 'cluster%') AS cluster_in_top FROM importance ORDER BY importance DESC, variable LIMIT 9""",
    "importance",
)
def _(spark, sf):
    imp = importance(spark, sf)
    top = evaluate.top_features(imp, 9)
    k = evaluate.balanced_k(imp, 9, F.col("variable").startswith("cluster")).first()
    return rounded(top).withColumn("cluster_in_top", F.lit(k["cluster_in_top"]).cast("bigint"))


@query(
    "ML15_importance_filter",
    "SELECT variable, r4(importance) AS importance FROM importance WHERE importance >= 0.0415",
    "importance",
)
def _(spark, sf):
    return rounded(evaluate.importance_above(importance(spark, sf), 0.0415))


@query(
    "ML31_suggest_k",
    """SELECT (SELECT k FROM km ORDER BY silhouette DESC, k LIMIT 1) AS k_silhouette, (SELECT k FROM km ORDER BY davies_bouldin, k LIMIT 1) AS k_davies_bouldin,
    (SELECT k FROM km ORDER BY bic, k LIMIT 1) AS k_bic""",
    "km",
)
def _(spark, sf):
    m = view(spark, sf, "runs").groupBy("k").agg(
        F.max("metric").alias("silhouette"), F.min("metric").alias("davies_bouldin"), F.count(F.lit(1)).alias("bic")
    )
    return evaluate.suggest_k(m)


cte("km", "SELECT k, max(metric) AS silhouette, min(metric) AS davies_bouldin, count(*) AS bic FROM runs GROUP BY 1", "runs")


@query(
    "RS07_global_sort",
    "SELECT plate, count(*) AS total_passes FROM detections GROUP BY 1 ORDER BY total_passes DESC, plate",
    "detections",
)
def _(spark, sf):
    per = view(spark, sf, "detections").groupBy("plate").agg(F.count(F.lit(1)).alias("total_passes"))
    return per.orderBy(F.desc("total_passes"), "plate")


@query("RT01_append_results", "SELECT * FROM runs", "runs")
def _(spark, sf):
    path = fresh_path(spark, "results")
    r = view(spark, sf, "runs")
    results.append_results(r.filter("run_id % 2 = 0"), path)
    results.append_results(r.filter("run_id % 2 = 1"), path)
    return spark.read.parquet(path)


@query(
    "RT02_history_delete",
    "SELECT CAST(run_id AS VARCHAR) AS run_id FROM runs WHERE error IS NULL",
    "runs",
)
def _(spark, sf):
    path = fresh_path(spark, "history")
    r = view(spark, sf, "runs")
    results.append_history(r.select("run_id", "run_ts", "section"), path)
    history = results.read_history(spark, path)
    failed = r.filter("error IS NOT NULL").select(F.col("run_id").cast("string").alias("run_id"))
    return results.without_runs(history, failed).select("run_id")


@query(
    "RT03_latest_best",
    "SELECT run_id, section, metric FROM runs WHERE metric IS NOT NULL ORDER BY metric DESC, run_ts DESC, run_id DESC LIMIT 1",
    "runs",
)
def _(spark, sf):
    return results.latest_best(view(spark, sf, "runs")).select("run_id", "section", "metric")


@query(
    "RT04_latest_run",
    """SELECT section, run_id, run_ts FROM (SELECT *, row_number() OVER (PARTITION BY section ORDER BY run_ts DESC, run_id DESC) AS r FROM runs) q WHERE r = 1""",
    "runs",
)
def _(spark, sf):
    return results.latest_per(view(spark, sf, "runs"), ["section"]).select("section", "run_id", "run_ts")


# ---- sources --------------------------------------------------------------------------------

cte(
    "parsed",
    f"""SELECT event_id, {_TIME} AS ts, {_dec('speed_txt')} AS speed_kmh, CAST(round_even({_dec('category_txt')}, 0) AS INT) AS category,
nullif(trim(plate_txt), '') AS plate, nullif(trim(gantry_txt), '') AS gantry, nullif(trim(lane_txt), '') AS lane FROM raw_detections""",
    "raw_detections",
)


def as_files(spark, sf):
    """The dirty detections written out as CSV, under the file's own column names."""
    path = fresh_path(spark, "detections") + ".csv"
    names = {v: k for k, v in ingest.DETECTION_COLUMNS.items()}
    view(spark, sf, "raw_detections").withColumnsRenamed(names).write.csv(path, header=True)
    return path


@query(
    "SRC01_parse_detections",
    "SELECT ts, speed_kmh, category, plate, gantry, lane FROM parsed WHERE ts IS NOT NULL AND category IS NOT NULL",
    "parsed",
)
def _(spark, sf):
    return ingest.read_detections_csv(spark, as_files(spark, sf))


@query("SRC02_import_append", "SELECT 2 * count(*) AS stored, 2 * count(*) AS inserted FROM parsed WHERE ts IS NOT NULL AND category IS NOT NULL", "parsed")
def _(spark, sf):
    path = fresh_path(spark, "table")
    rows = ingest.parse_detections(view(spark, sf, "raw_detections"), ["event_id"])
    n1 = ingest.write_detections(rows, path, "overwrite")
    n2 = ingest.write_detections(rows, path, "append")
    stored = ingest.read_detections(spark, path)
    return stored.agg(F.count(F.lit(1)).alias("stored"), F.lit(n1 + n2).cast("bigint").alias("inserted"))


@query("SRC03_empty_table", "SELECT CAST(0 AS BIGINT) AS n_left, count(*) AS removed FROM detections", "detections")
def _(spark, sf):
    path = fresh_path(spark, "table")
    ingest.write_features(view(spark, sf, "detections"), path)
    n = ingest.empty_table(spark, path)
    return spark.read.parquet(path).agg(F.count(F.lit(1)).alias("n_left")).withColumn("removed", F.lit(n).cast("bigint"))


@query(
    "SRC04_table_summary",
    "SELECT count(*) AS n_rows, min(ts) AS first_ts, max(ts) AS last_ts FROM detections",
    "detections",
)
def _(spark, sf):
    return ingest.table_summary(view(spark, sf, "detections"))


_COLUMNS = (("event_id", "bigint"), ("ts", "timestamp_ntz"), ("speed_kmh", "double"), ("category", "int"), ("plate", "string"), ("gantry", "string"),
            ("lane", "int"))


@query(
    "SRC05_schema_listing",
    " UNION ALL ".join(
        f"SELECT {i} AS ordinal, '{c}' AS name, '{t}' AS type, true AS nullable, count(*) FILTER ({c} IS NULL) AS n_null FROM odd_detections"
        for i, (c, t) in enumerate(_COLUMNS)
    ),
    "odd_detections",
)
def _(spark, sf):
    odd = view(spark, sf, "detections").select(*[F.when(F.col("event_id") % (i + 5) > 0, F.col(c)).alias(c) for i, (c, _) in enumerate(_COLUMNS)])
    return ingest.schema_listing(odd)


cte(
    "odd_detections",
    "SELECT " + ", ".join(f"CASE WHEN event_id % {i + 5} > 0 THEN {c} END AS {c}" for i, (c, _) in enumerate(_COLUMNS)) + " FROM detections",
    "detections",
)


@query(
    "SRC06_ordered_head",
    "SELECT event_id, ts FROM parsed ORDER BY coalesce(ts, TIMESTAMP '1970-01-01'), event_id LIMIT 2500",
    "parsed",
)
def _(spark, sf):
    from tollspan.functions import scalars as S

    raw = view(spark, sf, "raw_detections")
    rows = raw.select("event_id", S.parse_detection_time(S.clean_text(F.col("ts_txt"))).alias("ts"))
    return ingest.ordered_head(rows, 2500)


@query(
    "SRC07_range_scan",
    "SELECT * FROM events WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-12 06:00:00'",
)
def _(spark, sf):
    return ingest.range_scan(view(spark, sf, "events"), "2024-01-10", "2024-01-12 06:00:00")


@query(
    "SRC08_load_range",
    "SELECT event_id, ts, category FROM detections_long WHERE ts >= TIMESTAMP '2024-02-01' AND ts < TIMESTAMP '2024-02-11'",
    "detections_long",
)
def _(spark, sf):
    return ingest.load_range(view(spark, sf, "detections_long"), "2024-02-01", "2024-02-10").select(
        "event_id", "ts", "category"
    )


@query("SRC10_sniffed_csv", "SELECT ts, speed_kmh, category, plate, gantry, lane FROM parsed WHERE ts IS NOT NULL AND category IS NOT NULL", "parsed")
def _(spark, sf):
    path = fresh_path(spark, "sniff")
    raw = view(spark, sf, "raw_detections")
    odd = F.col("event_id") % 2 == 1  # the files of one folder are parted in two ways
    raw.filter(odd).write.csv(path, header=True, sep=";")
    raw.filter(~odd).write.mode("append").csv(path, header=True, sep=",", encoding="ISO-8859-1")
    return ingest.parse_detections(ingest.read_sniffed(spark, path))


@query("SRC11_resolve_columns", "SELECT * FROM raw_detections", "raw_detections")
def _(spark, sf):
    d = view(spark, sf, "raw_detections")
    odd = d.select(*[F.col(c).alias(c.replace("_", " ").title()) for c in d.columns])
    return odd.select(*[F.col(f"`{ingest.resolve_column(odd.columns, c)}`").alias(c) for c in d.columns])


@query(
    "SRC12_parse_catalogue",
    "SELECT gantry, km, carriageway, seq, axis, lat, lon FROM road_posts",
    "road_posts",
)
def _(spark, sf):
    p = view(spark, sf, "road_posts")
    raw = p.select(
        F.concat("gantry", F.lit(".0")).alias("Portico"),
        F.replace(F.col("km").cast("string"), F.lit("."), F.lit(",")).alias("KM "),
        F.concat(F.lit(" "), "carriageway").alias("Calzada"),
        F.col("seq").cast("string").alias("orden"),
        F.col("axis").alias("EJE"),
        F.concat_ws(",", F.col("lat").cast("string"), F.col("lon").cast("string")).alias("lat-lon"),
    )
    return ingest.parse_catalogue(raw)


def event_files(spark, sf):
    log = view(spark, sf, "accident_log")
    return [log.filter("event_id % 2 = 0").drop("descripcion"), log.filter("event_id % 2 = 1").drop("subtipo")]


@query(
    "SRC13_union_event_files",
    """SELECT event_id, tipo, CASE WHEN event_id % 2 = 1 THEN descripcion END AS descripcion, CASE WHEN event_id % 2 = 0 THEN subtipo END AS subtipo
    FROM accident_log WHERE lower(tipo) = 'accidente'""",
    "accident_log",
)
def _(spark, sf):
    return ingest.union_event_files(event_files(spark, sf), [" ACCIDENTE"]).select(
        "event_id", "tipo", "descripcion", "subtipo"
    )


@query("SRC14_event_types", "SELECT DISTINCT trim(tipo) AS event_type FROM accident_log", "accident_log")
def _(spark, sf):
    return ingest.event_types(event_files(spark, sf))


@query(
    "SRC15_events_table",
    """SELECT event_time, km, CAST(NULL AS DOUBLE) AS lat, CAST(NULL AS DOUBLE) AS lon, event_type, axis, carriageway, gantry_start, gantry_end,
    last_gantry, description, subtype FROM ev""",
    "ev",
)
def _(spark, sf):
    from tollspan.plans.q_road import ev

    path = fresh_path(spark, "events")
    ingest.write_events(ev(spark, sf), path)
    return ingest.read_events(spark, path)


@query(
    "SRC16_feature_table",
    "SELECT gantry, interval_start, r4(flow_light) AS flow_light, r4(speed_heavy) AS speed_heavy FROM flow_matrix",
    "flow_matrix",
)
def _(spark, sf):
    path = fresh_path(spark, "features")
    ingest.write_features(flow.flow_matrix(view(spark, sf, "detections")), path, "interval_start")
    return rounded(ingest.read_features(spark, path).select("gantry", "interval_start", "flow_light", "speed_heavy"))


@query(
    "SRC17_feature_extent",
    """SELECT count(DISTINCT gantry) AS n_gantries, min(interval_start) AS first_interval, max(interval_start) AS last_interval,
    CAST(date_diff('day', CAST(min(interval_start) AS DATE), CAST(max(interval_start) AS DATE)) + 1 AS INT) AS span_days FROM (
    SELECT gantry, time_bucket(INTERVAL 5 minute, ts) AS interval_start FROM detections_long) q""",
    "detections_long",
)
def _(spark, sf):
    return ingest.feature_extent(flow.flow_core(view(spark, sf, "detections_long")))


@query("SRC18_exports", "SELECT plate, CAST(cluster_label AS VARCHAR) AS cluster_label FROM plate_labels", "plate_labels")
def _(spark, sf):
    path = fresh_path(spark, "labels") + ".csv"
    ingest.export_table(view(spark, sf, "plate_labels"), path)
    return ingest.read_artifact(spark, path)


@query(
    "SRC19_road_geometry",
    """SELECT way_id, concat('way ', CAST(way_id AS VARCHAR)) AS name, CAST(CAST(point AS INT) AS INT) AS point, lat, lon FROM way_points""",
    "way_points",
)
def _(spark, sf):
    from tollspan.plans.q_road import way_points

    path = fresh_path(spark, "roads") + ".json"
    geometry = F.transform(
        F.sort_array(F.collect_list(F.struct("point", "lat", "lon"))),
        lambda p: F.struct(p["lat"].alias("lat"), p["lon"].alias("lon")),
    )
    ways = way_points(spark, sf).groupBy("way_id").agg(geometry.alias("geometry"))
    element = F.struct(
        F.col("way_id").alias("id"),
        F.struct(F.concat(F.lit("way "), F.col("way_id").cast("string")).alias("name")).alias("tags"),
        "geometry",
    )
    ways.select(F.array(element).alias("elements")).write.json(path)
    return ingest.road_points(spark.read.json(path, schema=ingest.ROAD_SCHEMA)).drop("ref")


@query("SRC20_artifacts", "SELECT run_id, section, metric, CAST(k AS BIGINT) AS k FROM runs", "runs")
def _(spark, sf):
    path = fresh_path(spark, "runs") + ".jsonl"
    view(spark, sf, "runs").write.json(path)
    return ingest.read_artifact(spark, path).select("run_id", "section", "metric", "k")


@query(
    "CL11_column_families",
    """SELECT gantry_last, gantry_next, r4(last_flow_light) AS last_flow_light, r4(last_flow_heavy) AS last_flow_heavy,
    r4(last_flow_motorcycles) AS last_flow_motorcycles, '{"clusters": 0, "missing": ["no_such"]}' AS facts FROM section_matrix""",
    "section_matrix",
)
def _(spark, sf):
    from tollspan.plans.q_road import sec_matrix

    m = sec_matrix(spark, sf)
    found, missing = ingest.pick_features(m.columns, ["Last Flow Light", "no_such"])
    facts = json.dumps({"clusters": len(ingest.cluster_features(m.columns)), "missing": missing})
    return rounded(m).select("gantry_last", "gantry_next", *found, *ingest.numeric_features(m)[1:3], F.lit(facts).alias("facts"))
