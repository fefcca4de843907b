"""Queries: sources, cleaning, plate behaviour, batches and mixture."""

from __future__ import annotations

from pyspark.sql import functions as F

from tollspan.operators import clean, flow, mixture, plate, rollup
from tollspan.plans.q_flow import COUNTS, VECTOR, behaviour_ctes
from tollspan.plans.registry import cte, query, rounded
from tollspan.plans.views import view

# ---- cleaning ------------------------------------------------------------------


@query("CL01_clean_passes", "SELECT * FROM cleaned", "cleaned")
def _(spark, sf):
    return clean.clean_passes(view(spark, sf, "dirty"))


@query("CL02_dedupe", "SELECT * FROM deduped", "deduped")
def _(spark, sf):
    return clean.dedupe_passes(clean.clean_passes(view(spark, sf, "dirty")))


@query(
    "CL03_winsorise",
    "SELECT event_id, gantry, lane, r4(speed_kmh) AS speed_kmh FROM winsorised",
    "winsorised",
)
def _(spark, sf):
    out = clean.behaviour_input(view(spark, sf, "dirty"))
    return rounded(out.select("event_id", "gantry", "lane", "speed_kmh"))


@query(
    "CL03_filter_outliers",
    """SELECT d.event_id FROM deduped d JOIN bounds b ON d.gantry = b.gantry AND d.lane = b.lane
    WHERE speed_kmh BETWEEN lo - 1e-9 AND hi + 1e-9""",
    "deduped bounds",
)
def _(spark, sf):
    rows = clean.dedupe_passes(clean.clean_passes(view(spark, sf, "dirty")))
    return clean.limit_outliers(rows, "filter").select("event_id")


@query(
    "CL07_frequent_rare",
    """SELECT plate, total_passes >= 60 AND n_days_active >= 1 AS is_frequent FROM (
    SELECT plate, count(*) AS total_passes, count(DISTINCT CAST(ts AS DATE)) AS n_days_active FROM detections GROUP BY 1) q""",
    "detections",
)
def _(spark, sf):
    per = (
        view(spark, sf, "detections")
        .groupBy("plate", F.to_date("ts").alias("day"))
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy("plate")
        .agg(F.sum("n").alias("total_passes"), F.count("day").alias("n_days_active"))
    )
    often, seldom = clean.split_frequent(per, passes=60, days=1)
    return often.select("plate", F.lit(True).alias("is_frequent")).unionByName(
        seldom.select("plate", F.lit(False).alias("is_frequent"))
    )


@query(
    "CL08_valid_rows",
    """SELECT event_id, a, b FROM (SELECT event_id, CASE WHEN event_id % 9 IN (1, 2) THEN NULL ELSE speed_kmh END AS a,
    CASE WHEN event_id % 9 IN (3, 4) THEN NULL ELSE CAST(event_id AS DOUBLE) END AS b FROM detections) q
    WHERE a IS NOT NULL AND b IS NOT NULL""",
    "detections",
)
def _(spark, sf):
    m = F.col("event_id") % 9
    a = F.when(m == 1, F.lit("inf")).when(m == 2, F.lit(None)).otherwise(F.col("speed_kmh").cast("string"))
    b = F.when(m == 3, F.lit(float("nan"))).when(m == 4, F.lit(float("-inf"))).otherwise(F.col("event_id"))
    rows = view(spark, sf, "detections").select("event_id", a.alias("a"), b.alias("b"))
    return clean.valid_rows(rows, ["a", "b"])


@query(
    "CL12_table_filter",
    """SELECT run_id FROM runs WHERE (lower(concat_ws('|', run_id, section, result_type, payload)) LIKE '%s1%')
    AND k BETWEEN 2 AND 4 AND result_type IN ('Base') AND contains(lower(payload), 'far')""",
    "runs",
)
def _(spark, sf):
    rows = view(spark, sf, "runs").select("run_id", "section", "result_type", "payload", "k")
    text = clean.filter_table(
        rows.drop("k"), text="S1", values={"result_type": ["Base"]}, contains={"payload": "FAR"}
    )
    ranged = clean.filter_table(rows, ranges={"k": (2, 4)})
    return text.select("run_id").join(ranged.select("run_id"), "run_id", "left_semi")


@query("CL13_hash_sample")
def _(spark, sf):
    return clean.hash_sample(view(spark, sf, "detections"), "event_id", 500)


@query(
    "SRC09_earliest_fraction",
    """SELECT event_id, ts FROM (SELECT event_id, ts, row_number() OVER (ORDER BY ts, event_id) AS rn,
    count(*) OVER () AS n FROM detections) q WHERE rn <= greatest(1, CAST(floor(n * 0.07e0) AS BIGINT))""",
    "detections",
)
def _(spark, sf):
    return clean.earliest_fraction(view(spark, sf, "detections"), 0.07).select("event_id", "ts")


# ---- pieces of the behaviour vector ------------------------------------------------

behaviour_ctes("detections", "_det")
behaviour_ctes("detections_long", "_long")


@query(
    "AG02_plate_totals",
    "SELECT plate, count(*) AS total_passes, r4(avg(speed_kmh)) AS avg_speed_kmh FROM detections GROUP BY 1",
    "detections",
)
def _(spark, sf):
    out = plate.plate_features(view(spark, sf, "detections"), include_counts=True)
    return rounded(out.select("plate", "total_passes", "avg_speed_kmh"))


@query(
    "AG03_lane_shares",
    f"SELECT plate, {', '.join(f'r4(count(*) FILTER (lane = {k}) / count(*)) AS lane_prop_{k}' for k in (1, 2, 3))} FROM detections GROUP BY 1",
    "detections",
)
def _(spark, sf):
    out = plate.plate_features(view(spark, sf, "detections"), include_counts=True)
    return rounded(out.select("plate", *[f"lane_prop_{k}" for k in (1, 2, 3)]))


def _follow(spark, sf):
    return plate.follow_measures(view(spark, sf, "detections"))


@query(
    "AG04_relative_speed",
    "SELECT plate, r4(avg(relative_speed)) AS avg_relative_speed FROM follow_det GROUP BY 1",
    "follow_det",
)
def _(spark, sf):
    return rounded(_follow(spark, sf).groupBy("plate").agg(F.avg("relative_speed").alias("avg_relative_speed")))


@query(
    "AG05_mean_headway",
    "SELECT plate, r4(avg(headway_s)) AS avg_headway_s, count(headway_s) AS headway_count FROM follow_det GROUP BY 1",
    "follow_det",
)
def _(spark, sf):
    return rounded(
        _follow(spark, sf)
        .groupBy("plate")
        .agg(F.avg("headway_s").alias("avg_headway_s"), F.count("headway_s").alias("headway_count"))
    )


@query(
    "AG06_conflict_rate",
    "SELECT plate, r4(avg(conflict)) AS conflict_rate, count(conflict) AS conflict_count FROM follow_det GROUP BY 1",
    "follow_det",
)
def _(spark, sf):
    return rounded(
        _follow(spark, sf)
        .groupBy("plate")
        .agg(F.avg("conflict").alias("conflict_rate"), F.count("conflict").alias("conflict_count"))
    )


@query(
    "JN02_slot_mean_speed",
    """SELECT event_id, r4(avg(speed_kmh) OVER (PARTITION BY gantry, time_bucket(INTERVAL 5 minute, ts))) AS slot_speed,
    r4(relative_speed) AS relative_speed FROM follow_det""",
    "follow_det",
)
def _(spark, sf):
    out = _follow(spark, sf).withColumn("slot_speed", F.col("speed_kmh") / F.col("relative_speed"))
    return rounded(out.select("event_id", "slot_speed", "relative_speed"))


@query("AG07_active_periods", """SELECT plate, CAST(count(DISTINCT CAST(ts AS DATE)) AS INT) AS n_days_active,
CAST(count(DISTINCT extract(isoyear FROM ts) * 100 + extract(week FROM ts)) AS INT) AS n_weeks_active,
CAST(count(DISTINCT strftime(ts, '%Y-%m')) AS INT) AS n_months_active FROM detections_long GROUP BY 1""", "detections_long")  # fmt: skip
def _(spark, sf):
    out = plate.plate_features(view(spark, sf, "detections_long"))
    return out.select("plate", "n_days_active", "n_weeks_active", "n_months_active")


@query(
    "AG08_lane_changes",
    """SELECT plate, CAST(sum(lane_change) AS BIGINT) AS lane_changes,
    r4(CASE WHEN count(*) > 1 THEN sum(lane_change) / (count(*) - 1) ELSE 0 END) AS lane_change_rate FROM follow_det GROUP BY 1""",
    "follow_det",
)
def _(spark, sf):
    hours = (
        plate.hourly_lanes(view(spark, sf, "detections"))
        .groupBy("plate", "_hour")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.sum("lane_change").alias("lane_changes"),
            F.max("_first_lane").alias("_first_lane"),
            F.max("_last_lane").alias("_last_lane"),
        )
    )
    out = plate.border_changes(hours).groupBy("plate").agg(F.sum("n").alias("n"), F.sum("lane_changes").alias("lane_changes"))
    rate = F.coalesce(F.try_divide("lane_changes", F.col("n") - 1), F.lit(0.0))
    return rounded(out.select("plate", "lane_changes", rate.alias("lane_change_rate")))


# ---- months and batches --------------------------------------------------------------

cte(
    "follow_month",
    f"""
SELECT s.*, CASE WHEN gap > 0 AND gap <= 60 THEN gap END AS headway_s,
  CASE WHEN gap > 0 AND gap <= 60 THEN
     CASE WHEN speed_kmh > prev_speed AND gap * speed_kmh / (speed_kmh - prev_speed) < lim THEN 1 ELSE 0 END END AS conflict,
  speed_kmh / slot_mean AS relative_speed
FROM (SELECT t.*, date_diff('microsecond', lag(ts) OVER v, ts) / 1000000.0 AS gap, lag(speed_kmh) OVER v AS prev_speed,
   CASE gantry {" ".join(f"WHEN '{k}' THEN {v}" for k, v in plate.S.TTC_LIMIT_S.items())} END AS lim,
   avg(speed_kmh) OVER (PARTITION BY gantry, time_bucket(INTERVAL 5 minute, ts)) AS slot_mean,
   CASE WHEN lane <> lag(lane) OVER p THEN 1 ELSE 0 END AS lane_change
   FROM (SELECT *, strftime(ts, '%Y-%m') AS month FROM detections_long) t
   WINDOW v AS (PARTITION BY month, gantry, lane ORDER BY ts, plate, speed_kmh, event_id),
   p AS (PARTITION BY month, plate ORDER BY ts, gantry, event_id)) s""",
    "detections_long",
)
cte(
    "plate_month",
    """SELECT plate, month, count(*) AS n, avg(speed_kmh) AS v, avg(relative_speed) AS r, avg(headway_s) AS h,
avg(conflict) AS c, count(*) FILTER (lane = 1) / count(*) AS l1, count(*) FILTER (lane = 2) / count(*) AS l2,
count(*) FILTER (lane = 3) / count(*) AS l3, sum(lane_change) AS lc FROM follow_month GROUP BY 1, 2""",
    "follow_month",
)


def _w(c: str, name: str) -> str:
    return f"r4(coalesce(sum({c} * n), 0) / sum(n)) AS {name}"


@query(
    "AG10_monthly_vector",
    f"""SELECT plate, CAST(sum(n) AS BIGINT) AS total_passes, {_w('v', 'avg_speed_kmh')}, {_w('r', 'avg_relative_speed')},
    {_w('h', 'avg_headway_s')}, {_w('c', 'conflict_rate')}, {_w('l1', 'lane_prop_1')}, {_w('l2', 'lane_prop_2')},
    {_w('l3', 'lane_prop_3')}, CAST(sum(lc) AS BIGINT) AS lane_changes,
    r4(CASE WHEN sum(greatest(n - 1, 0)) > 0 THEN sum(lc) / sum(greatest(n - 1, 0)) ELSE 0 END) AS lane_change_rate,
    CAST(count(*) AS INT) AS n_months_active FROM plate_month GROUP BY 1""",
    "plate_month",
)
def _(spark, sf):
    out = plate.plate_features(view(spark, sf, "detections_long"), monthly=True)
    return rounded(out.drop("n_days_active", "n_weeks_active"))


_MONTHS = """SELECT CAST(s AS TIMESTAMP) AS batch_start, CAST(s + INTERVAL 1 MONTH AS TIMESTAMP) AS batch_end,
    strftime(s, '%Y-%m') AS batch_label, 'month' AS kind FROM (
    SELECT unnest(generate_series(date_trunc('month', min(ts)), date_trunc('month', max(ts)), INTERVAL 1 MONTH)) AS s FROM detections_long) q"""
_WEEKS = """SELECT s AS batch_start, e AS batch_end, concat(strftime(s, '%Y-%m-%d'), '_to_', strftime(e - INTERVAL 1 DAY, '%Y-%m-%d')) AS batch_label,
    'week' AS kind FROM (SELECT CAST(s AS TIMESTAMP) AS s, CAST(s + INTERVAL 7 DAY AS TIMESTAMP) AS e FROM (
    SELECT unnest(generate_series(date_trunc('week', min(ts)), date_trunc('week', max(ts)), INTERVAL 7 DAY)) AS s FROM detections_long) q) r"""
_SPLIT = """SELECT a AS batch_start, b AS batch_end, concat(strftime(a, '%Y-%m-%d'), '_to_', strftime(b - INTERVAL 1 DAY, '%Y-%m-%d')) AS batch_label,
    'split' AS kind FROM (SELECT batch_start AS a, least(batch_end, m) AS b FROM w UNION ALL SELECT m, batch_end FROM w WHERE m < batch_end) q"""


@query(
    "AG13_batch_ranges",
    f"""WITH w AS (SELECT *, CAST(date_trunc('month', batch_start) + INTERVAL 1 MONTH AS TIMESTAMP) AS m FROM ({_WEEKS}) z)
    {_MONTHS} UNION ALL SELECT batch_start, batch_end, batch_label, kind FROM w UNION ALL {_SPLIT}""",
    "detections_long",
)
def _(spark, sf):
    rows = view(spark, sf, "detections_long")
    month = rollup.batch_ranges(rows, "month").withColumn("kind", F.lit("month"))
    week = rollup.batch_ranges(rows, "week").withColumn("kind", F.lit("week"))
    split = rollup.batch_ranges(rows, "week", split_months=True).withColumn("kind", F.lit("split"))
    return month.unionByName(week).unionByName(split)


cte(
    "by_week",
    """SELECT plate, CAST(greatest(date_trunc('week', ts), date_trunc('month', ts)) AS DATE) AS batch_start, count(*) AS n,
sum(speed_kmh) AS v, sum(relative_speed) AS r, sum(headway_s) AS h, sum(conflict) AS c, count(relative_speed) AS nr,
count(headway_s) AS nh, count(conflict) AS nc, count(*) FILTER (lane = 1) AS l1, count(*) FILTER (lane = 2) AS l2,
count(*) FILTER (lane = 3) AS l3, sum(lane_change) AS lc, count(DISTINCT CAST(ts AS DATE)) AS days FROM follow_long GROUP BY 1, 2""",
    "follow_long",
)


@query(
    "AG14_features_by_batch",
    f"SELECT plate, CAST(date_trunc('month', ts) AS DATE) AS batch_start, {VECTOR}{COUNTS} FROM follow_long GROUP BY 1, 2",
    "follow_long",
)
def _(spark, sf):
    return rounded(rollup.features_by_batch(view(spark, sf, "detections_long"), "month"))


@query(
    "AG11_batch_rollup",
    """SELECT plate, CAST(sum(n) AS BIGINT) AS total_passes, r4(sum(v) / sum(n)) AS avg_speed_kmh,
    r4(CASE WHEN sum(nr) > 0 THEN sum(r) / sum(nr) END) AS avg_relative_speed,
    r4(CASE WHEN sum(nh) > 0 THEN sum(h) / sum(nh) END) AS avg_headway_s,
    r4(CASE WHEN sum(nc) > 0 THEN sum(c) / sum(nc) END) AS conflict_rate, r4(sum(l1) / sum(n)) AS lane_prop_1,
    r4(sum(l2) / sum(n)) AS lane_prop_2, r4(sum(l3) / sum(n)) AS lane_prop_3, CAST(sum(lc) AS BIGINT) AS lane_changes,
    r4(CASE WHEN sum(n) > 1 THEN sum(lc) / (sum(n) - 1) ELSE 0 END) AS lane_change_rate,
    CAST(sum(days) AS BIGINT) AS n_days_active, CAST(count(*) AS BIGINT) AS n_weeks_active FROM by_week GROUP BY 1""",
    "by_week",
)
def _(spark, sf):
    out = rollup.roll_up(rollup.features_by_batch(view(spark, sf, "detections_long"), "week", split_months=True), "week")
    return rounded(out.drop("rel_speed_count", "headway_count", "conflict_count"))


cte(
    "week_month",
    """SELECT plate, strftime(batch_start, '%Y-%m') AS month, sum(n) AS n, sum(v) / sum(n) AS v,
CASE WHEN sum(nr) > 0 THEN sum(r) / sum(nr) END AS r, CASE WHEN sum(nh) > 0 THEN sum(h) / sum(nh) END AS h,
CASE WHEN sum(nc) > 0 THEN sum(c) / sum(nc) END AS c, sum(l1) / sum(n) AS l1, sum(l2) / sum(n) AS l2, sum(l3) / sum(n) AS l3,
sum(lc) AS lc, sum(days) AS days FROM by_week GROUP BY 1, 2""",
    "by_week",
)


@query(
    "AG12_weeks_to_months",
    f"""SELECT plate, CAST(sum(n) AS BIGINT) AS total_passes, {_w('v', 'avg_speed_kmh')}, {_w('r', 'avg_relative_speed')},
    {_w('h', 'avg_headway_s')}, {_w('c', 'conflict_rate')}, {_w('l1', 'lane_prop_1')}, {_w('l2', 'lane_prop_2')},
    {_w('l3', 'lane_prop_3')}, CAST(sum(lc) AS BIGINT) AS lane_changes,
    r4(CASE WHEN sum(greatest(n - 1, 0)) > 0 THEN sum(lc) / sum(greatest(n - 1, 0)) ELSE 0 END) AS lane_change_rate,
    CAST(sum(days) AS BIGINT) AS n_days_active FROM week_month GROUP BY 1""",
    "week_month",
)
def _(spark, sf):
    weeks = rollup.features_by_batch(view(spark, sf, "detections_long"), "week", split_months=True)
    return rounded(rollup.roll_up_monthly(rollup.weeks_to_months(weeks)))


# ---- mixture ---------------------------------------------------------------------------

cte(
    "mixture",
    """SELECT gantry, interval_start, cluster_label, n, n / sum(n) OVER (PARTITION BY gantry, interval_start) AS share,
n * 12e0 AS flow_per_hour, speed_mean, CASE WHEN speed_mean > 0 THEN n * 12e0 / speed_mean ELSE 0 END AS density FROM (
SELECT gantry, time_bucket(INTERVAL 5 minute, ts) AS interval_start, cluster_label, count(*) AS n, avg(speed_kmh) AS speed_mean
FROM detections d JOIN plate_labels l ON d.plate = l.plate GROUP BY 1, 2, 3) q""",
    "detections plate_labels",
)
cte(
    "mixture_delta",
    """SELECT *, coalesce(speed_mean - lag(speed_mean) OVER w, 0) AS delta_speed, coalesce(density - lag(density) OVER w, 0) AS delta_density
FROM mixture WINDOW w AS (PARTITION BY gantry, cluster_label ORDER BY interval_start)""",
    "mixture",
)
LABELS = [-1, 0, 1, 2, 3]


def mixture_cells(metrics, wrap="r4"):
    return ", ".join(
        f"{wrap}(coalesce(max(CASE WHEN cluster_label = {k} THEN {mixture.METRICS[m]} END), 0e0)) AS cluster_{m}_{mixture.label_suffix(k)}"
        for m in metrics
        for k in LABELS
    )


cte(
    "mixture_matrix",
    f"""SELECT gantry, interval_start, {mixture_cells(['share', 'speed', 'density'], '')},
-sum(share * ln(share)) AS cluster_entropy FROM mixture GROUP BY 1, 2""",
    "mixture",
)


def core(spark, sf):
    return mixture.mixture_core(view(spark, sf, "detections"), view(spark, sf, "plate_labels"))


def mix_matrix(spark, sf, metrics, entropy=True):
    return mixture.mixture_matrix(
        view(spark, sf, "detections"), view(spark, sf, "plate_labels"), LABELS, metrics, entropy
    )


@query(
    "JN03_labelled_detections",
    "SELECT event_id, d.plate, cluster_label FROM detections d JOIN plate_labels l ON d.plate = l.plate",
    "detections plate_labels",
)
def _(spark, sf):
    out = mixture.attach_labels(view(spark, sf, "detections"), view(spark, sf, "plate_labels"))
    return out.select("event_id", "plate", "cluster_label")


@query(
    "AG15_mixture_core",
    """SELECT gantry, interval_start, cluster_label, n, r4(share) AS share, r4(flow_per_hour) AS flow_per_hour,
    r4(speed_mean) AS speed_mean, r4(density) AS density FROM mixture""",
    "mixture",
)
def _(spark, sf):
    return rounded(core(spark, sf).drop("total"))


@query(
    "WN09_share_totals",
    """SELECT gantry, interval_start, cluster_label, CAST(sum(n) OVER (PARTITION BY gantry, interval_start) AS BIGINT) AS total FROM mixture""",
    "mixture",
)
def _(spark, sf):
    return core(spark, sf).select("gantry", "interval_start", "cluster_label", "total")


@query(
    "AG16_mixture_entropy",
    "SELECT gantry, interval_start, r4(-sum(share * ln(share))) AS cluster_entropy FROM mixture GROUP BY 1, 2",
    "mixture",
)
def _(spark, sf):
    return rounded(mixture.mixture_entropy(core(spark, sf)))


@query(
    "WN02_mixture_deltas",
    "SELECT gantry, interval_start, cluster_label, r4(delta_speed) AS delta_speed, r4(delta_density) AS delta_density FROM mixture_delta",
    "mixture_delta",
)
def _(spark, sf):
    out = mixture.mixture_deltas(core(spark, sf))
    return rounded(out.select("gantry", "interval_start", "cluster_label", "delta_speed", "delta_density"))


@query(
    "RS02_mixture_matrix",
    f"""SELECT gantry, interval_start, {mixture_cells(mixture.METRICS)}, r4(-sum(share * ln(share))) AS cluster_entropy
    FROM mixture_delta GROUP BY 1, 2""",
    "mixture_delta",
)
def _(spark, sf):
    return rounded(mix_matrix(spark, sf, tuple(mixture.METRICS)))


_PD = ", ".join(
    f"r4(coalesce(cluster_{m}_{s} - lag(cluster_{m}_{s}) OVER w, 0)) AS cluster_delta_{m}_{s}"
    for m in ("speed", "density")
    for s in map(mixture.label_suffix, LABELS)
)


@query(
    "WN03_pivoted_deltas",
    f"SELECT gantry, interval_start, {_PD} FROM mixture_matrix WINDOW w AS (PARTITION BY gantry ORDER BY interval_start)",
    "mixture_matrix",
)
def _(spark, sf):
    matrix = mix_matrix(spark, sf, ("speed", "density"), entropy=False)
    out = mixture.pivoted_deltas(matrix, LABELS)
    return rounded(out.select("gantry", "interval_start", *[c for c in out.columns if "delta" in c]))
