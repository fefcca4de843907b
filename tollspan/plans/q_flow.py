"""Queries: flow features and plate behaviour."""

from __future__ import annotations

from tollspan.operators import clean, flow, plate
from tollspan.plans.registry import cte, query, rounded
from tollspan.plans.views import view


cte(
    "flow_core",
    """
SELECT gantry, time_bucket(INTERVAL 5 minute, ts) AS interval_start,
       CASE category WHEN 1 THEN 'Light' WHEN 2 THEN 'Heavy' WHEN 3 THEN 'Heavy' ELSE 'Motorcycles' END AS class_label,
       count(*) AS flow_count, avg(speed_kmh) AS speed_mean, coalesce(stddev_samp(speed_kmh), 0.0) AS speed_std,
       count(*) * 12e0 AS flow_per_hour,
       CASE WHEN avg(speed_kmh) > 0 THEN count(*) * 12e0 / avg(speed_kmh) ELSE 0 END AS density
FROM detections GROUP BY 1, 2, 3""",
    "detections",
)
cte(
    "flow_delta",
    """
SELECT *, coalesce(speed_mean - lag(speed_mean) OVER w, 0) AS delta_speed,
       coalesce(density - lag(density) OVER w, 0) AS delta_density
FROM flow_core WINDOW w AS (PARTITION BY gantry, class_label ORDER BY interval_start)""",
    "flow_core",
)
METRIC_COLS = ["flow", "speed", "speed_std", "density", "delta_speed", "delta_density"]


def _flow_cells(metrics, wrap="r4"):
    return ", ".join(
        f"{wrap}(coalesce(max(CASE WHEN class_label = '{label}' THEN {flow.METRICS[m]} END), 0e0)) AS {m}_{label.lower()}"
        for m in metrics
        for label in flow.LABELS
    )


cte(
    "flow_matrix",
    f"SELECT gantry, interval_start, {_flow_cells(['flow', 'speed', 'density'], '')} FROM flow_core GROUP BY 1, 2",
    "flow_core",
)


@query(
    "AG01_flow_core",
    """SELECT gantry, interval_start, class_label, flow_count, r4(speed_mean) AS speed_mean,
    r4(speed_std) AS speed_std, r4(flow_per_hour) AS flow_per_hour, r4(density) AS density FROM flow_core""",
    "flow_core",
)
def _(spark, sf):
    return rounded(flow.flow_core(view(spark, sf, "detections")))


@query(
    "WN01_flow_deltas",
    """SELECT gantry, interval_start, class_label, r4(delta_speed) AS delta_speed,
    r4(delta_density) AS delta_density FROM flow_delta""",
    "flow_delta",
)
def _(spark, sf):
    out = flow.flow_with_deltas(view(spark, sf, "detections"))
    return rounded(out.select("gantry", "interval_start", "class_label", "delta_speed", "delta_density"))


@query(
    "RS01_flow_matrix",
    f"SELECT gantry, interval_start, {_flow_cells(METRIC_COLS)} FROM flow_delta GROUP BY 1, 2",
    "flow_delta",
)
def _(spark, sf):
    return rounded(flow.flow_matrix(view(spark, sf, "detections"), metrics=METRIC_COLS))


# ---- plate behaviour -------------------------------------------------------

cte(
    "norm",
    r"""
SELECT event_id, ts, speed_kmh, category,
  CASE WHEN upper(trim(plate)) IN ('', 'NAN', 'NULL', 'NONE') THEN NULL ELSE upper(trim(plate)) END AS plate,
  CASE WHEN upper(trim(gantry)) IN ('', 'NAN', 'NULL', 'NONE') THEN NULL ELSE
    coalesce(CASE WHEN try_cast(replace(trim(gantry), ',', '.') AS DOUBLE) = floor(try_cast(replace(trim(gantry), ',', '.') AS DOUBLE))
                  THEN CAST(CAST(try_cast(replace(trim(gantry), ',', '.') AS DOUBLE) AS BIGINT) AS VARCHAR)
                  ELSE CAST(try_cast(replace(trim(gantry), ',', '.') AS DOUBLE) AS VARCHAR) END, upper(trim(gantry))) END AS gantry,
  try_cast(lane AS DOUBLE) AS lane
FROM dirty""",
    "dirty",
)
cte(
    "cleaned",
    """SELECT event_id, ts, speed_kmh, category, plate, gantry, CAST(lane AS INT) AS lane FROM norm
WHERE length(plate) BETWEEN 5 AND 6 AND ts IS NOT NULL AND speed_kmh IS NOT NULL AND lane IN (1, 2, 3)""",
    "norm",
)
cte(
    "deduped",
    """SELECT event_id, ts, speed_kmh, category, plate, gantry, lane FROM (
SELECT *, row_number() OVER (PARTITION BY plate, gantry, lane, ts ORDER BY speed_kmh, event_id) AS rn FROM cleaned) q
WHERE rn = 1""",
    "cleaned",
)
cte(
    "bounds",
    """SELECT gantry, lane, quantile_cont(speed_kmh, 0.01) AS lo, quantile_cont(speed_kmh, 0.99) AS hi
FROM deduped WHERE gantry IS NOT NULL GROUP BY 1, 2""",
    "deduped",
)
cte(
    "winsorised",
    """SELECT d.event_id, d.ts, CASE WHEN lo IS NULL THEN speed_kmh ELSE least(greatest(speed_kmh, lo), hi) END AS speed_kmh,
d.category, d.plate, d.gantry, d.lane FROM deduped d LEFT JOIN bounds b ON d.gantry = b.gantry AND d.lane = b.lane""",
    "deduped bounds",
)


def behaviour_ctes(source: str, tag: str) -> None:
    """Named steps of the plate vector over `source`; `tag` keeps the names apart."""
    cases = " ".join(f"WHEN '{k}' THEN {v}" for k, v in plate.S.TTC_LIMIT_S.items())
    cte(
        f"follow{tag}",
        f"""
SELECT s.*, CASE WHEN gap > 0 AND gap <= 60 THEN gap END AS headway_s,
  CASE WHEN gap > 0 AND gap <= 60 THEN
     CASE WHEN speed_kmh > prev_speed AND gap * speed_kmh / (speed_kmh - prev_speed) < lim THEN 1 ELSE 0 END END AS conflict,
  CASE WHEN gantry IS NOT NULL THEN speed_kmh / slot_mean END AS relative_speed
FROM (SELECT t.*, CASE WHEN gantry IS NOT NULL THEN date_diff('microsecond', lag(ts) OVER v, ts) / 1000000.0 END AS gap,
   lag(speed_kmh) OVER v AS prev_speed, CASE gantry {cases} END AS lim,
   avg(speed_kmh) OVER (PARTITION BY gantry, time_bucket(INTERVAL 5 minute, ts)) AS slot_mean,
   CASE WHEN lane <> lag(lane) OVER p THEN 1 ELSE 0 END AS lane_change
   FROM {source} t WINDOW v AS (PARTITION BY gantry, lane ORDER BY ts, plate, speed_kmh, event_id),
   p AS (PARTITION BY plate ORDER BY ts, gantry NULLS FIRST, event_id)) s""",
        source,
    )


behaviour_ctes("winsorised", "")
VECTOR = """count(*) AS total_passes, r4(avg(speed_kmh)) AS avg_speed_kmh,
r4(avg(relative_speed)) AS avg_relative_speed, r4(avg(headway_s)) AS avg_headway_s,
r4(avg(conflict)) AS conflict_rate,
r4(count(*) FILTER (lane = 1) / count(*)) AS lane_prop_1, r4(count(*) FILTER (lane = 2) / count(*)) AS lane_prop_2,
r4(count(*) FILTER (lane = 3) / count(*)) AS lane_prop_3, CAST(sum(lane_change) AS BIGINT) AS lane_changes,
r4(CASE WHEN count(*) > 1 THEN sum(lane_change) / (count(*) - 1) ELSE 0 END) AS lane_change_rate,
CAST(count(DISTINCT CAST(ts AS DATE)) AS INT) AS n_days_active,
CAST(count(DISTINCT extract(isoyear FROM ts) * 100 + extract(week FROM ts)) AS INT) AS n_weeks_active,
CAST(count(DISTINCT strftime(ts, '%Y-%m')) AS INT) AS n_months_active"""
COUNTS = ", count(relative_speed) AS rel_speed_count, count(headway_s) AS headway_count, count(conflict) AS conflict_count"


@query("AG09_plate_vector", f"SELECT plate, {VECTOR}{COUNTS} FROM follow GROUP BY plate", "follow")
def _(spark, sf):
    rows = clean.behaviour_input(view(spark, sf, "dirty"))
    return rounded(plate.sorted_features(plate.plate_features(rows, include_counts=True)))
