"""Queries: streaming features, drained over the whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tollspan.operators import clean
from tollspan.plans import q_road, q_study
from tollspan.plans.registry import cte, query, rounded
from tollspan.plans.views import stream_view
from tollspan.session import fresh_path
from tollspan.streaming import streams

_CLOSED = "(SELECT max(ts) - INTERVAL 10 minute AS mark FROM detections) m WHERE interval_start + INTERVAL {} minute <= mark"


@query(
    "SS01_flow_stream",
    f"""SELECT gantry, interval_start, class_label, flow_count, r4(speed_mean) AS speed_mean, r4(speed_std) AS speed_std,
    r4(flow_per_hour) AS flow_per_hour, r4(density) AS density FROM flow_core, {_CLOSED.format(5)}""",
    "flow_core detections",
)
def _(spark, sf):
    return rounded(streams.drain(streams.flow_stream(stream_view(spark, sf, "detections")), "flow"))


@query(
    "SS02_sliding_flow",
    f"""SELECT gantry, interval_start, class_label, flow_count, r4(speed_mean) AS speed_mean FROM (
    SELECT gantry, time_bucket(INTERVAL 5 minute, ts) - to_minutes(CAST(o AS BIGINT)) AS interval_start,
    CASE category WHEN 1 THEN 'Light' WHEN 4 THEN 'Motorcycles' ELSE 'Heavy' END AS class_label, count(*) AS flow_count, avg(speed_kmh) AS speed_mean
    FROM detections, (VALUES (0), (5), (10)) g(o) GROUP BY 1, 2, 3) q, {_CLOSED.format(15)}""",
    "detections",
)
def _(spark, sf):
    out = streams.drain(streams.flow_stream(stream_view(spark, sf, "detections"), 15, 5), "sliding")
    return rounded(out.select("gantry", "interval_start", "class_label", "flow_count", "speed_mean"))


def finished(rows, stream, name: str):
    """All that a stream makes of an input that is over."""
    closing = streams.Closing(rows)
    return streams.drain(stream(closing.rows), name, closing=closing)


cte(
    "lead_vehicle",
    """SELECT *, date_diff('microsecond', lag(ts) OVER w, ts) / 1000000.0::DOUBLE AS headway_s, lag(speed_kmh) OVER w AS prev_speed
FROM detections WINDOW w AS (PARTITION BY gantry, lane ORDER BY ts, plate, event_id)""",
    "detections",
)


@query(
    "SS03_headway_stream",
    """SELECT event_id, plate, gantry, lane, r4(headway_s) AS headway_s, r4(prev_speed) AS prev_speed FROM lead_vehicle
    WHERE headway_s IS NOT NULL""",
    "lead_vehicle",
)
def _(spark, sf):
    out = finished(stream_view(spark, sf, "detections"), streams.headway_stream, "headway")
    return rounded(out.drop("speed_kmh"))


@query(
    "SS03_conflict_stream",
    """SELECT plate, r4(avg(conflict)) AS conflict_rate, count(conflict) AS conflict_count FROM follow_det
    GROUP BY 1 HAVING count(conflict) > 0""",
    "follow_det",
)
def _(spark, sf):
    out = finished(stream_view(spark, sf, "detections"), streams.headway_stream, "headway")
    return rounded(
        streams.conflict_columns(out)
        .groupBy("plate")
        .agg(F.avg("conflict").alias("conflict_rate"), F.count("conflict").alias("conflict_count"))
    )


@query(
    "SS04_lane_change_stream",
    """SELECT plate, count(*) AS passes, CAST(sum(lane_change) AS BIGINT) AS lane_changes FROM follow_det
    GROUP BY 1""",
    "follow_det",
)
def _(spark, sf):
    out = finished(stream_view(spark, sf, "detections"), streams.lane_change_stream, "lanes")
    return out.groupBy("plate").agg(F.sum("passes").alias("passes"), F.sum("lane_changes").alias("lane_changes"))


@query(
    "SS05_session_trips",
    """SELECT plate, n_passes, first_ts, last_ts FROM (SELECT plate, count(*) AS n_passes, min(ts) AS first_ts, max(ts) AS last_ts FROM (
    SELECT plate, ts, sum(b) OVER (PARTITION BY plate ORDER BY ts, event_id) AS s FROM (SELECT plate, ts, event_id,
    CASE WHEN ts < lag(ts) OVER (PARTITION BY plate ORDER BY ts, event_id) + INTERVAL 20 minute THEN 0 ELSE 1 END AS b FROM detections) a) b
    GROUP BY plate, s) c""",
    "detections",
)
def _(spark, sf):
    return finished(stream_view(spark, sf, "detections"), lambda rows: streams.session_stream(rows, "20 minutes"), "sessions")


@query("SS05_trip_stream", "SELECT event_id, plate, trip_no, brk AS trip_break FROM traj", "traj")
def _(spark, sf):
    from tollspan.plans.views import view

    posts = q_road.gantries(spark, sf).select("gantry", "km")
    # the duplicate rule needs whole tables, so the stream starts from the cleaned passes
    path = fresh_path(spark, "passes")
    clean.trajectory_input(view(spark, sf, "detections"), q_road.gantries(spark, sf)).drop("km").write.parquet(path)
    closing = streams.Closing(streams.table_stream(spark, path, "*.parquet"))
    rows = closing.rows.join(posts, "gantry", "left").filter(F.col("km").isNotNull() | (F.col("gantry") == streams.CLOSED))
    return streams.drain(streams.trip_stream(rows), "trips", closing=closing)


@query(
    "SS06_ingest_stream",
    "SELECT ts, speed_kmh, category, plate, gantry, lane FROM parsed WHERE ts IS NOT NULL AND category IS NOT NULL",
    "parsed",
)
def _(spark, sf):
    folder = q_study.as_files(spark, sf)
    table, state = fresh_path(spark, "table"), fresh_path(spark, "table-state")
    streams.ingest_stream(spark, folder, table, state)
    return streams.ingest_stream(spark, folder, table, state)  # nothing new: nothing is added


@query(
    "SS07_best_board",
    "SELECT result_type, metric, run_id FROM (SELECT *, row_number() OVER (PARTITION BY result_type ORDER BY metric DESC, run_id) AS r FROM runs WHERE metric IS NOT NULL AND error IS NULL) q WHERE r = 1",
    "runs",
)
def _(spark, sf):
    return streams.best_board(stream_view(spark, sf, "runs"), ["result_type"], "metric", ["run_id"])


@query(
    "SS08_dedupe_stream",
    "SELECT DISTINCT plate, gantry, lane, ts FROM detections",
    "detections",
)
def _(spark, sf):
    rows = stream_view(spark, sf, "detections")
    twice = rows.unionByName(rows.filter("event_id % 3 = 0").withColumn("speed_kmh", F.col("speed_kmh") + 1))
    return streams.drain(streams.dedupe_stream(twice), "dedupe").select("plate", "gantry", "lane", "ts")
