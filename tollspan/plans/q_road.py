"""Queries: catalogue, events, sections, geography and trajectories."""

from __future__ import annotations

from pyspark.sql import functions as F

from tollspan.functions import scalars as S
from tollspan.operators import catalog, clean, events, flow, geo, sections, trajectory
from tollspan.operators import mixture as mix
from tollspan.plans import q_plate
from tollspan.plans.q_scalars import slerp_sql
from tollspan.plans.registry import cte, query, rounded
from tollspan.plans.views import view
from tollspan.session import durable

# ---- SQL steps -----------------------------------------------------------------------


def placed_sql(cat: str) -> str:
    return f"""SELECT upper(trim(axis)) AS ax, upper(trim(carriageway)) AS way, gantry, km, row_number() OVER w AS i,
lead(gantry) OVER w AS nxt, lead(km) OVER w AS nxt_km, count(*) OVER (PARTITION BY axis, carriageway) AS n,
first_value(km) OVER w <= coalesce(nth_value(km, 2) OVER (PARTITION BY axis, carriageway ORDER BY seq, gantry
ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), 1e9) AS up
FROM {cat} WHERE km IS NOT NULL WINDOW w AS (PARTITION BY axis, carriageway ORDER BY seq, gantry)"""


def bracket_sql(ev: str, placed: str) -> str:
    return f"""SELECT e.*, CASE WHEN h.i IS NOT NULL THEN h.gantry WHEN l.n >= 2 AND
  ((l.up AND e.km > l.km) OR (NOT l.up AND e.km < l.km)) THEN l.gantry END AS gantry_before,
CASE WHEN h.i IS NOT NULL THEN h.nxt WHEN f.n = 1 THEN f.gantry
  WHEN (f.up AND e.km < f.km) OR (NOT f.up AND e.km > f.km) THEN f.gantry END AS gantry_after
FROM {ev} e LEFT JOIN (SELECT event_id, min(i) AS i, arg_min(gantry, i) AS gantry, arg_min(nxt, i) AS nxt FROM (
  SELECT x.event_id, p.i, p.gantry, p.nxt FROM {ev} x JOIN {placed} p ON upper(trim(x.axis)) = p.ax
  AND upper(trim(x.carriageway)) = p.way AND p.nxt IS NOT NULL AND
  CASE WHEN p.up THEN x.km BETWEEN p.km AND p.nxt_km ELSE x.km BETWEEN p.nxt_km AND p.km END) q GROUP BY 1) h ON e.event_id = h.event_id
LEFT JOIN {placed} f ON upper(trim(e.axis)) = f.ax AND upper(trim(e.carriageway)) = f.way AND f.i = 1
LEFT JOIN {placed} l ON upper(trim(e.axis)) = l.ax AND upper(trim(e.carriageway)) = l.way AND l.i = l.n"""


cte("placed", placed_sql("gantries"), "gantries")
_WAY = "CASE lower(trim(calzada)) WHEN 'oriente' THEN 'Oriente' WHEN 'poniente' THEN 'Poniente' WHEN 'ambas' THEN 'Ambas' END"
_T0 = "try_strptime(concat(fecha_inicio, ' ', hora_inicio), '%d/%m/%Y %H:%M:%S')"
_T1 = "try_strptime(concat(fecha_fin, ' ', hora_fin), '%d/%m/%Y %H:%M:%S')"
cte(
    "acc_raw",
    rf"""SELECT event_id, {_T0} AS event_time,
round_even(date_diff('microsecond', {_T0}, {_T1}) / 60000000.0::DOUBLE, 0) AS duration_min,
try_cast(replace(km_txt, ',', '.') AS DOUBLE) AS km, eje AS axis, {_WAY} AS carriageway,
regexp_replace(subtipo, '^AC-0[1-6] -\s*', '') AS subtype,
CASE WHEN coalesce(try_cast("7" AS DOUBLE), 0) > 0 THEN '1' ELSE '0' END AS severity
FROM accident_log WHERE tipo = 'Accidente' AND lower(via) IN ('expresa', 'via expresa')""",
    "accident_log",
)
cte("acc_bracket", bracket_sql("acc_raw", "placed"), "acc_raw placed")
cte(
    "acc",
    """SELECT event_id, event_time, duration_min, km, axis, carriageway, subtype, severity, gantry_before AS last_gantry,
gantry_after AS next_gantry, gantry_before IS NOT NULL AS accepted FROM acc_bracket""",
    "acc_bracket",
)
cte(
    "ev_raw",
    f"""SELECT event_id, trim(tipo) AS event_type, {_T0} AS event_time, try_cast(replace(km_txt, ',', '.') AS DOUBLE) AS km,
eje AS axis, {_WAY} AS carriageway, trim(descripcion) AS description, trim(subtipo) AS subtype
FROM accident_log WHERE lower(via) IN ('expresa', 'via expresa')""",
    "accident_log",
)
cte("ev_bracket", bracket_sql("ev_raw", "placed"), "ev_raw placed")
cte(
    "ev",
    """SELECT event_id, event_type, event_time, km, axis, carriageway, description, subtype,
coalesce(gantry_before, '') AS gantry_start, coalesce(gantry_after, '') AS gantry_end, gantry_before AS last_gantry FROM ev_bracket""",
    "ev_bracket",
)
SECTIONS = """SELECT * FROM (SELECT axis, carriageway, gantry AS gantry_last, km AS km_last, lead(gantry) OVER w AS gantry_next,
lead(km) OVER w AS km_next FROM {} WINDOW w AS (PARTITION BY axis, carriageway ORDER BY seq, gantry)) q WHERE gantry_next IS NOT NULL"""
cte("sections", SECTIONS.format("gantries"), "gantries")
_F = ["flow", "speed", "density"]
_COLS = [f"{m}_{c.lower()}" for m in _F for c in flow.LABELS]
cte(
    "section_matrix",
    f"""SELECT s.*, a.interval_start, {", ".join(f"a.{c} AS last_{c}, b.{c} AS next_{c}" for c in _COLS)}
FROM sections s JOIN flow_matrix a ON s.gantry_last = a.gantry JOIN flow_matrix b ON s.gantry_next = b.gantry
AND a.interval_start = b.interval_start""",
    "sections flow_matrix",
)
cte(
    "acc_slots",
    """SELECT DISTINCT last_gantry AS gantry, time_bucket(INTERVAL 5 minute, event_time) - INTERVAL 5 minute AS interval_start
FROM acc WHERE last_gantry IS NOT NULL AND event_time IS NOT NULL""",
    "acc",
)


def gantries(spark, sf):
    return view(spark, sf, "gantries")


def acc(spark, sf):
    return events.prepare_accidents(view(spark, sf, "accident_log"), gantries(spark, sf))


def ev(spark, sf):
    return events.prepare_events(view(spark, sf, "accident_log"), gantries(spark, sf))


def matrix(spark, sf):
    return flow.flow_matrix(view(spark, sf, "detections"))


# ---- catalogue ----------------------------------------------------------------------------


@query("WN07_sections", f"SELECT * FROM ({SECTIONS.format('road_posts')}) z", "road_posts")
def _(spark, sf):
    return catalog.consecutive_sections(view(spark, sf, "road_posts"))


@query(
    "AG32_gantry_sequences",
    "SELECT axis, carriageway, string_agg(gantry, ' > ' ORDER BY seq, gantry) AS gantries FROM road_posts GROUP BY 1, 2",
    "road_posts",
)
def _(spark, sf):
    return catalog.gantry_sequences(view(spark, sf, "road_posts"))


cte(
    "post_events",
    """SELECT event_id, concat('A', CAST(event_id % 6 AS VARCHAR)) AS axis,
CASE WHEN event_id % 2 = 0 THEN 'oriente' ELSE 'Poniente ' END AS carriageway,
CASE WHEN event_id % 2 = 0 THEN speed_kmh / 4 ELSE 500 - speed_kmh / 4 END AS km FROM detections""",
    "detections",
)
cte("placed_posts", placed_sql("road_posts"), "road_posts")


def post_events(spark, sf):
    even = F.col("event_id") % 2 == 0
    return view(spark, sf, "detections").select(
        "event_id",
        F.concat(F.lit("A"), (F.col("event_id") % 6).cast("string")).alias("axis"),
        F.when(even, "oriente").otherwise("Poniente ").alias("carriageway"),
        F.when(even, F.col("speed_kmh") / 4).otherwise(500 - F.col("speed_kmh") / 4).alias("km"),
    )


@query(
    "JN07_bracket_gantries",
    f"SELECT event_id, gantry_before, gantry_after FROM ({bracket_sql('post_events', 'placed_posts')}) z",
    "post_events placed_posts",
)
def _(spark, sf):
    out = catalog.bracket_gantries(post_events(spark, sf), view(spark, sf, "road_posts"))
    return out.select("event_id", "gantry_before", "gantry_after")


_NEAR = """SELECT event_id, max(CASE WHEN r = 1 THEN gantry END) AS first_gantry, max(CASE WHEN r = 2 THEN gantry END) AS second_gantry FROM (
    SELECT e.event_id, p.gantry, row_number() OVER (PARTITION BY e.event_id ORDER BY abs(p.km - e.km), p.km, p.gantry) AS r
    FROM {} e JOIN {} p ON e.axis = p.axis AND e.carriageway = p.carriageway WHERE p.lat IS NOT NULL AND p.lon IS NOT NULL
    AND e.km IS NOT NULL) q WHERE r <= 2 GROUP BY 1"""


cte(
    "near_events",
    """SELECT event_id, axis, CASE WHEN event_id % 2 = 0 THEN 'Oriente' ELSE 'Poniente' END AS carriageway, km + 0.013e0 AS km FROM post_events""",
    "post_events",
)


@query("JN11_two_nearest", _NEAR.format("near_events", "road_posts"), "near_events road_posts")
def _(spark, sf):
    pts = post_events(spark, sf).withColumns(
        {"carriageway": F.initcap(S.strip(F.col("carriageway"))), "km": F.col("km") + 0.013}
    )
    out = catalog.two_nearest(pts, view(spark, sf, "road_posts"))
    return out.select("event_id", F.col("near1.gantry").alias("first_gantry"), F.col("near2.gantry").alias("second_gantry"))


@query(
    "JN16_attach_coordinates",
    """SELECT r.gantry, r.axis, r.carriageway, coalesce(c.lat, d.lat) AS lat, coalesce(c.lon, d.lon) AS lon FROM road_posts r
    LEFT JOIN (SELECT * FROM road_posts WHERE seq % 3 > 0) c ON r.gantry = c.gantry AND r.axis = c.axis AND r.carriageway = c.carriageway
    LEFT JOIN (SELECT * FROM road_posts WHERE seq % 7 > 0) d ON r.gantry = d.gantry""",
    "road_posts",
)
def _(spark, sf):
    posts = view(spark, sf, "road_posts")
    full = posts.filter("seq % 3 > 0").select("gantry", "axis", "carriageway", "lat", "lon")
    by_id = posts.filter("seq % 3 = 0 AND seq % 7 > 0").select(
        "gantry", F.lit(None).cast("string").alias("axis"), F.lit(None).cast("string").alias("carriageway"), "lat", "lon"
    )
    out = catalog.attach_coordinates(posts.drop("lat", "lon"), full.unionByName(by_id))
    return out.select("gantry", "axis", "carriageway", "lat", "lon")


# ---- events -----------------------------------------------------------------------------------


@query(
    "CL09_accident_rows",
    "SELECT event_id, via FROM accident_log WHERE tipo = 'Accidente' AND lower(via) IN ('expresa', 'via expresa')",
    "accident_log",
)
def _(spark, sf):
    return clean.accident_rows(view(spark, sf, "accident_log")).select("event_id", "via")


@query("GE05_prepare_accidents", "SELECT * FROM acc", "acc")
def _(spark, sf):
    return acc(spark, sf)


@query("GE04_prepare_events", "SELECT * FROM ev", "ev")
def _(spark, sf):
    return ev(spark, sf)


@query(
    "CL10_event_filter",
    """SELECT event_id, event_time FROM ev WHERE event_type IN ('Accidente') AND event_time >= TIMESTAMP '2024-01-01'
    AND event_time < TIMESTAMP '2024-01-02' AND gantry_start = '2' AND gantry_end = '3'""",
    "ev",
)
def _(spark, sf):
    out = clean.filter_events(ev(spark, sf), ["Accidente"], "2024-01-01", "2024-01-01", "2", "3")
    return out.select("event_id", "event_time")


@query(
    "JN08_accidents_matched",
    """SELECT event_id, EXISTS (SELECT 1 FROM flow_core f WHERE f.gantry = last_gantry AND f.interval_start =
    time_bucket(INTERVAL 5 minute, event_time) - INTERVAL 5 minute) AS matched FROM acc""",
    "acc flow_core",
)
def _(spark, sf):
    a, f = acc(spark, sf), matrix(spark, sf).select("gantry", "interval_start")
    hit = sections.accidents_with_features(a, f).select("event_id", F.lit(True).alias("matched"))
    miss = sections.accidents_with_features(a, f, matched=False).select("event_id", F.lit(False).alias("matched"))
    return hit.unionByName(miss)


@query(
    "JN08_accidents_excluded",
    "SELECT event_id, km, next_gantry FROM acc WHERE NOT accepted",
    "acc",
)
def _(spark, sf):
    return events.excluded(acc(spark, sf)).select("event_id", "km", "next_gantry")


@query(
    "JN17_fill_brackets",
    """SELECT event_id, nullif(gantry_start, '') AS gantry_start, nullif(gantry_end, '') AS gantry_end,
    event_id % 4 = 0 AND last_gantry IS NOT NULL AS fixed FROM ev""",
    "ev",
)
def _(spark, sf):
    blank = F.col("event_id") % 4 == 0
    stored = ev(spark, sf).withColumns(
        {c: F.when(blank, F.lit(None)).otherwise(F.col(c)) for c in ("gantry_start", "gantry_end", "last_gantry")}
    )
    out = events.fill_missing_brackets(stored, gantries(spark, sf))
    return out.select("event_id", "gantry_start", "gantry_end", "fixed")


# ---- sections and targets -----------------------------------------------------------------------


@query(
    "JN06_target",
    f"""SELECT m.gantry, m.interval_start, r4(flow_light) AS flow_light, CASE WHEN a.gantry IS NULL THEN 0 ELSE 1 END AS target
    FROM flow_matrix m LEFT JOIN acc_slots a ON m.gantry = a.gantry AND m.interval_start = a.interval_start""",
    "flow_matrix acc_slots",
)
def _(spark, sf):
    out = sections.add_target(matrix(spark, sf), acc(spark, sf))
    return rounded(out.select("gantry", "interval_start", "flow_light", "target"))


@query("ST02_accident_slots", "SELECT * FROM acc_slots", "acc_slots")
def _(spark, sf):
    return sections.accident_slots(acc(spark, sf))


@query(
    "JN04_flow_and_mixture",
    f"""SELECT m.gantry, m.interval_start, {", ".join(f"r4({c}) AS {c}" for c in _COLS)},
    {", ".join(f"r4(coalesce(cluster_{m}_{mix.label_suffix(k)}, 0)) AS cluster_{m}_{mix.label_suffix(k)}" for m in ("share", "speed", "density") for k in q_plate.LABELS)},
    r4(coalesce(cluster_entropy, 0)) AS cluster_entropy FROM flow_matrix m LEFT JOIN mixture_matrix x
    ON m.gantry = x.gantry AND m.interval_start = x.interval_start""",
    "flow_matrix mixture_matrix",
)
def _(spark, sf):
    mixm = q_plate.mix_matrix(spark, sf, ("share", "speed", "density"))
    return rounded(sections.combine_features(matrix(spark, sf), mixm))


def sec_matrix(spark, sf):
    return sections.section_matrix(catalog.consecutive_sections(gantries(spark, sf)), matrix(spark, sf))


@query(
    "JN05_section_matrix",
    f"""SELECT axis, carriageway, gantry_last, gantry_next, km_last, km_next, interval_start,
    {", ".join(f"r4(last_{c}) AS last_{c}, r4(next_{c}) AS next_{c}" for c in _COLS)} FROM section_matrix""",
    "section_matrix",
)
def _(spark, sf):
    return rounded(sec_matrix(spark, sf))


@query(
    "RS04_prefixed_block",
    f"""SELECT gantry AS last_gantry, interval_start, {", ".join(f"r4({c}) AS last_{c}" for c in _COLS)} FROM flow_matrix""",
    "flow_matrix",
)
def _(spark, sf):
    return rounded(sections.prefixed(matrix(spark, sf), "last_"))


@query(
    "CL06_section_filter",
    """SELECT interval_start, r4(last_speed_light) AS last_speed_light FROM section_matrix
    WHERE gantry_last = '2' AND gantry_next = '3' AND axis = 'N'""",
    "section_matrix",
)
def _(spark, sf):
    out = clean.filter_section(sec_matrix(spark, sf), "2", "3", axis="N")
    return rounded(out.select("interval_start", "last_speed_light"))


@query(
    "CL05_gantry_range",
    "SELECT event_id, gantry FROM detections WHERE gantry IN ('2', '3', '4')",
    "detections",
)
def _(spark, sf):
    between = clean.gantries_between(gantries(spark, sf), "N", "Oriente", "4", "2")
    return clean.keep_section(view(spark, sf, "detections"), between).select("event_id", "gantry")


_PER = """SELECT s.axis, s.carriageway, s.gantry_last, s.gantry_next, count(a.event_id) AS n_accidents FROM sections s
    LEFT JOIN (SELECT * FROM acc WHERE accepted) a ON s.gantry_last = a.last_gantry AND s.gantry_next = a.next_gantry GROUP BY 1, 2, 3, 4"""


def per_section(spark, sf):
    secs = catalog.consecutive_sections(gantries(spark, sf))
    return sections.accidents_per_section(secs, events.accepted(acc(spark, sf)))


@query("AG24_accidents_per_section", _PER, "sections acc")
def _(spark, sf):
    return per_section(spark, sf).drop("km_last", "km_next")


@query(
    "JN09_section_counts",
    f"SELECT gantry_last, gantry_next, n_accidents FROM ({_PER}) z WHERE n_accidents >= 0",
    "sections acc",
)
def _(spark, sf):
    return per_section(spark, sf).select("gantry_last", "gantry_next", "n_accidents").orderBy("gantry_last")


cte(
    "status",
    """SELECT a.event_id, CASE WHEN f.gantry IS NOT NULL THEN 'matched' WHEN event_time IS NULL THEN 'no time'
WHEN last_gantry IS NULL THEN 'no gantry' WHEN event_time < lo OR event_time > hi + INTERVAL 5 minute THEN 'out of range'
WHEN last_gantry NOT IN (SELECT gantry FROM feat) THEN 'gantry absent' ELSE 'interval absent' END AS status
FROM acc a LEFT JOIN (SELECT DISTINCT gantry, interval_start FROM feat) f ON a.last_gantry = f.gantry
AND time_bucket(INTERVAL 5 minute, a.event_time) - INTERVAL 5 minute = f.interval_start,
(SELECT min(interval_start) AS lo, max(interval_start) AS hi FROM feat) b""",
    "acc feat",
)
cte(
    "feat",
    "SELECT gantry, interval_start FROM flow_matrix",
    "flow_matrix",
)


def statuses(spark, sf):
    return sections.match_status(acc(spark, sf), matrix(spark, sf).select("gantry", "interval_start"))


@query("AG25_match_status", "SELECT event_id, status FROM status", "status")
def _(spark, sf):
    return statuses(spark, sf).select("event_id", "status")


@query("AG25_match_status_counts", "SELECT status, count(*) AS n FROM status GROUP BY 1", "status")
def _(spark, sf):
    return sections.status_counts(statuses(spark, sf))


_RANGES = """SELECT gantry_last, gantry_next, min(interval_start) AS feature_min, max(interval_start) AS feature_max
    FROM section_matrix GROUP BY 1, 2"""
cte("ranges", f"SELECT p.*, r.feature_min, r.feature_max FROM ({_PER}) p JOIN ({_RANGES}) r USING (gantry_last, gantry_next)", "sections acc section_matrix")


def ranges(spark, sf):
    secs = catalog.consecutive_sections(gantries(spark, sf))
    return sections.section_ranges(sec_matrix(spark, sf), secs, events.accepted(acc(spark, sf)))


@query("AG29_section_ranges", "SELECT * FROM ranges ORDER BY n_accidents DESC, gantry_last, gantry_next LIMIT 5", "ranges")
def _(spark, sf):
    return sections.rank_sections(ranges(spark, sf), 5)


_LENGTHS = (0.05, 0.1, 0.25)
cte(
    "windows",
    """SELECT gantry_last, gantry_next, window_days, t AS window_start, t + to_microseconds(len) AS window_end, n AS n_accidents,
n / greatest(window_days, 1e0) AS per_day FROM (SELECT *, row_number() OVER (PARTITION BY gantry_last, gantry_next, len ORDER BY n DESC, t) AS r FROM (
SELECT r.gantry_last, r.gantry_next, g.d AS window_days, CAST(round(g.d * 86400000000) AS BIGINT) AS len, a.event_time AS t,
count(DISTINCT b.event_id) AS n FROM ranges r JOIN acc a ON a.last_gantry = r.gantry_last AND a.next_gantry = r.gantry_next
JOIN (VALUES (0.05e0), (0.1e0), (0.25e0)) g(d) ON a.event_time >= r.feature_min
AND a.event_time <= r.feature_max - to_microseconds(CAST(round(g.d * 86400000000) AS BIGINT))
JOIN acc b ON b.last_gantry = r.gantry_last AND b.next_gantry = r.gantry_next AND b.event_time >= a.event_time
AND b.event_time <= a.event_time + to_microseconds(CAST(round(g.d * 86400000000) AS BIGINT)) AND b.event_time <= r.feature_max
GROUP BY 1, 2, 3, 4, 5) q) z WHERE r = 1""",
    "ranges acc",
)


def windows(spark, sf):
    return sections.densest_windows(events.accepted(acc(spark, sf)), ranges(spark, sf), _LENGTHS)


@query("WN08_densest_windows", """SELECT gantry_last, gantry_next, r4(window_days) AS window_days, window_start, window_end,
n_accidents, r4(per_day) AS per_day FROM windows""", "windows")  # fmt: skip
def _(spark, sf):
    return rounded(windows(spark, sf))


@query("RS05_top_candidates", """SELECT gantry_last, gantry_next, r4(window_days) AS window_days, window_start, window_end,
n_accidents, r4(per_day) AS per_day FROM windows ORDER BY per_day DESC, n_accidents DESC, gantry_last, gantry_next, window_days LIMIT 6""", "windows")  # fmt: skip
def _(spark, sf):
    return rounded(sections.top_candidates(windows(spark, sf), 6))


@query(
    "JN13_section_lengths",
    f"SELECT axis, gantry_last, gantry_next, CAST(d AS INT) AS window_days FROM ({SECTIONS.format('road_posts')}) z, generate_series(5, 30, 5) g(d)",
    "road_posts",
)
def _(spark, sf):
    out = sections.section_lengths(catalog.consecutive_sections(view(spark, sf, "road_posts")), 5, 30, 5)
    return out.select("axis", "gantry_last", "gantry_next", "window_days")


@query(
    "JN15_section_info",
    """SELECT a.event_id, a.last_gantry AS gantry_last, a.next_gantry AS gantry_next, s.axis, s.carriageway FROM acc a
    LEFT JOIN sections s ON a.last_gantry = s.gantry_last AND a.next_gantry = s.gantry_next""",
    "acc sections",
)
def _(spark, sf):
    a = acc(spark, sf).select("event_id", F.col("last_gantry").alias("gantry_last"), F.col("next_gantry").alias("gantry_next"))
    return sections.attach_section_info(a, catalog.consecutive_sections(gantries(spark, sf)))


@query(
    "ST04_build_diagnostics",
    """SELECT 'input_rows' AS stage, (SELECT count(*) FROM detections) AS n UNION ALL SELECT 'feature_rows', (SELECT count(*) FROM flow_matrix)
    UNION ALL SELECT 'shared_gantries', (SELECT count(*) FROM (SELECT gantry_last AS g FROM sections UNION SELECT gantry_next FROM sections) q
    WHERE g IN (SELECT gantry FROM flow_matrix))""",
    "detections flow_matrix sections",
)
def _(spark, sf):
    secs = catalog.consecutive_sections(gantries(spark, sf))
    return sections.build_diagnostics(view(spark, sf, "detections"), matrix(spark, sf), secs)


# ---- geography -----------------------------------------------------------------------------------

cte(
    "ev_near",
    """SELECT event_id, max(CASE WHEN r = 1 THEN km END) AS k1, max(CASE WHEN r = 1 THEN lat END) AS a1, max(CASE WHEN r = 1 THEN lon END) AS o1,
max(CASE WHEN r = 2 THEN km END) AS k2, max(CASE WHEN r = 2 THEN lat END) AS a2, max(CASE WHEN r = 2 THEN lon END) AS o2 FROM (
SELECT e.event_id, p.km, p.lat, p.lon, row_number() OVER (PARTITION BY e.event_id ORDER BY abs(p.km - e.km), p.km, p.gantry) AS r
FROM ev e JOIN gantries p ON e.axis = p.axis AND e.carriageway = p.carriageway WHERE p.lat IS NOT NULL AND p.lon IS NOT NULL
AND e.km IS NOT NULL) q WHERE r <= 2 GROUP BY 1""",
    "ev gantries",
)


def _frac(km: str, a: str, b: str) -> str:
    return f"CASE WHEN abs({a} - {b}) <= 1e-8 + 1e-5 * abs({b}) THEN 0 ELSE least(greatest(({km} - {a}) / ({b} - {a}), 0), 1) END"


def _coords(which: str) -> str:
    c = "a" if which == "lat" else "o"
    return f"""CASE WHEN sa IS NOT NULL AND so IS NOT NULL AND ea IS NOT NULL AND eo IS NOT NULL AND f IS NOT NULL
  THEN {slerp_sql('sa', 'so', 'ea', 'eo', 'f', which)}
  WHEN sa IS NOT NULL AND so IS NOT NULL THEN s{c} WHEN ea IS NOT NULL AND eo IS NOT NULL THEN e{c}
  WHEN k2 IS NOT NULL THEN {slerp_sql('a1', 'o1', 'a2', 'o2', 'f2', which)} ELSE {c}1 END"""


cte(
    "ev_in",
    f"""SELECT e.*, s.lat AS sa, s.lon AS so, t.lat AS ea, t.lon AS eo,
CASE WHEN e.km IS NOT NULL AND s.km IS NOT NULL AND t.km IS NOT NULL THEN {_frac('e.km', 's.km', 't.km')} END AS f,
n.k1, n.a1, n.o1, n.k2, n.a2, n.o2, CASE WHEN k2 IS NOT NULL THEN {_frac('e.km', 'n.k1', 'n.k2')} END AS f2
FROM ev e LEFT JOIN gantries s ON e.gantry_start = s.gantry LEFT JOIN gantries t ON e.gantry_end = t.gantry
LEFT JOIN ev_near n ON e.event_id = n.event_id""",
    "ev gantries ev_near",
)
cte("ev_geo", f"SELECT event_id, event_type, description, subtype, {_coords('lat')} AS lat, {_coords('lon')} AS lon FROM ev_in", "ev_in")


def located(spark, sf):
    return geo.event_coordinates(ev(spark, sf), gantries(spark, sf))


@query("GE01_event_coordinates", "SELECT event_id, r4(lat) AS lat, r4(lon) AS lon FROM ev_geo", "ev_geo")
def _(spark, sf):
    return rounded(located(spark, sf).select("event_id", "lat", "lon"))


@query(
    "GE03_mapped_events",
    """SELECT event_id, r4(CASE WHEN event_id % 10 = 0 THEN -33.5 ELSE lat END) AS lat,
    r4(CASE WHEN event_id % 10 = 0 THEN -70.7 ELSE lon END) AS lon,
    coalesce(nullif(description, ''), nullif(subtype, ''), '') AS description FROM ev_geo
    WHERE event_id % 10 = 0 OR (lat IS NOT NULL AND lon IS NOT NULL)""",
    "ev_geo",
)
def _(spark, sf):
    known = F.col("event_id") % 10 == 0
    e = ev(spark, sf).withColumns({"lat": F.when(known, F.lit(-33.5)), "lon": F.when(known, F.lit(-70.7))})
    out = geo.mapped_events(e, located(spark, sf))
    return rounded(out.select("event_id", "lat", "lon", "description"))


@query(
    "GE06_density_grid",
    """SELECT round(lat + 1e-9, 3) AS lat, round(lon + 1e-9, 3) AS lon, count(*) AS n FROM ev_geo WHERE lat IS NOT NULL AND lon IS NOT NULL GROUP BY 1, 2""",
    "ev_geo",
)
def _(spark, sf):
    return geo.density_grid(located(spark, sf).filter("lat IS NOT NULL AND lon IS NOT NULL"))


cte(
    "way_points",
    """SELECT CAST(substr(axis, 2) AS BIGINT) * 2 + CASE WHEN carriageway = 'Oriente' THEN 0 ELSE 1 END AS way_id,
row_number() OVER (PARTITION BY axis, carriageway ORDER BY seq) - 1 AS point, lat, lon FROM road_posts""",
    "road_posts",
)
cte(
    "way_segments",
    """SELECT * FROM (SELECT way_id, point, lat, lon, lead(lat) OVER w AS lat2, lead(lon) OVER w AS lon2 FROM way_points
WINDOW w AS (PARTITION BY way_id ORDER BY point)) q WHERE lat2 IS NOT NULL""",
    "way_points",
)
cte(
    "gps",
    """SELECT event_id, -33 - (event_id % 997) * 0.0001e0 AS lat, -70 + (event_id % 1009) * 0.0001e0 - CASE WHEN event_id % 500 = 0 THEN 3 ELSE 0 END AS lon
FROM detections""",
    "detections",
)


def way_points(spark, sf):
    from pyspark.sql import Window

    w = Window.partitionBy("axis", "carriageway").orderBy("seq")
    way = F.substring("axis", 2, 10).cast("bigint") * 2 + F.when(F.col("carriageway") == "Oriente", 0).otherwise(1)
    return view(spark, sf, "road_posts").select(
        way.alias("way_id"), (F.row_number().over(w) - 1).alias("point"), "lat", "lon"
    )


def gps(spark, sf):
    far = F.when(F.col("event_id") % 500 == 0, 3).otherwise(0)
    return view(spark, sf, "detections").select(
        "event_id",
        (F.lit(-33) - (F.col("event_id") % 997) * 0.0001).alias("lat"),
        (F.lit(-70) + (F.col("event_id") % 1009) * 0.0001 - far).alias("lon"),
    )


_SNAP = """SELECT event_id, min(d) AS d FROM (SELECT event_id, pow(lon - (x0 + t * dx), 2) + pow(lat - (y0 + t * dy), 2) AS d FROM (
    SELECT event_id, lat, lon, x0, y0, dx, dy, CASE WHEN dx * dx + dy * dy = 0 THEN 0 ELSE
    least(greatest(((lon - x0) * dx + (lat - y0) * dy) / (dx * dx + dy * dy), 0), 1) END AS t FROM (
    SELECT g.event_id, g.lat, g.lon, s.lon AS x0, s.lat AS y0, s.lon2 - s.lon AS dx, s.lat2 - s.lat AS dy FROM gps g, way_segments s) q) r) z GROUP BY 1"""


@query("JN10_nearest_road_point", f"SELECT event_id, r4(d * 1e4) AS d2_e4 FROM ({_SNAP}) y", "gps way_segments")
def _(spark, sf):
    near = geo.snap_to_road(gps(spark, sf), geo.road_segments(way_points(spark, sf)))
    return rounded(near.select("event_id", (F.col("snap_d2") * 1e4).alias("d2_e4")))


@query("GE02_snap_events", f"SELECT event_id, r4(sqrt(d) * 100) AS moved_e2 FROM ({_SNAP}) y", "gps way_segments")
def _(spark, sf):
    pts = gps(spark, sf)
    out = geo.snapped(pts, geo.road_segments(way_points(spark, sf))).select(
        "event_id", F.col("lat").alias("y"), F.col("lon").alias("x")
    )
    moved = F.sqrt(F.pow(F.col("x") - F.col("lon"), 2) + F.pow(F.col("y") - F.col("lat"), 2)) * 100
    return rounded(out.join(pts, "event_id").select("event_id", moved.alias("moved_e2")))


# ---- trajectories ------------------------------------------------------------------------------------

cte(
    "passes",
    """SELECT d.event_id, d.ts, d.speed_kmh, d.category, d.plate, d.gantry, d.lane, g.km, g.carriageway, g.seq, g.axis FROM (
SELECT *, row_number() OVER (PARTITION BY plate, gantry, ts ORDER BY speed_kmh, lane, event_id) AS rn FROM detections
WHERE speed_kmh BETWEEN 0 AND 200) d JOIN gantries g ON d.gantry = g.gantry WHERE rn = 1""",
    "detections gantries",
)
cte(
    "traj",
    """SELECT *, CAST(sum(CASE WHEN brk THEN 1 ELSE 0 END) OVER (PARTITION BY plate ORDER BY ts, gantry) AS BIGINT) AS trip_no FROM (
SELECT *, dt IS NULL OR dt > 3600 OR abs(dkm) > 50 OR coalesce(CASE WHEN dt > 0 THEN abs(dkm) / dt * 3600 END NOT BETWEEN 5 AND 160, false)
OR (dt = 0 AND abs(dkm) > 0) OR coalesce(sg <> psg AND sg <> 0 AND psg <> 0, false) AS brk FROM (
SELECT *, lag(sg) OVER w AS psg FROM (
SELECT *, date_diff('microsecond', lag(ts) OVER w, ts) / 1000000.0::DOUBLE AS dt, km - lag(km) OVER w AS dkm,
sign(coalesce(km - lag(km) OVER w, 0)) AS sg, lag(ts) OVER w AS pts, lag(speed_kmh) OVER w AS pv, lag(gantry) OVER w AS pg,
lag(lane) OVER w AS pl, lag(km) OVER w AS pkm FROM passes WINDOW w AS (PARTITION BY plate ORDER BY ts, gantry)) a
WINDOW w AS (PARTITION BY plate ORDER BY ts, gantry)) b) c""",
    "passes",
)
cte(
    "segs",
    """SELECT plate, concat(plate, '_', CAST(trip_no AS VARCHAR)) AS trip_id, concat(pg, '→', gantry) AS segment_id, pg AS start_gantry,
gantry AS end_gantry, pts AS start_time, ts AS end_time, dt AS delta_t_s, dt / 60 AS travel_time_min, dkm AS delta_km, abs(dkm) AS distance_km,
abs(dkm) / dt * 3600 AS avg_speed_kmh, speed_kmh - pv AS speed_change_kmh,
CASE WHEN abs(dkm) > 0 THEN (pow(speed_kmh / 3.6e0, 2) - pow(pv / 3.6e0, 2)) / (2 * abs(dkm) * 1000) END AS accel_m_s2,
pl AS start_lane, lane AS end_lane, CAST(pl <> lane AS INT) AS lane_change, pkm AS start_km, km AS end_km, carriageway, category
FROM traj WHERE NOT brk AND dt > 0""",
    "traj",
)


def passes(spark, sf):
    return clean.trajectory_input(view(spark, sf, "detections"), gantries(spark, sf))


def traj(spark, sf):
    return trajectory.trajectories(passes(spark, sf))


def segs(spark, sf):
    return trajectory.segments(traj(spark, sf))


def profiles(spark, sf):
    """Vehicle profiles; the passes are cleaned once for the speeds and the segments."""
    kept = durable(passes(spark, sf))
    return trajectory.vehicle_profiles(kept, trajectory.segments(trajectory.trajectories(kept)))


@query("CL04_trajectory_input", "SELECT event_id, plate, gantry, ts, speed_kmh, km, seq FROM passes", "passes")
def _(spark, sf):
    return passes(spark, sf).select("event_id", "plate", "gantry", "ts", "speed_kmh", "km", "seq")


@query(
    "JN01_catalogue_join",
    "SELECT event_id, d.gantry, km, axis, carriageway, seq FROM detections d JOIN gantries g ON d.gantry = g.gantry",
    "detections gantries",
)
def _(spark, sf):
    return clean.attach_posts(view(spark, sf, "detections").select("event_id", "gantry"), gantries(spark, sf))


@query(
    "WN04_trajectories",
    """SELECT event_id, plate, ts, r4(dt) AS delta_t_s, r4(dkm) AS delta_km, brk AS trip_break, trip_no,
    concat(plate, '_', CAST(trip_no AS VARCHAR)) AS trip_id FROM traj""",
    "traj",
)
def _(spark, sf):
    out = traj(spark, sf)
    return rounded(out.select("event_id", "plate", "ts", "delta_t_s", "delta_km", "trip_break", "trip_no", "trip_id"))


_SEG = ["delta_t_s", "travel_time_min", "delta_km", "distance_km", "avg_speed_kmh", "speed_change_kmh", "accel_m_s2", "start_km", "end_km"]


@query("WN05_segments", f"SELECT * REPLACE ({', '.join(f'r4({c}) AS {c}' for c in _SEG)}) FROM segs", "segs")
def _(spark, sf):
    return rounded(segs(spark, sf))


cte(
    "hw",
    """SELECT event_id, plate, gantry, lane, ts, speed_kmh, date_diff('microsecond', lag(ts) OVER w, ts) / 1000000.0::DOUBLE AS headway_s
FROM passes WINDOW w AS (PARTITION BY gantry, lane ORDER BY ts, plate, event_id)""",
    "passes",
)


@query(
    "WN06_headways",
    """SELECT event_id, plate, gantry, lane, ts, r4(speed_kmh) AS speed_kmh, r4(headway_s) AS headway_s,
    r4(headway_s * speed_kmh / 3.6e0) AS headway_m FROM hw WHERE headway_s IS NOT NULL""",
    "hw",
)
def _(spark, sf):
    return rounded(trajectory.headways(passes(spark, sf)))


@query(
    "JN12_previous_vehicle",
    """SELECT event_id, lag(plate) OVER w AS prev_plate, lag(ts) OVER w AS prev_ts FROM detections
    WINDOW w AS (PARTITION BY gantry, lane ORDER BY ts, plate, event_id)""",
    "detections",
)
def _(spark, sf):
    from tollspan.skew import previous_row, time_bucket_id

    rows = view(spark, sf, "detections").withColumn("_bucket", time_bucket_id("ts", 600))
    out = previous_row(rows, ["gantry", "lane"], ["ts", "plate", "event_id"], ["plate", "ts"])
    return out.select("event_id", "prev_plate", "prev_ts")


@query(
    "AG17_macro_metrics",
    """SELECT start_gantry, end_gantry, time_bucket(INTERVAL 15 minute, start_time) AS window_start, count(*) AS vehicle_count,
    r4(avg(avg_speed_kmh)) AS mean_speed_kmh, r4(stddev_samp(avg_speed_kmh)) AS std_speed_kmh,
    r4(quantile_cont(avg_speed_kmh, 0.05)) AS p05_speed_kmh, r4(quantile_cont(avg_speed_kmh, 0.5)) AS p50_speed_kmh,
    r4(quantile_cont(avg_speed_kmh, 0.95)) AS p95_speed_kmh, r4(avg(travel_time_min)) AS mean_travel_time_min,
    r4(quantile_cont(travel_time_min, 0.95)) AS p95_travel_time_min,
    r4(CASE WHEN avg(avg_speed_kmh) > 0 THEN count(*) * 4e0 / avg(avg_speed_kmh) END) AS density_veh_per_km FROM segs GROUP BY 1, 2, 3""",
    "segs",
)
def _(spark, sf):
    return rounded(trajectory.macro_metrics(segs(spark, sf)))


cte(
    "profiles",
    """SELECT concat('vt_', p.plate) AS profile_id, p.plate, p.vehicle_class, CASE p.vehicle_class WHEN 2 THEN 'bus' WHEN 3 THEN 'truck' WHEN 4 THEN 'motorcycle' ELSE 'car' END AS template,
p.v AS max_speed_kmh, coalesce(s.up, CASE p.vehicle_class WHEN 2 THEN 0.5 WHEN 3 THEN 0.4 WHEN 4 THEN 1.0 ELSE 0.8 END) AS accel,
coalesce(s.down, CASE p.vehicle_class WHEN 2 THEN 4.0 WHEN 3 THEN 4.0 WHEN 4 THEN 5.0 ELSE 4.5 END) AS decel,
least(1.2, 0.5 + 0.4 * coalesce(s.rate, 0)) AS sigma FROM (
SELECT plate, quantile_cont(speed_kmh, 0.95) AS v, CAST(min(category) FILTER (n = mx) AS INT) AS vehicle_class FROM (
SELECT plate, speed_kmh, category, n, max(n) OVER (PARTITION BY plate) AS mx FROM (SELECT *, count(*) OVER (PARTITION BY plate, category) AS n FROM passes) a) b GROUP BY 1) p
LEFT JOIN (SELECT plate, quantile_cont(accel_m_s2, 0.9) FILTER (accel_m_s2 > 0) AS up, quantile_cont(abs(accel_m_s2), 0.9) FILTER (accel_m_s2 < 0) AS down,
avg(lane_change) AS rate FROM segs GROUP BY 1) s ON p.plate = s.plate""",
    "passes segs",
)


@query(
    "AG18_vehicle_profiles",
    """SELECT profile_id, plate, vehicle_class, template, r4(max_speed_kmh) AS max_speed_kmh, r4(accel) AS accel, r4(decel) AS decel, r4(sigma) AS sigma FROM profiles""",
    "profiles",
)
def _(spark, sf):
    return rounded(profiles(spark, sf).drop("length", "min_gap", "v_class"))


cte(
    "trips",
    """SELECT * FROM (SELECT plate, concat(plate, '_', CAST(trip_no AS VARCHAR)) AS trip_id, arg_min(category, ts) AS category, count(*) AS n,
bool_and(edge_id IS NOT NULL) AS known, date_diff('microsecond', (SELECT min(ts) FROM traj), min(ts)) / 1000000.0::DOUBLE AS depart_s,
arg_min(edge_id, ts) AS from_edge, arg_max(edge_id, ts) AS to_edge, list(edge_id ORDER BY ts) AS es,
CAST(greatest(arg_min(lane, ts) - 1, 0) AS VARCHAR) AS depart_lane, arg_min(pos_m, ts) AS depart_pos, arg_min(speed_kmh, ts) / 3.6e0 AS depart_speed
FROM (SELECT t.*, g.edge_id, g.pos_m FROM traj t LEFT JOIN gantries g ON t.gantry = g.gantry) x GROUP BY 1, 2) q WHERE n >= 2 AND known""",
    "traj gantries",
)


def trip_table(spark, sf):
    return trajectory.trips(traj(spark, sf), gantries(spark, sf))


@query(
    "TR02_trips",
    """SELECT trip_id, plate, category, r4(depart_s) AS depart_s, from_edge, to_edge, coalesce(array_to_string(es[2:len(es) - 1], ','), '') AS via,
    depart_lane, r4(depart_pos) AS depart_pos, r4(depart_speed) AS depart_speed FROM trips""",
    "trips",
)
def _(spark, sf):
    out = trip_table(spark, sf).withColumn("via", F.array_join("via_edges", ",")).drop("via_edges")
    return rounded(out)


@query(
    "JN14_mapped_trips",
    "SELECT trip_id, n AS n_passes FROM trips",
    "trips",
)
def _(spark, sf):
    return trip_table(spark, sf).select("trip_id", (F.size("via_edges") + 2).cast("bigint").alias("n_passes"))


@query(
    "TR03_trip_types",
    """SELECT trip_id, coalesce(p.profile_id, CASE t.category WHEN 2 THEN 'bus' WHEN 3 THEN 'truck' WHEN 4 THEN 'motorcycle' ELSE 'car' END) AS vehicle_type
    FROM trips t LEFT JOIN profiles p ON t.plate = p.plate""",
    "trips profiles",
)
def _(spark, sf):
    return trajectory.trips_with_types(trip_table(spark, sf), profiles(spark, sf)).select("trip_id", "vehicle_type")


@query(
    "AG19_departures",
    "SELECT count(*) AS n_trips, r4(min(depart_s)) AS first_depart_s, r4(max(depart_s)) AS last_depart_s FROM trips",
    "trips",
)
def _(spark, sf):
    return rounded(trajectory.departure_summary(trip_table(spark, sf)))


@query(
    "TR04_run_summary",
    """SELECT 'passes' AS table_name, (SELECT count(*) FROM passes) AS n_rows UNION ALL SELECT 'trajectories', (SELECT count(*) FROM traj)
    UNION ALL SELECT 'segments', (SELECT count(*) FROM segs) UNION ALL SELECT 'headways', (SELECT count(*) FROM hw WHERE headway_s IS NOT NULL)
    UNION ALL SELECT 'macro', (SELECT count(*) FROM (SELECT DISTINCT start_gantry, end_gantry, time_bucket(INTERVAL 15 minute, start_time) FROM segs) q)
    UNION ALL SELECT 'trips', (SELECT count(*) FROM traj WHERE brk)""",
    "passes traj segs hw",
)
def _(spark, sf):
    return trajectory.run_summary(trajectory.trajectory_bundle(passes(spark, sf)))


@query(
    "TR01_trajectory_bundle",
    """SELECT s.start_gantry, s.end_gantry, count(*) AS n_segments, r4(avg(s.avg_speed_kmh)) AS mean_speed_kmh, r4(avg(h.headway_s)) AS mean_headway_s
    FROM segs s LEFT JOIN hw h ON s.plate = h.plate AND s.end_gantry = h.gantry AND s.end_time = h.ts GROUP BY 1, 2""",
    "segs hw",
)
def _(spark, sf):
    b = trajectory.trajectory_bundle(passes(spark, sf))
    h = b["headways"].select("plate", F.col("gantry").alias("end_gantry"), F.col("ts").alias("end_time"), "headway_s")
    out = b["segments"].join(h, ["plate", "end_gantry", "end_time"], "left")
    return rounded(
        out.groupBy("start_gantry", "end_gantry").agg(
            F.count(F.lit(1)).alias("n_segments"),
            F.avg("avg_speed_kmh").alias("mean_speed_kmh"),
            F.avg("headway_s").alias("mean_headway_s"),
        )
    )
