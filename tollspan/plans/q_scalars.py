"""Queries: scalar functions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tollspan.functions import geo
from tollspan.functions import scalars as S
from tollspan.plans.registry import cte, query, rounded
from tollspan.plans.views import view

NUM = r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$"


def _dec(c: str) -> str:
    t = f"replace(trim({c}), ',', '.')"
    return f"CASE WHEN regexp_full_match({t}, '{NUM[1:-1]}') THEN try_cast({t} AS DOUBLE) END"


@query(
    "FN01_plate_normalise",
    """SELECT event_id, CASE WHEN upper(trim(plate_txt)) IN ('', 'NAN', 'NULL', 'NONE') THEN NULL
    ELSE upper(trim(plate_txt)) END AS plate FROM raw_detections""",
    "raw_detections",
)
def _(spark, sf):
    return view(spark, sf, "raw_detections").select("event_id", S.normalise_plate(F.col("plate_txt")).alias("plate"))


cte(
    "fn_gantry",
    f"""SELECT event_id, upper(trim(gantry_txt)) AS t, {_dec('upper(gantry_txt)')} AS n FROM raw_detections""",
    "raw_detections",
)


@query(
    "FN02_gantry_normalise",
    """SELECT event_id, CASE WHEN t IN ('', 'NAN', 'NULL', 'NONE') THEN NULL WHEN n IS NULL THEN t
    WHEN n = floor(n) THEN CAST(CAST(n AS BIGINT) AS VARCHAR) ELSE CAST(n AS VARCHAR) END AS gantry FROM fn_gantry""",
    "fn_gantry",
)
def _(spark, sf):
    return view(spark, sf, "raw_detections").select("event_id", S.normalise_gantry(F.col("gantry_txt")).alias("gantry"))


@query(
    "FN03_clean_text",
    "SELECT event_id, nullif(trim(lane_txt), '') AS lane, nullif(trim(ts_txt), '') AS ts_txt FROM raw_detections",
    "raw_detections",
)
def _(spark, sf):
    return view(spark, sf, "raw_detections").select(
        "event_id", S.clean_text(F.col("lane_txt")).alias("lane"), S.clean_text(F.col("ts_txt")).alias("ts_txt")
    )


@query(
    "FN04_decimal_comma",
    f"SELECT event_id, {_dec('speed_txt')} AS speed_kmh FROM raw_detections",
    "raw_detections",
)
def _(spark, sf):
    return view(spark, sf, "raw_detections").select("event_id", S.parse_decimal(F.col("speed_txt")).alias("speed_kmh"))


DUCK_TIMES = [
    "%d/%m/%Y %H:%M:%S", "%d-%m-%Y %H:%M:%S", "%Y-%m-%d %H:%M:%S", "%Y/%m/%d %H:%M:%S", "%Y-%m-%dT%H:%M:%SZ",
    "%Y-%m-%dT%H:%M:%S.%fZ", "%d/%m/%Y %H:%M", "%Y-%m-%d %H:%M",
]
_TIME = (
    "coalesce("
    + ", ".join(f"try_strptime(trim(ts_txt), '{f}')" for f in DUCK_TIMES)
    + ", make_timestamp(CAST(epoch(try_strptime(trim(ts_txt), '%Y-%m-%dT%H:%M:%S%z')) * 1000000 AS BIGINT)))"
)


@query("FN05_parse_timestamp", f"SELECT event_id, {_TIME} AS ts FROM raw_detections", "raw_detections")
def _(spark, sf):
    return view(spark, sf, "raw_detections").select(
        "event_id", S.parse_detection_time(S.clean_text(F.col("ts_txt"))).alias("ts")
    )


@query(
    "FN06_event_time",
    """SELECT event_id, try_strptime(concat(fecha_inicio, ' ', hora_inicio), '%d/%m/%Y %H:%M:%S') AS event_time
    FROM accident_log""",
    "accident_log",
)
def _(spark, sf):
    return view(spark, sf, "accident_log").select(
        "event_id", S.parse_event_time(F.col("fecha_inicio"), F.col("hora_inicio")).alias("event_time")
    )


@query(
    "FN07_interval_floor",
    """SELECT l_orderkey, l_linenumber, time_bucket(INTERVAL 15 minute, l_shipdate) AS slot_15,
    time_bucket(INTERVAL 5 minute, ts) AS slot_5, event_id
    FROM lineitem JOIN events ON l_orderkey = event_id""",
)
def _(spark, sf):
    li = S.with_slot(view(spark, sf, "lineitem"), "l_shipdate", 15, "slot_15")
    ev = S.with_slot(view(spark, sf, "events"), "ts", 5, "slot_5")
    return li.join(ev, li.l_orderkey == ev.event_id).select(
        "l_orderkey", "l_linenumber", "slot_15", "slot_5", "event_id"
    )


@query(
    "FN08_slug",
    r"""SELECT doc_id, CASE WHEN s = '' THEN 'unknown' ELSE s END AS source_slug, label_slug FROM (
    SELECT doc_id, regexp_replace(regexp_replace(lower(trim(source)), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS s,
    CASE WHEN doc_id % 6 = 0 THEN 'neg_1' ELSE CAST(doc_id % 6 AS VARCHAR) END AS label_slug FROM documents) q""",
)
def _(spark, sf):
    label = F.when(F.col("doc_id") % 6 == 0, F.lit(-1)).otherwise(F.col("doc_id") % 6)
    return view(spark, sf, "documents").select(
        "doc_id", S.slug(F.col("source")).alias("source_slug"), S.label_slug(label).alias("label_slug")
    )


@query(
    "FN09_fold_key",
    """SELECT doc_id, regexp_replace(translate(lower(text), 'áàäâãéèëêíìïîóòöôõúùüûñç', 'aaaaaeeeeiiiiooooouuuunc'), '[^a-z0-9]', '', 'g')
    AS folded FROM documents""",
)
def _(spark, sf):
    return view(spark, sf, "documents").select("doc_id", S.fold_key(F.col("text")).alias("folded"))


@query(
    "FN10_class_remap",
    """SELECT event_id, CASE c WHEN 1 THEN 'Light' WHEN 2 THEN 'Heavy' WHEN 3 THEN 'Heavy' WHEN 4 THEN 'Motorcycles' END
    AS class_label FROM (SELECT event_id, event_id % 6 AS c FROM detections) q WHERE c BETWEEN 1 AND 4""",
    "detections",
)
def _(spark, sf):
    label = S.category_label((F.col("event_id") % 6).cast("int"))
    return view(spark, sf, "detections").select("event_id", label.alias("class_label")).dropna()


@query(
    "FN11_carriageway",
    """SELECT event_id, CASE lower(trim(calzada)) WHEN 'oriente' THEN 'Oriente' WHEN 'poniente' THEN 'Poniente'
    WHEN 'ambas' THEN 'Ambas' END AS carriageway FROM accident_log""",
    "accident_log",
)
def _(spark, sf):
    return view(spark, sf, "accident_log").select("event_id", S.carriageway(F.col("calzada")).alias("carriageway"))


@query(
    "FN12_subtype_strip",
    r"SELECT event_id, regexp_replace(subtipo, '^AC-0[1-6] -\s*', '') AS subtype FROM accident_log",
    "accident_log",
)
def _(spark, sf):
    return view(spark, sf, "accident_log").select("event_id", S.strip_subtype(F.col("subtipo")).alias("subtype"))


cte(
    "fn_span",
    """SELECT event_id, try_strptime(concat(fecha_inicio, ' ', hora_inicio), '%d/%m/%Y %H:%M:%S') AS t0,
    try_strptime(concat(fecha_fin, ' ', hora_fin), '%d/%m/%Y %H:%M:%S') AS t1 FROM accident_log""",
    "accident_log",
)


@query(
    "FN13_duration_minutes",
    "SELECT event_id, round_even(date_diff('microsecond', t0, t1) / 60000000.0::DOUBLE, 0) AS minutes FROM fn_span",
    "fn_span",
)
def _(spark, sf):
    df = view(spark, sf, "accident_log").select(
        "event_id",
        S.parse_event_time(F.col("fecha_inicio"), F.col("hora_inicio")).alias("t0"),
        S.parse_event_time(F.col("fecha_fin"), F.col("hora_fin")).alias("t1"),
    )
    return df.select("event_id", S.minutes_between("t0", "t1").alias("minutes"))


@query(
    "FN14_severity",
    """SELECT event_id, CASE WHEN coalesce(try_cast("7" AS DOUBLE), 0) > 0 THEN '1' ELSE '0' END AS severity,
    'Na' AS severity_without_columns FROM accident_log""",
    "accident_log",
)
def _(spark, sf):
    log = view(spark, sf, "accident_log")
    return log.select(
        "event_id", S.severity(log).alias("severity"), S.severity(log.drop("3")).alias("severity_without_columns")
    )


@query(
    "FN15_calendar_keys",
    """SELECT event_id, CAST(ts AS DATE) AS day, CAST(extract(isoyear FROM ts) * 100 + extract(week FROM ts) AS INT) AS iso_week,
    strftime(ts, '%Y-%m') AS month FROM detections_long""",
    "detections_long",
)
def _(spark, sf):
    return view(spark, sf, "detections_long").select(
        "event_id", F.to_date("ts").alias("day"), S.iso_week(F.col("ts")).alias("iso_week"),
        S.month_key(F.col("ts")).alias("month"),
    )


@query(
    "FN16_km_fraction",
    """SELECT event_id, r4(CASE WHEN a IS NULL OR b IS NULL THEN NULL WHEN abs(a - b) <= 1e-8 + 1e-5 * abs(b) THEN 0
    ELSE least(greatest((km - a) / (b - a), 0), 1) END) AS fraction FROM (
    SELECT event_id, speed_kmh / 10 AS km, CAST(category AS DOUBLE) AS a,
    CASE WHEN event_id % 9 = 0 THEN NULL WHEN event_id % 9 = 1 THEN CAST(category AS DOUBLE) ELSE lane * 4.5e0 END AS b
    FROM detections) q""",
    "detections",
)
def _(spark, sf):
    m = F.col("event_id") % 9
    a = F.col("category").cast("double")
    b = F.when(m == 0, F.lit(None)).when(m == 1, a).otherwise(F.col("lane") * 4.5)
    return rounded(
        view(spark, sf, "detections").select(
            "event_id", geo.km_fraction(F.col("speed_kmh") / 10, a, b).alias("fraction")
        )
    )


def slerp_sql(lat1, lon1, lat2, lon2, f, which):
    h = (
        f"(pow(sin((radians({lat2}) - radians({lat1})) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) * "
        f"pow(sin((radians({lon2}) - radians({lon1})) / 2), 2))"
    )
    d = f"(2 * atan2(sqrt({h}), sqrt(1 - {h})))"
    wa, wb = f"(sin((1 - {f}) * {d}) / sin({d}))", f"(sin({f} * {d}) / sin({d}))"
    x = f"({wa} * cos(radians({lat1})) * cos(radians({lon1})) + {wb} * cos(radians({lat2})) * cos(radians({lon2})))"
    y = f"({wa} * cos(radians({lat1})) * sin(radians({lon1})) + {wb} * cos(radians({lat2})) * sin(radians({lon2})))"
    z = f"({wa} * sin(radians({lat1})) + {wb} * sin(radians({lat2})))"
    mid = f"degrees(atan2({z}, sqrt({x} * {x} + {y} * {y})))" if which == "lat" else f"degrees(atan2({y}, {x}))"
    first, last = (lat1, lat2) if which == "lat" else (lon1, lon2)
    return f"CASE WHEN {f} <= 0 OR abs({d}) <= 1e-8 THEN {first} WHEN {f} >= 1 THEN {last} ELSE {mid} END"


@query(
    "FN17_great_circle",
    f"""SELECT event_id, r4({slerp_sql('a', 'b', 'c', 'd', 'f', 'lat')}) AS lat,
    r4({slerp_sql('a', 'b', 'c', 'd', 'f', 'lon')}) AS lon FROM (
    SELECT event_id, -33.4 + lane * 0.1e0 AS a, -70.6e0 AS b, -33.4 + category * 0.2e0 AS c,
    CASE WHEN event_id % 5 = 0 THEN -70.6e0 ELSE -69.9e0 END AS d, (event_id % 13 - 1) / 10e0 AS f FROM detections) q""",
    "detections",
)
def _(spark, sf):
    lat, lon = geo.great_circle_point(
        F.lit(-33.4) + F.col("lane") * 0.1,
        F.lit(-70.6),
        F.lit(-33.4) + F.col("category") * 0.2,
        F.when(F.col("event_id") % 5 == 0, F.lit(-70.6)).otherwise(F.lit(-69.9)),
        (F.col("event_id") % 13 - 1) / 10.0,
    )
    return rounded(view(spark, sf, "detections").select("event_id", lat.alias("lat"), lon.alias("lon")))


@query(
    "FN18_project_on_segment",
    """SELECT event_id, r4(ax + t * dx) AS x, r4(ay + t * dy) AS y FROM (
    SELECT *, CASE WHEN dx * dx + dy * dy = 0 THEN 0 ELSE
      least(greatest(((px - ax) * dx + (py - ay) * dy) / (dx * dx + dy * dy), 0), 1) END AS t FROM (
    SELECT event_id, speed_kmh / 20 AS px, CAST(lane AS DOUBLE) AS py, 1e0 AS ax, CAST(lane AS DOUBLE) AS ay,
    category * 2e0 - 2 AS dx, CAST((category - 1) * (event_id % 3) AS DOUBLE) AS dy FROM detections) q) r""",
    "detections",
)
def _(spark, sf):
    lane = F.col("lane").cast("double")
    bx = F.lit(1.0) + F.col("category") * 2.0 - 2
    by = lane + ((F.col("category") - 1) * (F.col("event_id") % 3)).cast("double")
    x, y = geo.project_on_segment(F.col("speed_kmh") / 20, lane, F.lit(1.0), lane, bx, by)
    return rounded(view(spark, sf, "detections").select("event_id", x.alias("x"), y.alias("y")))


@query(
    "FN19_acceleration",
    """SELECT event_id, r4(CASE WHEN km > 0 THEN (pow(v1 / 3.6e0, 2) - pow(v0 / 3.6e0, 2)) / (2 * km * 1000) END) AS accel_m_s2
    FROM (SELECT event_id, speed_kmh AS v1, 50e0 + lane * 10 AS v0, (event_id % 4) * 1.5e0 AS km FROM detections) q""",
    "detections",
)
def _(spark, sf):
    a = geo.acceleration(F.lit(50.0) + F.col("lane") * 10, F.col("speed_kmh"), (F.col("event_id") % 4) * 1.5)
    return rounded(view(spark, sf, "detections").select("event_id", a.alias("accel_m_s2")))


@query(
    "FN20_density",
    """SELECT event_id, r4(CASE WHEN v > 0 THEN f / v ELSE 0 END) AS density_feature,
    r4(CASE WHEN v > 0 THEN f / v END) AS density_macro FROM (
    SELECT event_id, lane * 12e0 AS f, CASE WHEN event_id % 11 = 0 THEN 0e0 ELSE speed_kmh END AS v FROM detections) q""",
    "detections",
)
def _(spark, sf):
    f, v = F.col("lane") * 12.0, F.when(F.col("event_id") % 11 == 0, F.lit(0.0)).otherwise(F.col("speed_kmh"))
    return rounded(
        view(spark, sf, "detections").select(
            "event_id", S.density(f, v).alias("density_feature"), S.density(f, v, None).alias("density_macro")
        )
    )


@query(
    "FN21_entropy",
    """SELECT plate, r4(-sum(CASE WHEN p > 0 THEN p * ln(p) ELSE 0 END)) AS entropy,
    r4(-sum(p * ln(p + 1e-12))) AS soft_entropy FROM (
    SELECT plate, g.l, sum(CASE WHEN lane = g.l THEN 1 ELSE 0 END) / count(*) AS p
    FROM detections, (VALUES (1), (2), (3), (4)) g(l) GROUP BY 1, 2) q GROUP BY 1""",
    "detections",
)
def _(spark, sf):
    per = (
        view(spark, sf, "detections")
        .groupBy("plate")
        .agg(*[(F.count_if(F.col("lane") == k) / F.count(F.lit(1))).alias(f"p{k}") for k in (1, 2, 3, 4)])
    )
    hard = sum((S.entropy_term(F.col(f"p{k}")) for k in (1, 2, 3, 4)), F.lit(0.0))
    soft = S.soft_entropy(F.array("p1", "p2", "p3", "p4"))
    return rounded(per.select("plate", hard.alias("entropy"), soft.alias("soft_entropy")))


_T = "CASE c WHEN 2 THEN 'bus' WHEN 3 THEN 'truck' WHEN 4 THEN 'motorcycle' ELSE 'car' END"


@query(
    "FN22_vehicle_template",
    """SELECT event_id, t AS template, CASE t WHEN 'bus' THEN 0.5e0 WHEN 'truck' THEN 0.4e0 WHEN 'motorcycle' THEN 1e0
    ELSE 0.8e0 END AS accel, CASE t WHEN 'bus' THEN 90e0 WHEN 'truck' THEN 120e0 ELSE 180e0 END AS max_speed FROM (
    SELECT event_id, """
    + _T
    + """ AS t FROM (SELECT event_id, CASE WHEN event_id % 8 = 0 THEN NULL ELSE event_id % 8 END AS c FROM detections) q) r""",
    "detections",
)
def _(spark, sf):
    c = F.nullif(F.col("event_id") % 8, F.lit(0))
    return view(spark, sf, "detections").select(
        "event_id", S.template_name(c).alias("template"), S.template_value(c, "accel").alias("accel"),
        S.template_value(c, "max_speed").alias("max_speed"),
    )


@query(
    "FN23_safe_id",
    r"""SELECT doc_id, substr(CASE WHEN regexp_matches(t, '^[0-9]') THEN concat('veh_', t) ELSE t END, 1, 60) AS id FROM (
    SELECT doc_id, CASE WHEN s = '' THEN 'veh' ELSE s END AS t FROM (
    SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, '^\s+|\s+$', '', 'g'), '[^A-Za-z0-9_-]+', '_', 'g'),
    '^_+|_+$', '', 'g') AS s FROM documents) q) r""",
)
def _(spark, sf):
    return view(spark, sf, "documents").select("doc_id", S.safe_id(F.col("text")).alias("id"))


@query(
    "FN24_feature_signature",
    """SELECT plate, md5(string_agg(g, '|' ORDER BY g)) AS signature FROM (
    SELECT DISTINCT plate, concat('flow_', gantry) AS g FROM detections) q GROUP BY 1""",
    "detections",
)
def _(spark, sf):
    names = F.collect_set(F.concat(F.lit("flow_"), "gantry"))
    return view(spark, sf, "detections").groupBy("plate").agg(S.feature_signature(names).alias("signature"))


@query(
    "FN25_json_payload",
    """SELECT run_id, CASE WHEN json_valid(payload) THEN json_extract_string(payload, '$.section') ELSE payload END AS section,
    CAST(CASE WHEN json_valid(payload) THEN json_extract_string(payload, '$.far') END AS DOUBLE) AS far FROM runs""",
    "runs",
)
def _(spark, sf):
    return view(spark, sf, "runs").select(
        "run_id",
        F.coalesce(F.get_json_object("payload", "$.section"), F.col("payload")).alias("section"),
        S.json_number(F.col("payload"), "far").alias("far"),
    )


# Written out, not taken from the library, so that a wrong limit there shows.
_LIMITS = """WHEN 1 THEN 5.5e0 WHEN 2 THEN 15e0 WHEN 3 THEN 13e0 WHEN 4 THEN 14e0 WHEN 5 THEN 10.5e0 WHEN 6 THEN 4.5e0 WHEN 7 THEN 13.5e0
    WHEN 8 THEN 13.5e0 WHEN 9 THEN 15e0 WHEN 10 THEN 14.5e0 WHEN 11 THEN 11.5e0 WHEN 12 THEN 15e0 WHEN 13 THEN 11.5e0 WHEN 14 THEN 4.5e0
    WHEN 15 THEN 14e0 WHEN 16 THEN 13e0 WHEN 17 THEN 9e0 WHEN 18 THEN 8.5e0 WHEN 19 THEN 12e0 WHEN 20 THEN 14e0 WHEN 21 THEN 10.5e0
    WHEN 22 THEN 9.5e0 WHEN 23 THEN 13e0 WHEN 24 THEN 9.5e0 WHEN 25 THEN 15e0 WHEN 26 THEN 12e0 WHEN 28 THEN 7.5e0 WHEN 29 THEN 14e0
    WHEN 30 THEN 15e0 WHEN 31 THEN 10e0 WHEN 32 THEN 8e0"""


@query(
    "FN26_ttc_limit",
    f"""SELECT event_id, CASE WHEN n = floor(n) THEN CASE CAST(n AS INT) {_LIMITS} END END AS limit_s FROM (
    SELECT event_id, {_dec('g')} AS n FROM (SELECT event_id, CASE WHEN event_id % 6 = 0 THEN concat(CAST(event_id % 40 AS VARCHAR), '.5')
    ELSE CAST(event_id % 40 AS VARCHAR) END AS g FROM detections) q) r""",
    "detections",
)
def _(spark, sf):
    n = (F.col("event_id") % 40).cast("string")
    code = F.when(F.col("event_id") % 6 == 0, F.concat(n, F.lit(".5"))).otherwise(n)
    return view(spark, sf, "detections").select("event_id", S.ttc_limit(code).alias("limit_s"))


@query(
    "FN27_split_lat_lon",
    f"""SELECT gantry, {_dec("split_part(t, ',', 1)")} AS lat, {_dec("nullif(split_part(t, ',', 2), '')")} AS lon FROM (
    SELECT gantry, CASE WHEN seq % 7 = 3 THEN 'none' WHEN seq % 7 = 4 THEN concat(CAST(lat AS VARCHAR), ', x')
    ELSE concat(CAST(lat AS VARCHAR), ', ', CAST(lon AS VARCHAR)) END AS t FROM road_posts) q""",
    "road_posts",
)
def _(spark, sf):
    text = (
        F.when(F.col("seq") % 7 == 3, F.lit("none"))
        .when(F.col("seq") % 7 == 4, F.concat(F.col("lat").cast("string"), F.lit(", x")))
        .otherwise(F.concat(F.col("lat").cast("string"), F.lit(", "), F.col("lon").cast("string")))
    )
    lat, lon = S.split_lat_lon(F.col("t"))
    return view(spark, sf, "road_posts").select("gantry", text.alias("t")).select(
        "gantry", lat.alias("lat"), lon.alias("lon")
    )
