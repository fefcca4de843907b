"""Small cases worked out by hand."""

from __future__ import annotations

import datetime
import itertools
import random
import re
import time

import pandas as pd
import pyarrow as pa
import pytest
from conftest import rows
from pyspark.sql import functions as F

from tollspan.functions import scalars as S
from tollspan.operators import catalog, clean, evaluate, explore, flow, geo, plate, sections, trajectory
from tollspan.plans.views import view
from tollspan.sources import ingest
from tollspan.streaming import streams

SCHEMA = "event_id bigint, t string, speed_kmh double, category int, plate string, gantry string, lane int"


def detections(spark, data):
    return spark.createDataFrame(data, SCHEMA).withColumn("ts", F.col("t").cast("timestamp_ntz")).drop("t")


def test_plate_vector_by_hand(spark):
    df = detections(
        spark,
        [
            (1, "2024-03-01 10:00:00", 80.0, 1, "AA1111", "1", 1),
            (2, "2024-03-01 10:00:10", 95.0, 1, "BB2222", "1", 1),
            (3, "2024-03-01 10:20:00", 90.0, 1, "AA1111", "2", 2),
            (4, "2024-03-02 10:00:00", 100.0, 1, "AA1111", "1", 2),
        ],
    )
    got = {r["plate"]: r for r in plate.plate_features(df, include_counts=True).collect()}
    a, b = got["AA1111"], got["BB2222"]
    assert (a["total_passes"], a["avg_speed_kmh"], a["lane_changes"], a["n_days_active"]) == (3, 90.0, 1, 2)
    assert a["lane_change_rate"] == 0.5 and b["lane_change_rate"] == 0.0
    assert (b["avg_speed_kmh"], b["avg_headway_s"], b["headway_count"]) == (95.0, 10.0, 1)
    assert b["conflict_rate"] == 0.0  # 10 s * 95 / 15 is far above the limit
    assert a["avg_headway_s"] is None
    assert b["avg_relative_speed"] == pytest.approx(95.0 / 87.5)


def test_overlap_rows_only_precede(spark):
    df = detections(
        spark,
        [(1, "2024-03-01 10:00:00", 80.0, 1, "AA1111", "1", 1), (2, "2024-03-01 10:00:05", 90.0, 1, "BB2222", "1", 1)],
    ).withColumn("overlap", F.col("event_id") == 1)
    got = plate.follow_measures(df).collect()
    assert [(r["event_id"], r["headway_s"]) for r in got] == [(2, 5.0)]


def test_flow_means_and_deltas(spark):
    df = detections(
        spark,
        [
            (1, "2024-03-01 10:00:00", 80.0, 1, "A", "1", 1),
            (2, "2024-03-01 10:01:00", 86.0, 1, "B", "1", 1),
            (3, "2024-03-01 10:02:00", 70.0, 3, "C", "1", 1),
            (4, "2024-03-01 10:20:00", 93.0, 1, "D", "1", 1),
            (5, "2024-03-01 10:20:00", 93.0, 9, "E", "1", 1),
        ],
    )
    core = flow.flow_with_deltas(df).orderBy("interval_start", "class_label")
    got = {(str(r["interval_start"]), r["class_label"]): r for r in core.collect()}
    assert len(got) == 3
    first = got[("2024-03-01 10:00:00", "Light")]
    assert (first["flow_count"], first["speed_mean"], first["flow_per_hour"], first["delta_speed"]) == (2, 83.0, 24.0, 0.0)
    assert got[("2024-03-01 10:20:00", "Light")]["delta_speed"] == 10.0
    strict = flow.flow_with_deltas(df, adjacent_minutes=5).filter("delta_speed <> 0")
    assert strict.count() == 0
    reset = flow.with_deltas(
        flow.flow_core(df).withColumn("b", F.col("interval_start")), ["gantry"], {"d": "speed_mean"}, reset_by="b"
    )
    assert {r["d"] for r in reset.filter("class_label = 'Light'").collect()} <= {0.0, 13.0}


def test_dedupe_keeps_slowest(spark):
    df = detections(
        spark,
        [(1, "2024-03-01 10:00:00", 80.0, 1, "AA1111", "1", 1), (2, "2024-03-01 10:00:00", 70.0, 2, "AA1111", "1", 1)],
    )
    assert [(r["event_id"], r["speed_kmh"], r["category"]) for r in clean.dedupe_passes(df).collect()] == [(2, 70.0, 2)]


def test_frequent_split_is_exact(spark):
    df = spark.createDataFrame([("a", 30, 6), ("b", 30, 1), ("c", 5, 9), ("d", None, 9)], "plate string, total_passes int, n_days_active int")
    often, seldom = clean.split_frequent(df)
    assert [r["plate"] for r in often.collect()] == ["a"]
    assert sorted(r["plate"] for r in seldom.collect()) == ["b", "c", "d"]


@pytest.mark.parametrize(
    ("km", "want"),
    [(1.0, ("a", "b")), (2.0, ("a", "b")), (2.5, ("b", "c")), (-1.0, (None, "a")), (9.0, ("c", None)), (None, (None, None))],
)
def test_brackets(spark, km, want):
    posts = spark.createDataFrame(
        [("a", 0.0, "Oriente", 1, "N"), ("b", 2.0, "Oriente", 2, "N"), ("c", 5.0, "Oriente", 3, "N"), ("z", 1.0, "Poniente", 1, "N")],
        "gantry string, km double, carriageway string, seq int, axis string",
    )
    ev = spark.createDataFrame([(1, km, "n", "ORIENTE "), (2, 7.0, "N", "Poniente")], "event_id bigint, km double, axis string, carriageway string")
    got = {r["event_id"]: (r["gantry_before"], r["gantry_after"]) for r in catalog.bracket_gantries(ev, posts).collect()}
    assert got[1] == want and got[2] == (None, "z")


def test_zero_gap_with_distance_ends_trip(spark):
    posts = spark.createDataFrame([("1", 0.0, "O", 1, "N"), ("2", 3.0, "O", 2, "N")], "gantry string, km double, carriageway string, seq int, axis string")
    df = detections(
        spark,
        [
            (1, "2024-03-01 10:00:00", 80.0, 1, "AA1111", "1", 1),
            (2, "2024-03-01 10:00:00", 80.0, 1, "AA1111", "2", 1),
            (3, "2024-03-01 10:03:00", 80.0, 1, "AA1111", "1", 1),
        ],
    )
    got = trajectory.trajectories(clean.trajectory_input(df, posts)).orderBy("ts", "gantry").collect()
    # both movements cover 3 km, one in no time and one back again
    assert [r["trip_break"] for r in got] == [True, True, True]


def test_threshold_edges(spark):
    one = spark.createDataFrame([(0.1, 0), (0.9, 0)], "score double, target int")
    assert evaluate.far_threshold(one).first()["threshold"] == 0.5
    assert evaluate.roc_auc(one).first()["auc"] == 0.5
    top_wrong = spark.createDataFrame([(0.9, 0), (0.5, 1), (0.1, 0)], "score double, target int")
    got = evaluate.far_threshold(top_wrong, 0.2).first()
    assert got["threshold"] is None and got["sensitivity"] == 0.0
    assert evaluate.far_threshold(top_wrong, 0.5).first()["threshold"] == 0.5


def test_densest_window_by_hand(spark):
    acc = spark.createDataFrame(
        [("1", "2", t) for t in ("2024-01-01 00:00:00", "2024-01-03 00:00:00", "2024-01-04 00:00:00", "2024-01-05 00:00:00", "2024-01-20 00:00:00")],
        "last_gantry string, next_gantry string, t string",
    ).withColumn("event_time", F.col("t").cast("timestamp_ntz"))
    span = spark.createDataFrame([("1", "2", "2024-01-01", "2024-01-31")], "gantry_last string, gantry_next string, a string, b string").select(
        "gantry_last", "gantry_next", F.col("a").cast("timestamp_ntz").alias("feature_min"), F.col("b").cast("timestamp_ntz").alias("feature_max")
    )
    got = {r["window_days"]: (str(r["window_start"]), r["n_accidents"]) for r in sections.densest_windows(acc, span, [2, 40]).collect()}
    assert got == {2.0: ("2024-01-03 00:00:00", 3)}


def test_column_resolver():
    cols = ["Fechas Inicio", "Sub-Tipo", "km."]
    assert ingest.resolve_column(cols, "fechas_inicio") == "Fechas Inicio"
    assert ingest.resolve_column(cols, "SubTipo") == "Sub-Tipo"
    assert ingest.resolve_column(cols, "Km.", ["Km"]) == "km."
    with pytest.raises(KeyError):
        ingest.resolve_column(cols, "Via")
    assert ingest.cluster_features(["cluster_share_0", "last_cluster_x", "flow_light"]) == ["cluster_share_0", "last_cluster_x"]


def test_sniffed_latin1(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("Vía;Tipo\nExprésa;Accidente\n".encode("latin-1"))
    got = ingest.read_sniffed(spark, str(tmp_path / "a.csv"))
    assert got.columns == ["Vía", "Tipo"] and got.first()["Vía"] == "Exprésa"


def test_batch_key_sums_to_whole(spark):
    from tollspan.operators import rollup

    df = view(spark, "/root/testdata/sf0.001", "detections_long")
    whole = plate.plate_features(df).select("plate", "total_passes", "lane_changes", F.round("avg_headway_s", 6))
    weeks = rollup.roll_up(rollup.features_by_batch(df, "week"), "week")
    assert rows(whole) == rows(weeks.select("plate", "total_passes", "lane_changes", F.round("avg_headway_s", 6)))


# ---- streams in several batches -------------------------------------------------------------


@pytest.fixture(scope="module")
def in_files(spark, tmp_path_factory):
    """Detections in three files of rising time, read one per batch."""
    folder = str(tmp_path_factory.mktemp("stream") / "t")
    df = view(spark, "/root/testdata/sf0.001", "detections")
    for h in range(3):
        part = df.filter((F.hour("ts") >= h * 4) & (F.hour("ts") < h * 4 + 4))
        part.coalesce(1).write.mode("append").parquet(folder)
    return folder


def stream_of(spark, folder):
    schema = spark.read.parquet(folder).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


@pytest.fixture(scope="module")
def late_files(spark, tmp_path_factory):
    """Detections in six files; every fifth row comes a file late, but inside the delay of two hours."""
    folder = str(tmp_path_factory.mktemp("late") / "t")
    df = view(spark, "/root/testdata/sf0.001", "detections").withColumn("late", (F.col("event_id") % 5 == 0).cast("int"))
    for h in range(7):
        df.filter(F.floor(F.hour("ts") / 2) + F.col("late") == h).drop("late").coalesce(1).write.mode("append").parquet(folder)
    return folder


def passed(df, hours):
    return df.filter(F.col("ts") <= df.agg(F.max("ts").alias("m")).first()["m"] - datetime.timedelta(hours=hours))


DELAY = "150 minutes"


def test_lane_changes_with_late_rows(spark, late_files):
    whole = passed(spark.read.parquet(late_files), 2.5)
    got = streams.drain(streams.lane_change_stream(stream_of(spark, late_files), delay=DELAY), "lanes")
    want = plate.plate_features(whole).select("plate", F.col("total_passes"), "lane_changes")
    assert rows(got.groupBy("plate").agg(F.sum("passes"), F.sum("lane_changes"))) == rows(want)
    assert got.count() > want.count()


def test_headways_with_late_rows(spark, late_files):
    whole = spark.read.parquet(late_files)
    got = streams.drain(streams.headway_stream(stream_of(spark, late_files), delay=DELAY), "headway")
    ids = passed(whole, 2.5).select("event_id")
    want = trajectory.headways(whole).join(ids, "event_id").select("event_id", F.round("headway_s", 6))
    assert rows(got.select("event_id", F.round("headway_s", 6))) == rows(want)


def test_trip_numbers_go_on_after_a_silence(spark, tmp_path):
    data = [(1, "2024-01-01 10:00:00", 80.0, 1, "P1", "1", 1), (2, "2024-01-20 10:00:00", 80.0, 1, "P1", "1", 1),
            (3, "2024-02-20 10:00:00", 80.0, 1, "P2", "1", 1)]
    for row in data:
        detections(spark, [row]).withColumn("km", F.lit(1.0)).coalesce(1).write.mode("append").parquet(str(tmp_path / "t"))
    got = streams.drain(streams.trip_stream(stream_of(spark, str(tmp_path / "t"))), "trips")
    assert rows(got.filter("plate = 'P1'").select("event_id", "trip_no")) == [(1, 1), (2, 2)]


def test_flow_stream_equals_batch_on_closed_windows(spark, in_files):
    whole = spark.read.parquet(in_files)
    got = streams.drain(streams.flow_stream(stream_of(spark, in_files)), "flow").select("gantry", "interval_start", "class_label", "flow_count")
    want = flow.flow_core(whole).select("gantry", "interval_start", "class_label", "flow_count")
    assert set(rows(got)) <= set(rows(want))
    assert got.count() > 0.9 * want.count()


def test_event_times_in_any_day_first_layout(spark):
    cases = {
        ("05/01/2024", "10:00:00"): "2024-01-05 10:00:00", ("5-1-24", "9:05"): "2024-01-05 09:05:00",
        ("05.01.2024", "12:30 AM"): "2024-01-05 00:30:00", ("13/01/2024", "1:02:03 pm"): "2024-01-13 13:02:03",
        ("01/13/2024", "00:00"): "2024-01-13 00:00:00", ("2024-01-05T10:11:12.25", ""): "2024-01-05 10:11:12.250000",
        ("05/01/70", ""): "1970-01-05 00:00:00", ("31/02/2024", "10:00"): None, ("soon", "10:00"): None,
    }
    df = spark.createDataFrame([(d, t) for d, t in cases], "d string, t string")
    got = {(r["d"], r["t"]): r["x"] for r in df.select("d", "t", S.parse_event_time(F.col("d"), F.col("t")).alias("x")).collect()}
    assert {k: str(v) if v else None for k, v in got.items()} == cases


def test_detection_times_do_not_depend_on_the_session_zone(spark):
    cases = {
        "2024-09-08 00:30:00": "2024-09-08 00:30:00", "05/01/2024   10:00:00": "2024-01-05 10:00:00",
        "2024-01-05T10:00:00+02:00": "2024-01-05 08:00:00", "2024-01-05T10:00:00+02": "2024-01-05 08:00:00",
        "2024-01-05T10:00:00-0330": "2024-01-05 13:30:00", "2024-01-05T10:00:00Z": "2024-01-05 10:00:00",
    }
    df = spark.createDataFrame([(t,) for t in cases], "t string")
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/Santiago")
        got = {r["t"]: str(r["x"]) for r in df.select("t", S.parse_detection_time(F.col("t")).alias("x")).collect()}
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert got == cases


def test_range_scan_skips_day_folders(spark, tmp_path):
    df = spark.sql("SELECT id AS event_id, 1 AS category, timestampadd(HOUR, id, TIMESTAMP_NTZ'2024-01-01 00:00:00') AS ts FROM range(240)")
    ingest.write_detections(df, str(tmp_path / "t"), "overwrite")
    part = ingest.range_scan(ingest.read_detections(spark, str(tmp_path / "t")), "2024-01-02 05:00:00", "2024-01-03 00:00:00")
    assert part.count() == 19
    plan = part._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan


def test_missed_alarm_rate_is_minimised():
    from tollspan.operators.study import _objective

    assert _objective({"fnr": 0.1}, "fnr") > _objective({"fnr": 0.4}, "fnr")
    assert _objective({"far": None, "sensitivity": 0.5}, "far") == 0.0005


def test_auction_equals_all_permutations():
    rng = random.Random(1)
    for n in range(1, 8):
        for _ in range(12):
            v = [[rng.choice([0, 0, rng.randrange(5), rng.randrange(1000)]) for _ in range(n)] for _ in range(n)]
            mate = explore.auction(v)
            assert sorted(mate) == list(range(n))
            best = max(sum(v[i][p[i]] for i in range(n)) for p in itertools.permutations(range(n)))
            assert sum(v[i][mate[i]] for i in range(n)) == best


def test_matching_of_uneven_clusterings(spark):
    rows = [(0, 0, 9), (0, 1, 8), (1, 0, 8), (2, 0, 1), (2, 1, 1)]
    got = explore.best_matching(spark.createDataFrame(rows, "label_a int, label_b int, n bigint"))
    # the best overlap of 0 is 0, but then 1 keeps nobody
    assert {tuple(r) for r in got.collect()} == {(0, 1, 8), (1, 0, 8), (2, None, 0)}
    flipped = explore.best_matching(spark.createDataFrame([(b, a, n) for a, b, n in rows], "label_a int, label_b int, n bigint"))
    assert {tuple(r) for r in flipped.collect()} == {(1, 0, 8), (0, 1, 8), (None, 2, 0)}
    tie = spark.createDataFrame([(a, b, 5) for a in range(3) for b in range(3)], "label_a int, label_b int, n bigint")
    assert {tuple(r) for r in explore.best_matching(tie).collect()} == {(i, i, 5) for i in range(3)}
    assert explore.best_matching(tie.limit(0)).count() == 0


@pytest.mark.parametrize("build", ["headway", "lanes", "trips"])
def test_a_finished_stream_gives_all_rows(spark, late_files, build):
    """The last ten minutes come out as well once the input is over, over several late files."""
    closing = streams.Closing(stream_of(spark, late_files).withColumn("km", (F.col("event_id") % 50).cast("double")))
    make = {"headway": streams.headway_stream, "lanes": streams.lane_change_stream, "trips": streams.trip_stream}[build]
    got = streams.drain(make(closing.rows, delay=DELAY), build, closing=closing).collect()
    rows = spark.read.parquet(late_files)
    if build == "lanes":
        assert sum(r["passes"] for r in got) == rows.count()
    elif build == "trips":
        assert sorted(r["event_id"] for r in got) == sorted(r["event_id"] for r in rows.collect())
    else:
        lanes = rows.filter("gantry IS NOT NULL AND lane IS NOT NULL").groupBy("gantry", "lane").count().collect()
        assert len(got) == sum(r["count"] - 1 for r in lanes)
    assert not any(streams.CLOSED in map(str, r) for r in got)


def test_files_of_one_folder_with_their_own_forms(spark, tmp_path):
    (tmp_path / "a b.csv").write_bytes("name;n\nGarz\u00f3n;1,5\n".encode("latin-1"))
    (tmp_path / "b.csv").write_bytes("name,n\nGarz\u00f3n,2\n\"x;y;z\",3\n".encode())
    (tmp_path / "c.csv").write_bytes("n;name;more\n4;\u00d1u\u00f1oa;m\n".encode())
    forms = {f.rsplit("/", 1)[-1]: (s, e) for f, s, e in ingest.sniffed_files(spark, str(tmp_path))}
    assert forms == {"a b.csv": (";", "ISO-8859-1"), "b.csv": (",", "UTF-8"), "c.csv": (";", "UTF-8")}
    got = ingest.read_sniffed(spark, str(tmp_path)).select("name", "n", "more")
    assert rows(got) == sorted([("Garz\u00f3n", "1,5", None), ("Garz\u00f3n", "2", None), ("x;y;z", "3", None), ("\u00d1u\u00f1oa", "4", "m")], key=repr)
    assert ingest.read_sniffed(spark, str(tmp_path), limit=2).count() == 2


def test_waiting_rows_of_a_key_are_held_as_columns():
    """Rows wait as Arrow bytes, some thirty bytes a row, and come back whole and in order."""

    class State:
        exists, get, mark = False, None, 0

        def getCurrentWatermarkMs(self):
            return self.mark

        def setTimeoutTimestamp(self, at):
            self.at = at

        def update(self, value):
            self.exists, self.get = True, value

    n = 20_000
    part = pd.DataFrame({"event_id": range(n), "plate": [f"P{i % 7}" for i in range(n)], "us": [(n - i) * 1000 for i in range(n)]})
    kind = pa.schema([("event_id", pa.int64()), ("plate", pa.string()), ("us", pa.int64())])
    state = State()
    ready, carried = streams._settled(iter([part[: n // 2], part[n // 2 :]]), state, kind, ["us", "plate"])
    assert len(ready) == 0 and carried is None and state.at == 2
    assert isinstance(state.get[1], bytes) and len(state.get[1]) < 40 * n
    state.mark = n // 2
    ready, _ = streams._settled(iter([]), state, kind, ["us", "plate"])
    assert ready["us"].to_pylist() == [(i + 1) * 1000 for i in range(n // 2)]
    state.mark = n
    ready, _ = streams._settled(iter([]), state, kind, ["us", "plate"])
    assert len(ready) == n - n // 2 and state.get[1] == b""


def test_snapping_sorts_no_pairs(spark, monkeypatch):
    """Equal to the search over all pairs, and only pairs at the least distance are sorted by segment."""
    rng = random.Random(5)
    ways = [(w, p, -33 + rng.random() * 0.1, -70 + rng.random() * 0.1) for w in range(6) for p in range(12)]
    points = [(i, -33 + rng.random() * 0.1, -70 + rng.random() * 0.1) for i in range(300)]
    points += [(300, -33.0, -73.0), (300, -33.05, -70.05), (301, -31.0, -70.0), (None, -33.02, -70.02), (302, None, -70.0)]
    segments = geo.road_segments(spark.createDataFrame(ways, "way_id bigint, point int, lat double, lon double"))
    located = spark.createDataFrame(points, "event_id bigint, lat double, lon double")
    plans, kept = [], geo.durable
    monkeypatch.setattr(geo, "durable", lambda df: (plans.append(df._jdf.queryExecution().executedPlan().toString()), kept(df))[1])
    got = {(r["event_id"], round(r["snap_d2"], 12)) for r in geo.snap_to_road(located, segments).collect()}
    lines = [tuple(r) for r in segments.select("lat", "lon", "lat2", "lon2").collect()]
    want = {}
    for key, y, x in points:
        for ay, ax, by, bx in lines if y is not None else []:
            dy, dx = by - ay, bx - ax
            t = min(max(((x - ax) * dx + (y - ay) * dy) / (dx * dx + dy * dy), 0.0), 1.0)
            d = (x - ax - t * dx) ** 2 + (y - ay - t * dy) ** 2
            want[key] = min(d, want.get(key, d))
    assert got == {(k, round(d, 12)) for k, d in want.items()}
    sorting = [p for p in plans if "SortAggregate" in p and "min(struct" in p]
    assert sorting and all("_least" in p for p in sorting)


def test_safe_id_of_long_runs(spark):
    texts = ["  7ab cd__", "__é--x__ " + "y" * 70, "w " * 29 + "ab" + " " * 9, "w " * 29 + "ab" + " " * 9 + "z", " _ ", None, "a" + "_" * 300_000 + "b",
             "w " * 30 + "_ _", "w " * 30 + "_ _-"]

    def by_hand(t):
        t = re.sub("^_+|_+$", "", re.sub("[^A-Za-z0-9_-]+", "_", t.strip())) if len(t) < 1000 else t
        t = t or "veh"
        return (f"veh_{t}" if t[0].isdigit() else t)[:60]

    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").coalesce(1)
    start = time.monotonic()
    got = [r["id"] for r in df.orderBy("i").select("i", S.safe_id(F.col("t")).alias("id")).collect()]
    assert got == [None if t is None else by_hand(t) for t in texts]
    assert time.monotonic() - start < 20  # 45 thousand million steps if a run is tried from each of its places


def test_profiles_work_out_segments_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def counted(a):
        seen.add(1)
        return a

    passes = [(f"P{i % 3}", 60.0 + i, 1 + i % 2) for i in range(30)]
    segs = [(f"P{i % 3}", (i - 15) / 10, i % 2) for i in range(30)]
    segs = spark.createDataFrame(segs, "plate string, accel_m_s2 double, lane_change int").withColumn("accel_m_s2", counted("accel_m_s2"))
    out = trajectory.vehicle_profiles(spark.createDataFrame(passes, "plate string, speed_kmh double, category int"), segs)
    assert out.count() == 3 and out.filter("accel IS NULL OR decel IS NULL").count() == 0
    assert seen.value == 30
