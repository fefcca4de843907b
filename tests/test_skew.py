"""Cut keys give exactly what plain windows give."""

from __future__ import annotations

import random

import numpy as np
import pytest
from conftest import rows
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from tollspan import skew
from tollspan.functions import scalars as S
from tollspan.operators import clean, evaluate, mixture, plate, trajectory


@pytest.fixture(scope="module")
def passes(spark):
    """Passes of which one plate and one gantry hold most, with equal times among them."""
    rng = random.Random(7)
    data = []
    for i in range(1500):
        hot = rng.random() < 0.5
        t = rng.randrange(0, 6 * 3600)
        data.append(
            (i, f"2024-01-01 {t // 3600:02d}:{t // 60 % 60:02d}:{t % 60:02d}", float(rng.randrange(200, 1300)) / 10,
             1 + i % 4, "HOT01" if hot else f"PL{rng.randrange(40):03d}", "1" if hot else str(rng.randrange(1, 5)), 1 + rng.randrange(3))
        )
    df = spark.createDataFrame(data, "event_id bigint, t string, speed_kmh double, category int, plate string, gantry string, lane int")
    return df.withColumn("ts", F.col("t").cast("timestamp_ntz")).drop("t").persist()


def test_previous_row_equals_lag(passes):
    cut = passes.withColumn("_bucket", skew.time_bucket_id("ts", 600))
    got = skew.previous_row(cut, ["gantry", "lane"], ["ts", "event_id"], ["event_id", "speed_kmh"])
    w = Window.partitionBy("gantry", "lane").orderBy("ts", "event_id")
    want = passes.select("event_id", F.lag("event_id").over(w), F.lag("speed_kmh").over(w))
    assert rows(got.select("event_id", "prev_event_id", "prev_speed_kmh")) == rows(want)


def test_running_totals_equal_window_sum(passes):
    cut = passes.withColumn("_bucket", skew.time_bucket_id("ts", 900))
    got = skew.running_totals(cut, ["plate"], [F.col("ts"), F.col("event_id")], {"s": "category"})
    w = Window.partitionBy("plate").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    assert rows(got.select("event_id", "s")) == rows(passes.select("event_id", F.sum("category").over(w)))


def test_quantiles_equal_numpy(passes):
    got = skew.exact_quantiles(passes, ["gantry"], "speed_kmh", {"a": 0.01, "b": 0.5, "c": 0.99})
    pdf = passes.toPandas()
    for r in got.collect():
        x = pdf[pdf.gantry == r["gantry"]].speed_kmh
        assert np.allclose([r["a"], r["b"], r["c"]], np.quantile(x, [0.01, 0.5, 0.99]))


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(values=st.lists(st.floats(-50, 50), min_size=1, max_size=30), p=st.floats(0, 1))
def test_quantile_of_any_list(spark, values, p):
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = skew.exact_quantiles(df, [], "v", {"q": p}).first()["q"]
    assert got == pytest.approx(float(np.quantile(values, p)), abs=1e-9)


def test_labelled_slots_equal_row_join(spark, passes):
    labels = passes.select("plate").distinct().withColumn("cluster_label", F.length("plate") % 3)
    got = mixture.labelled_slots(passes, labels, 5).groupBy("gantry", "interval_start", "cluster_label")
    want = S.with_slot(mixture.attach_labels(passes, labels), minutes=5).groupBy("gantry", "interval_start", "cluster_label")
    assert rows(got.agg(F.sum("n").cast("bigint").alias("n"))) == rows(want.agg(F.count(F.lit(1)).alias("n")))


def test_hot_plate_trajectories_equal_plain(spark, passes):
    posts = spark.createDataFrame(
        [("1", 0.0, "O", 1, "N"), ("2", 2.0, "O", 2, "N"), ("3", 5.0, "O", 3, "N"), ("4", 9.0, "O", 4, "N")],
        "gantry string, km double, carriageway string, seq int, axis string",
    )
    rows_in = clean.trajectory_input(passes, posts)
    cols = ["event_id", "trip_no", "trip_break", "delta_t_s", "prev_gantry"]
    plain = trajectory.trajectories(rows_in, bucket_s=10**8).select(*cols)
    cut = trajectory.trajectories(rows_in).select(*cols)
    assert rows(plain) == rows(cut)
    trips = trajectory.trajectories(rows_in)
    longest = trips.groupBy("trip_id").count().agg(F.max("count")).first()[0]
    assert longest <= 4  # never more passes than gantries


def test_headway_halo_equals_plain_window(passes):
    got = plate.follow_measures(passes).select("event_id", "headway_s")
    w = Window.partitionBy("gantry", "lane").orderBy("ts", "plate", "speed_kmh", "event_id")
    gap = (F.unix_timestamp(F.col("ts").cast("timestamp")) - F.unix_timestamp(F.lag("ts").over(w).cast("timestamp"))).cast("double")
    want = passes.select("event_id", gap.alias("g")).select("event_id", F.when((F.col("g") > 0) & (F.col("g") <= 60), F.col("g")))
    assert rows(got) == rows(want)


def test_earliest_fraction(passes):
    got = [r["event_id"] for r in clean.earliest_fraction(passes, 0.1).collect()]
    want = [r["event_id"] for r in passes.orderBy("ts", "event_id").limit(150).collect()]
    assert sorted(got) == sorted(want)


def test_split_boundary(passes):
    train, test = evaluate.temporal_split(passes, 0.25, "ts")
    times = sorted(r["ts"] for r in passes.select("ts").distinct().collect())
    n = max(1, round(len(times) * 0.25))
    assert test.agg(F.min("ts")).first()[0] == times[-n]
    assert train.count() + test.count() == passes.count()
