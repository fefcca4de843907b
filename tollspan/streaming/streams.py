"""Structured Streaming forms of the flow, headway, lane and trip features."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tollspan.functions import scalars as S
from tollspan.operators import trajectory as T
from tollspan.session import fresh_path
from tollspan.sources.ingest import parse_detections
from tollspan.skew import micros

# ---- plumbing ------------------------------------------------------------------------


def table_stream(spark: SparkSession, folder: str, file_glob: str) -> DataFrame:
    """Stream of the Parquet files of a folder that match a pattern."""
    schema = spark.read.option("pathGlobFilter", file_glob).parquet(folder).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", file_glob).parquet(folder)


def event_time(df: DataFrame, ts: str = "ts", delay: str = "10 minutes") -> DataFrame:
    """Add `event_at`, the zone-bound event time a watermark needs."""
    return df.withColumn("event_at", F.col(ts).cast("timestamp")).withWatermark("event_at", delay)


class Closing:
    """The end of a finished input, so that what waits for the watermark comes out too.

    `rows` is the stream to work on: the given one, and one more source that is empty until `finish` puts a single
    row into it. That row has the latest of times and CLOSED as its text keys; it moves the watermark past all
    others, and the operators below pass over it. A stream that goes on is never finished.
    """

    def __init__(self, rows: DataFrame, ts: str = "ts") -> None:
        self.spark, self.schema, self.ts = rows.sparkSession, rows.schema, ts
        self.folder = fresh_path(self.spark, "closing")
        self.spark.createDataFrame([], self.schema).write.parquet(self.folder)
        self.rows = rows.unionByName(self.spark.readStream.schema(self.schema).parquet(self.folder))

    def finish(self) -> None:
        values = [
            F.lit(CLOSED).alias(f.name)
            if f.dataType.simpleString() == "string"
            else F.lit(LAST_TIME if f.name == self.ts else None).cast(f.dataType).alias(f.name)
            for f in self.schema.fields
        ]
        self.spark.range(1).select(*values).write.mode("append").parquet(self.folder)


CLOSED = "\u0001closed"
LAST_TIME = "2200-01-01 00:00:00"  # pandas times end in 2262


def drain(df: DataFrame, name: str, path: str | None = None, checkpoint: str | None = None, closing: Closing | None = None) -> DataFrame:
    """Run a stream over all there is into a Parquet sink, exactly once, and read the sink.

    With `closing` the input is over: the stream goes on once more from where it stands, and flushes all it holds.
    """
    spark = df.sparkSession
    path = path or fresh_path(spark, name)
    checkpoint = checkpoint or fresh_path(spark, f"{name}-state")

    def run() -> None:
        query = (
            df.writeStream.format("parquet")
            .option("path", path)
            .option("checkpointLocation", checkpoint)
            .outputMode("append")
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()

    run()
    if closing:
        closing.finish()
        run()
    return spark.read.schema(df.schema).parquet(path)


# ---- flow -------------------------------------------------------------------------------


def flow_stream(
    df: DataFrame, minutes: int = 5, slide: int | None = None, delay: str = "10 minutes", lanes: int = 1
) -> DataFrame:
    """Flow features per closed window; rows later than the watermark are dropped."""
    rows = df.select(
        "ts", "speed_kmh", S.strip(F.col("gantry")).alias("gantry"), S.category_label(F.col("category")).alias("class_label")
    ).dropna()
    span = F.window("event_at", f"{minutes} minutes", f"{slide or minutes} minutes").alias("w")
    per_hour = F.col("flow_count") * (60.0 / minutes) / lanes
    return (
        event_time(rows, delay=delay)
        .groupBy(span, "gantry", "class_label")
        .agg(
            F.count(F.lit(1)).alias("flow_count"),
            F.avg("speed_kmh").alias("speed_mean"),
            F.coalesce(F.stddev_samp("speed_kmh"), F.lit(0.0)).alias("speed_std"),
        )
        .select(
            "gantry",
            F.col("w.start").cast("timestamp_ntz").alias("interval_start"),
            "class_label",
            "flow_count",
            "speed_mean",
            "speed_std",
            per_hour.alias("flow_per_hour"),
            S.density(per_hour, F.col("speed_mean")).alias("density"),
        )
    )


# ---- state per gantry and lane, and per plate ----------------------------------------------

TIMEOUT = GroupStateTimeout.EventTimeTimeout


def _settled(parts: Iterator[pd.DataFrame], state: GroupState, kind: pa.Schema, order: list[str]) -> tuple[pa.Table, list | None]:
    """Rows of a key that the watermark has passed, in time order, and what the key carries from earlier rows.

    No row can come before them any more, so rows that arrive late but within the delay take their right place.
    The others wait in the state; the key is called again when the watermark reaches the first of them. What a
    key carries is kept for good, however long it stays silent. Rows are held as Arrow columns, in memory and in
    the state, as a busy gantry may have millions of them waiting.
    """
    carried, waiting = (json.loads(state.get[0]), state.get[1]) if state.exists else (None, None)
    tables = [pa.Table.from_pandas(p, schema=kind, preserve_index=False) for p in parts]
    if waiting:
        tables.append(pa.ipc.open_stream(pa.py_buffer(bytes(waiting))).read_all())
    del waiting
    if not tables:
        return kind.empty_table(), carried
    every = pa.concat_tables(tables)
    del tables
    every = every.take(pc.sort_indices(every, sort_keys=[(c, "ascending") for c in order]))
    mark = state.getCurrentWatermarkMs()
    n_ready = pc.sum(pc.less_equal(every["us"], mark * 1000)).as_py() or 0
    later = every.slice(n_ready)
    if len(later):
        state.setTimeoutTimestamp(max(mark + 1, later["us"][0].as_py() // 1000 + 1))
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, kind) as out:
        out.write_table(later, max_chunksize=CHUNK)
    _keep(state, carried, sink.getvalue().to_pybytes() if len(later) else b"")
    return every.slice(0, n_ready), carried


def _chunks(ready: pa.Table) -> Iterator[pd.DataFrame]:
    """The rows in turn, a few at a time."""
    for at in range(0, len(ready), CHUNK):
        yield ready.slice(at, CHUNK).to_pandas()


def _keep(state: GroupState, carried: list | None, waiting: bytes | None = None) -> None:
    """Write what a key carries, and the rows that wait unless they stay as they are."""
    state.update((json.dumps(carried), bytes(state.get[1]) if waiting is None else waiting))


STATE = "carried string, waiting binary"
CHUNK = 50_000


def headway_stream(df: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Gap and speed of the vehicle before at each gantry and lane, once the watermark has passed a row."""
    kind = pa.schema([("event_id", pa.int64()), ("plate", pa.string()), ("speed_kmh", pa.float64()), ("us", pa.int64())])

    def follow(key, parts, state: GroupState):
        if key[0] == CLOSED:
            return
        ready, last = _settled(parts, state, kind, ["us", "plate", "event_id"])
        before = last or [None, None]
        for out in _chunks(ready):
            out["prev_us"] = out["us"].shift().astype(float)
            out.loc[0, "prev_us"] = float("nan") if before[0] is None else before[0]
            out["prev_speed"] = out["speed_kmh"].shift()
            out.loc[0, "prev_speed"] = float("nan") if before[1] is None else before[1]
            out["headway_s"] = (out["us"] - out["prev_us"]) / 1e6
            speed = out["speed_kmh"].iloc[-1]
            before = [int(out["us"].iloc[-1]), None if pd.isna(speed) else float(speed)]
            out = out[out["headway_s"].notna()].assign(gantry=key[0], lane=key[1])
            yield out[["event_id", "plate", "gantry", "lane", "speed_kmh", "headway_s", "prev_speed"]]
        if len(ready):
            _keep(state, before)

    lane = F.when(F.col("gantry") == CLOSED, 0).otherwise(F.col("lane"))  # so the closing row stays
    rows = df.withColumns({"us": micros("ts"), "lane": lane}).filter(F.col("gantry").isNotNull() & F.col("lane").isNotNull())
    rows = event_time(rows, delay=delay).select("event_id", "plate", "gantry", "lane", "speed_kmh", "us", "event_at")
    return rows.groupBy("gantry", "lane").applyInPandasWithState(
        lambda key, parts, state: follow(key, (p.drop(columns=["event_at", "gantry", "lane"]) for p in parts), state),
        "event_id bigint, plate string, gantry string, lane int, speed_kmh double, headway_s double, prev_speed double",
        STATE, "append", TIMEOUT,
    )


def conflict_columns(headways: DataFrame, max_headway_s: float = 60.0) -> DataFrame:
    """Valid headway and conflict flag of streamed headways."""
    ok = (F.col("headway_s") > 0) & (F.col("headway_s") <= max_headway_s)
    faster = F.col("speed_kmh") - F.col("prev_speed")
    ttc = F.when(faster > 0, F.col("headway_s") * F.col("speed_kmh") / faster)
    hit = F.coalesce((ttc < S.ttc_limit(F.col("gantry"))).cast("int"), F.lit(0))
    return headways.filter(ok).withColumn("conflict", hit)


def lane_change_stream(df: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Passes and lane changes that the rows passed by the watermark add to a plate, its last lane carried as state."""
    kind = pa.schema([("event_id", pa.int64()), ("gantry", pa.string()), ("lane", pa.int32()), ("us", pa.int64())])

    def count(key, parts, state: GroupState):
        if key[0] == CLOSED:
            return
        ready, last = _settled((p.drop(columns=["event_at", "plate"]) for p in parts), state, kind, ["us", "gantry", "event_id"])
        out = ready.to_pandas()
        if len(out):
            before = out["lane"].shift()
            if last is not None:
                before.iloc[0] = last[0]
            _keep(state, [int(out["lane"].iloc[-1])])
            n = int(((out["lane"] != before) & before.notna()).sum())
            yield pd.DataFrame({"plate": [key[0]], "passes": [len(out)], "lane_changes": [n]})

    rows = event_time(df.withColumn("us", micros("ts")), delay=delay).select("event_id", "plate", "gantry", "lane", "us", "event_at")
    return rows.groupBy("plate").applyInPandasWithState(
        count, "plate string, passes bigint, lane_changes bigint", STATE, "append", TIMEOUT
    )


def session_stream(df: DataFrame, gap: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Trips by the gap rule alone: closed sessions per plate."""
    return (
        event_time(df, delay=delay)
        .groupBy("plate", F.session_window("event_at", gap).alias("w"))
        .agg(F.count(F.lit(1)).alias("n_passes"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
        .select("plate", "n_passes", "first_ts", "last_ts")
        # by its time: a condition on the plate would be moved in front of the watermark
        .filter(F.col("first_ts") < F.lit(LAST_TIME).cast("timestamp_ntz"))
    )


def trip_stream(df: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Trips by all rules, once the watermark has passed a row; `df` carries `km`.

    A key carries its last time, km, direction and trip number, so numbers go on after any silence.
    """
    kind = pa.schema([("event_id", pa.int64()), ("gantry", pa.string()), ("km", pa.float64()), ("us", pa.int64())])

    def cut(key, parts, state: GroupState):
        if key[0] == CLOSED:
            return
        ready, last = _settled((p.drop(columns=["event_at", "plate"]) for p in parts), state, kind, ["us", "gantry"])
        out = ready.to_pandas()
        if not len(out):
            return
        gap, step = out["us"].diff() / 1e6, out["km"].diff()
        if last is not None:
            gap.iloc[0], step.iloc[0] = (out["us"].iloc[0] - last[0]) / 1e6, out["km"].iloc[0] - last[1]
        sign = step.fillna(0.0).apply(lambda v: (v > 0) - (v < 0))
        before = sign.shift()
        if last is not None:
            before.iloc[0] = last[2]
        dist, speed = step.abs(), (step.abs() / gap.where(gap > 0)) * 3600
        ends = (
            gap.isna()
            | (gap > T.MAX_GAP_S)
            | (dist > T.MAX_JUMP_KM)
            | (speed > T.MAX_SPEED_KMH)
            | (speed < T.MIN_SPEED_KMH)
            | ((gap == 0) & (dist > 0))
            | ((sign != before) & before.notna() & (sign != 0) & (before != 0))
        )
        number = ends.cumsum() + (last[3] if last is not None else 0)
        _keep(state, [int(out["us"].iloc[-1]), float(out["km"].iloc[-1]), int(sign.iloc[-1]), int(number.iloc[-1])])
        yield pd.DataFrame(
            {"event_id": out["event_id"], "plate": key[0], "trip_no": number.astype("int64"), "trip_break": ends}
        )

    rows = event_time(df.withColumn("us", micros("ts")), delay=delay).select("event_id", "plate", "gantry", "km", "us", "event_at")
    return rows.groupBy("plate").applyInPandasWithState(
        cut, "event_id bigint, plate string, trip_no bigint, trip_break boolean", STATE, "append", TIMEOUT
    )


# ---- ingest, dedupe, results -----------------------------------------------------------------


def ingest_stream(spark: SparkSession, folder: str, path: str, checkpoint: str) -> DataFrame:
    """Append the new CSV files of a folder to the detection table, each file exactly once."""
    schema = spark.read.csv(folder, header=True).schema
    raw = spark.readStream.schema(schema).option("header", True).csv(folder)
    return drain(parse_detections(raw), "detections", path, checkpoint)


def dedupe_stream(df: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """First of equal passes; unlike the batch form, which keeps the slowest."""
    return event_time(df, delay=delay).dropDuplicatesWithinWatermark(["plate", "gantry", "lane", "ts"]).drop("event_at")


def best_board(df: DataFrame, keys: list[str], metric: str, fields: list[str], path: str | None = None) -> DataFrame:
    """Best row per key so far; the board is rewritten after each batch."""
    spark = df.sparkSession
    path = path or fresh_path(spark, "board")
    ok = df.filter(F.col(metric).isNotNull() & F.col("error").isNull())
    order = F.struct(metric, *[(-F.col(f)).alias(f) for f in fields])
    board = ok.groupBy(*keys).agg(F.max(order).alias("m")).select(
        *keys, F.col(f"m.{metric}").alias(metric), *[(-F.col(f"m.{f}")).alias(f) for f in fields]
    )
    query = (
        board.writeStream.outputMode("complete")
        .foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(path))
        .option("checkpointLocation", fresh_path(spark, "board-state"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.parquet(path)
