"""Reading, writing and administering detection and event tables."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from tollspan.functions import scalars as S

DETECTION_SCHEMA = T.StructType(
    [
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("speed_kmh", T.DoubleType()),
        T.StructField("category", T.IntegerType()),
        T.StructField("plate", T.StringType()),
        T.StructField("gantry", T.StringType()),
        T.StructField("lane", T.StringType()),
    ]
)

# The columns of a detection file and ours.
DETECTION_COLUMNS = {
    "FECHA": "ts_txt",
    "VELOCIDAD": "speed_txt",
    "CATEGORIA": "category_txt",
    "MATRICULA": "plate_txt",
    "PORTICO": "gantry_txt",
    "CARRIL": "lane_txt",
}

EVENT_SCHEMA = T.StructType(
    [
        T.StructField("event_time", T.TimestampNTZType()),
        T.StructField("km", T.DoubleType()),
        T.StructField("lat", T.DoubleType()),
        T.StructField("lon", T.DoubleType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("axis", T.StringType()),
        T.StructField("carriageway", T.StringType()),
        T.StructField("gantry_start", T.StringType()),
        T.StructField("gantry_end", T.StringType()),
        T.StructField("last_gantry", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("subtype", T.StringType()),
    ]
)


# ---- columns -----------------------------------------------------------------


def _plain(name: str) -> str:
    folded = name.lower().translate(str.maketrans(S.ACCENTED, S.PLAIN))
    return re.sub("[^a-z0-9]", "", folded)


def resolve_column(columns: Sequence[str], name: str, aliases: Sequence[str] = (), required: bool = True) -> str | None:
    """Exact name, else the same name without case, accents, spaces and punctuation, else an alias."""
    for wanted in (name, *aliases):
        if wanted in columns:
            return wanted
        for c in columns:
            if _plain(c) == _plain(wanted):
                return c
    if required:
        raise KeyError(f"no column like {name!r} in {list(columns)}")
    return None


# ---- detections --------------------------------------------------------------


def read_text_table(
    spark: SparkSession, path: str | Sequence[str], sep: str = ",", encoding: str = "UTF-8", limit: int | None = None
) -> DataFrame:
    """CSV with a header, all columns as text, malformed lines left out."""
    df = spark.read.csv(
        path if isinstance(path, str) else list(path), header=True, inferSchema=False, sep=sep, encoding=encoding,
        mode="DROPMALFORMED", enforceSchema=False,
    )
    return df.limit(limit) if limit else df


def sniffed_files(spark: SparkSession, path: str | Sequence[str]) -> list[tuple[str, str, str]]:
    """Path, separator and encoding of each file: `;` or `,`, whichever its first line has more of, and UTF-8 unless
    some line of it is none (then Latin-1). One pass over all lines; a row a file comes back.
    """
    from urllib.parse import unquote

    lines = spark.read.text(path if isinstance(path, str) else list(path)).select(
        F.col("_metadata.file_path").alias("file"),
        F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line")).alias("at"),
        "value",
    )
    found = lines.groupBy("file").agg(F.min_by("value", "at").alias("head"), F.max(~F.is_valid_utf8("value")).alias("bad"))
    semicolons = F.length(F.regexp_replace("head", "[^;]", "")) > F.length(F.regexp_replace("head", "[^,]", ""))
    rows = found.select("file", F.when(semicolons, ";").otherwise(",").alias("sep"), F.when(F.col("bad"), "ISO-8859-1").otherwise("UTF-8").alias("encoding"))
    return sorted((unquote(r["file"]), r["sep"], r["encoding"]) for r in rows.collect())


def read_sniffed(spark: SparkSession, path: str | Sequence[str], limit: int | None = None) -> DataFrame:
    """CSV files, each with its own separator and encoding. Columns that a file lacks are null in its rows."""
    by_form: dict[tuple[str, str], list[str]] = {}
    for file, sep, encoding in sniffed_files(spark, path):
        by_form.setdefault((sep, encoding), []).append(file)
    out = None
    for (sep, encoding), files in by_form.items():
        part = read_text_table(spark, files, sep, encoding)
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    out = read_text_table(spark, path) if out is None else out
    return out.limit(limit) if limit else out


def parse_detections(raw: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Typed detections; rows without a class or a time are dropped."""
    named = {alias: resolve_column(raw.columns, name, [alias]) for name, alias in DETECTION_COLUMNS.items()}
    text = {alias: S.clean_text(F.col(f"`{c}`")) for alias, c in named.items()}
    return raw.select(
        *keep,
        S.parse_detection_time(text["ts_txt"]).alias("ts"),
        S.parse_decimal(text["speed_txt"]).alias("speed_kmh"),
        S.parse_whole(text["category_txt"]).alias("category"),
        text["plate_txt"].alias("plate"),
        text["gantry_txt"].alias("gantry"),
        text["lane_txt"].alias("lane"),
    ).filter(F.col("category").isNotNull() & F.col("ts").isNotNull())


def read_detections_csv(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    return parse_detections(read_text_table(spark, path))


def write_detections(df: DataFrame, path: str, mode: str = "append") -> int:
    """Append to, or replace, a day-partitioned table; duplicates are kept. Returns the rows written."""
    if mode not in ("append", "overwrite"):
        raise ValueError("mode must be 'append' or 'overwrite'")
    from pyspark.sql import Observation

    seen = Observation()
    # counted behind the range shuffle, whose sampling pass would count every row twice
    rows = df.withColumn("day", F.to_date("ts")).repartitionByRange("day", "ts")
    rows.observe(seen, F.count(F.lit(1)).alias("n")).write.mode(mode).partitionBy("day").parquet(path)
    return seen.get["n"]


def read_detections(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def empty_table(spark: SparkSession, path: str) -> int:
    """Remove all rows, keep the schema; returns the previous row count."""
    old = spark.read.parquet(path)
    n, schema = old.count(), old.schema
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(path)
    return n


def table_summary(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def schema_listing(df: DataFrame) -> DataFrame:
    """Columns in order with name, type, whether they may be null, and how many rows are; one pass for all columns."""
    fields = list(enumerate(df.schema.fields))
    nulls = df.agg(*[F.count_if(F.col(f"`{f.name}`").isNull()).alias(f"n{i}") for i, f in fields])
    rows = [
        F.struct(
            F.lit(i).alias("ordinal"), F.lit(f.name).alias("name"), F.lit(f.dataType.simpleString()).alias("type"),
            F.lit(f.nullable).alias("nullable"), F.col(f"n{i}").alias("n_null"),
        )
        for i, f in fields
    ]
    return nulls.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def ordered_head(df: DataFrame, n: int, ts: str = "ts", tie: Sequence[str] = ("event_id",)) -> DataFrame:
    """First n rows by time; a missing time counts as 1970."""
    return df.orderBy(F.coalesce(F.col(ts), F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'")), *tie).limit(n)


def _within_days(df: DataFrame, ts: str, start: str | None, end: str | None) -> DataFrame:
    """Bounds on the `day` of a day-partitioned table that follow from those on its time, so that folders are skipped."""
    if ts == "ts" and dict(df.dtypes).get("day") == "date":
        if start is not None:
            df = df.filter(F.col("day") >= F.to_date(F.lit(start).cast("timestamp_ntz")))
        if end is not None:
            df = df.filter(F.col("day") <= F.to_date(F.lit(end).cast("timestamp_ntz")))
    return df


def range_scan(df: DataFrame, start: str, end: str, ts: str = "ts") -> DataFrame:
    """Half-open range [start, end)."""
    df = _within_days(df, ts, start, end)
    return df.filter((F.col(ts) >= F.lit(start).cast("timestamp_ntz")) & (F.col(ts) < F.lit(end).cast("timestamp_ntz")))


def load_range(
    df: DataFrame, start: str | None = None, end: str | None = None, cap: int | None = None, ts: str = "ts"
) -> DataFrame:
    """Closed range; an end given as a date means the end of that day. Rows without a class are dropped."""
    out = _within_days(df, ts, start, end).filter(F.col("category").isNotNull())
    if start is not None:
        out = out.filter(F.col(ts) >= F.lit(start).cast("timestamp_ntz"))
    if end is not None:
        if len(end) <= 10:
            out = out.filter(F.col(ts) < F.expr(f"timestampadd(DAY, 1, TIMESTAMP_NTZ'{end} 00:00:00')"))
        else:
            out = out.filter(F.col(ts) <= F.lit(end).cast("timestamp_ntz"))
    return out.limit(cap) if cap is not None else out


# ---- catalogue -----------------------------------------------------------------


def parse_catalogue(raw: DataFrame) -> DataFrame:
    """Gantry catalogue; map and coordinate columns are kept when present."""
    col = {
        out: resolve_column(raw.columns, name, aliases, required)
        for out, name, aliases, required in [
            ("gantry", "portico", ["gantry"], True),
            ("km", "km", ["Km."], True),
            ("carriageway", "calzada", ["carriageway"], True),
            ("seq", "orden", ["seq"], True),
            ("axis", "eje", ["axis"], True),
            ("edge_id", "edge_id", [], False),
            ("pos_m", "pos_m", [], False),
            ("lat", "lat", ["latitud"], False),
            ("lon", "lon", ["longitud"], False),
            ("lat_lon", "lat-lon", [], False),
        ]
    }

    def text(out: str) -> Column:
        return F.col(f"`{col[out]}`").cast("string")

    cols = [
        S.normalise_gantry(text("gantry")).alias("gantry"),
        S.parse_decimal(text("km")).alias("km"),
        S.clean_text(text("carriageway")).alias("carriageway"),
        S.parse_decimal(text("seq")).cast("int").alias("seq"),
        S.clean_text(text("axis")).alias("axis"),
    ]
    if col["edge_id"]:
        cols.append(S.clean_text(text("edge_id")).alias("edge_id"))
    if col["pos_m"]:
        cols.append(S.parse_decimal(text("pos_m")).alias("pos_m"))
    if col["lat"] and col["lon"]:
        cols += [S.parse_decimal(text("lat")).alias("lat"), S.parse_decimal(text("lon")).alias("lon")]
    elif col["lat_lon"]:
        lat, lon = S.split_lat_lon(text("lat_lon"))
        cols += [lat.alias("lat"), lon.alias("lon")]
    return raw.select(*cols)


# ---- events ----------------------------------------------------------------------


def union_event_files(frames: Sequence[DataFrame], types: Sequence[str] | None = None) -> DataFrame:
    """Union of event logs with differing columns, kept to some types regardless of case."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    if types:
        out = out.filter(F.lower(S.strip(F.col("tipo"))).isin(*[t.strip().lower() for t in types]))
    return out


def event_types(frames: Sequence[DataFrame]) -> DataFrame:
    out = frames[0].select("tipo")
    for f in frames[1:]:
        out = out.unionByName(f.select("tipo"))
    return out.select(S.clean_text(F.col("tipo")).alias("event_type")).dropna().distinct().orderBy("event_type")


def conform_events(df: DataFrame) -> DataFrame:
    """The fixed event columns, cast; absent ones become NULL."""
    return df.select(
        *[
            (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in EVENT_SCHEMA.fields
        ]
    )


def write_events(df: DataFrame, path: str) -> None:
    conform_events(df).write.mode("overwrite").parquet(path)


def read_events(spark: SparkSession, path: str) -> DataFrame:
    try:
        return conform_events(spark.read.parquet(path))
    except AnalysisException:
        return spark.createDataFrame([], EVENT_SCHEMA)


# ---- feature tables and artifacts ---------------------------------------------------


def write_features(df: DataFrame, path: str, ts: str | None = None, mode: str = "overwrite") -> None:
    """Feature table, partitioned by month when it has a time."""
    if ts is None:
        df.write.mode(mode).parquet(path)
    else:
        df.withColumn("month", S.month_key(F.col(ts))).repartitionByRange("month", ts).write.mode(mode).partitionBy(
            "month"
        ).parquet(path)


def read_features(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.parquet(path)
    return df.drop("month") if "month" in df.columns else df


def feature_extent(df: DataFrame, gantry: str = "gantry", ts: str = "interval_start") -> DataFrame:
    """Gantry count, interval range and span in days of a feature table."""
    return df.agg(
        F.count_distinct(gantry).alias("n_gantries"),
        F.min(ts).alias("first_interval"),
        F.max(ts).alias("last_interval"),
        (F.datediff(F.max(ts), F.min(ts)) + 1).alias("span_days"),
    )


def export_table(df: DataFrame, path: str, fmt: str = "csv") -> None:
    writer = df.write.mode("overwrite")
    if fmt == "csv":
        writer.csv(path, header=True)
    elif fmt in ("parquet", "json"):
        writer.format(fmt).save(path)
    else:
        raise ValueError(f"unknown format {fmt!r}")


def read_artifact(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """Read a table by its file ending: CSV/TXT, Parquet, JSON or JSON lines."""
    kind = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if kind in ("csv", "txt"):
        df = read_sniffed(spark, path)
    elif kind == "parquet":
        df = spark.read.parquet(path)
    elif kind == "json":
        df = spark.read.json(path, multiLine=True)
    elif kind in ("jsonl", "ndjson"):
        df = spark.read.json(path)
    else:
        raise ValueError(f"no reader for {kind!r}")
    return df.limit(limit) if limit else df


ROAD_SCHEMA = (
    "elements array<struct<id: bigint, tags: struct<name: string, ref: string>, "
    "geometry: array<struct<lat: double, lon: double>>>>"
)


def road_points(df: DataFrame) -> DataFrame:
    """Ordered points of each way in a road geometry document."""
    way = df.select(F.explode("elements").alias("e")).filter(F.size("e.geometry") > 0)
    return way.select(
        F.col("e.id").alias("way_id"),
        F.col("e.tags.name").alias("name"),
        F.col("e.tags.ref").alias("ref"),
        F.posexplode("e.geometry").alias("point", "g"),
    ).select("way_id", "name", "ref", "point", F.col("g.lat").alias("lat"), F.col("g.lon").alias("lon"))


def read_roads(spark: SparkSession, path: str) -> DataFrame:
    return road_points(spark.read.json(path, schema=ROAD_SCHEMA, multiLine=True))


# ---- column families -----------------------------------------------------------------

KEY_COLUMNS = {"target", "synthetic", "km_last", "km_next", "seq", "event_id", "interval_start", "k"}


def numeric_features(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    """Numeric columns that are neither keys, positions, target nor flags."""
    numeric = ("double", "float", "int", "bigint", "smallint", "tinyint")
    skip = KEY_COLUMNS | set(exclude)
    return [c for c, t in df.dtypes if (t in numeric or t.startswith("decimal")) and c not in skip]


def cluster_features(columns: Sequence[str]) -> list[str]:
    return [c for c in columns if re.match(r"(last_|next_)?cluster_", c) and not c.endswith("cluster_label")]


def pick_features(columns: Sequence[str], wanted: Sequence[str]) -> tuple[list[str], list[str]]:
    """The wanted columns that exist and those that do not."""
    found = {w: resolve_column(columns, w, required=False) for w in wanted}
    return [c for c in found.values() if c], [w for w, c in found.items() if c is None]
