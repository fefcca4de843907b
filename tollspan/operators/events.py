"""Accident and event preparation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tollspan.functions import scalars as S
from tollspan.operators.catalog import bracket_gantries
from tollspan.operators.clean import accident_rows

ROADS = ("expresa", "via expresa")


def _common(log: DataFrame) -> DataFrame:
    return log.withColumns(
        {
            "carriageway": S.carriageway(F.col("calzada")),
            "axis": F.col("eje"),
            "event_time": S.parse_event_time(F.col("fecha_inicio"), F.col("hora_inicio")),
            "km": S.parse_decimal(F.col("km_txt")),
        }
    )


def prepare_accidents(log: DataFrame, catalogue: DataFrame, roads: Sequence[str] = ROADS) -> DataFrame:
    """Accidents with time, duration, severity and bracketing gantries; `accepted` tells the usable ones."""
    rows = _common(accident_rows(log, roads))
    rows = rows.withColumns(
        {
            "subtype": S.strip_subtype(F.col("subtipo")),
            "_end": S.parse_event_time(F.col("fecha_fin"), F.col("hora_fin")),
            "severity": S.severity(log),
        }
    ).withColumn("duration_min", S.minutes_between("event_time", "_end"))
    kept = rows.select(
        "event_id", "event_time", "duration_min", "km", "axis", "carriageway", "subtype", "severity"
    )
    out = bracket_gantries(kept, catalogue)
    return out.withColumnsRenamed({"gantry_before": "last_gantry", "gantry_after": "next_gantry"}).withColumn(
        "accepted", F.col("last_gantry").isNotNull()
    )


def accepted(accidents: DataFrame) -> DataFrame:
    return accidents.filter("accepted").drop("accepted")


def excluded(accidents: DataFrame) -> DataFrame:
    return accidents.filter("NOT accepted").drop("accepted")


def prepare_events(log: DataFrame, catalogue: DataFrame, roads: Sequence[str] = ROADS) -> DataFrame:
    """Events of every type on the given roads with their bracketing gantries."""
    rows = _common(log.filter(F.lower("via").isin(*roads))).select(
        "event_id",
        S.strip(F.col("tipo")).alias("event_type"),
        "event_time",
        "km",
        "axis",
        "carriageway",
        S.strip(F.col("descripcion")).alias("description"),
        S.strip(F.col("subtipo")).alias("subtype"),
    )
    out = bracket_gantries(rows, catalogue)
    return out.withColumns(
        {
            "gantry_start": F.coalesce("gantry_before", F.lit("")),
            "gantry_end": F.coalesce("gantry_after", F.lit("")),
            "last_gantry": F.col("gantry_before"),
        }
    ).drop("gantry_before", "gantry_after")


def fill_missing_brackets(events: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Bracket only the stored events that lack a first gantry; `fixed` marks those found."""
    clean = {c: S.normalise_gantry(F.col(c)) for c in ("gantry_start", "gantry_end", "last_gantry")}
    rows = events.withColumns(clean)
    lacking = rows.filter(F.col("gantry_start").isNull())
    found = bracket_gantries(lacking, catalogue)
    found = found.withColumns(
        {
            "gantry_start": F.col("gantry_before"),
            "gantry_end": F.col("gantry_after"),
            "last_gantry": F.col("gantry_before"),
            "fixed": F.col("gantry_before").isNotNull(),
        }
    ).drop("gantry_before", "gantry_after")
    return rows.filter(F.col("gantry_start").isNotNull()).withColumn("fixed", F.lit(False)).unionByName(found)
