"""Gantry catalogue: sections, kilometre brackets and coordinates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tollspan.functions import scalars as S
from tollspan.operators.clean import drop_duplicates_keep

LINE = ["_axis", "_way"]


def _line(df: DataFrame, axis: str = "axis", way: str = "carriageway") -> DataFrame:
    """Case-insensitive keys of the line (axis and carriageway) a row belongs to."""
    return df.withColumns({"_axis": F.upper(S.strip(F.col(axis))), "_way": F.upper(S.strip(F.col(way)))})


def consecutive_sections(catalogue: DataFrame) -> DataFrame:
    """Pairs of neighbouring gantries in running order."""
    w = Window.partitionBy("axis", "carriageway").orderBy("seq", "gantry")
    known = catalogue.filter(F.col("axis").isNotNull() & F.col("carriageway").isNotNull() & F.col("seq").isNotNull())
    return known.select(
        "axis",
        "carriageway",
        F.col("gantry").alias("gantry_last"),
        F.col("km").alias("km_last"),
        F.lead("gantry").over(w).alias("gantry_next"),
        F.lead("km").over(w).alias("km_next"),
    ).filter(F.col("gantry_next").isNotNull())


def gantry_sequences(catalogue: DataFrame) -> DataFrame:
    """Gantries of each line as one ordered text."""
    ordered = F.sort_array(F.collect_list(F.struct("seq", "gantry")))
    return catalogue.groupBy("axis", "carriageway").agg(
        F.array_join(F.transform(ordered, lambda p: p["gantry"]), " > ").alias("gantries")
    )


def _placed(catalogue: DataFrame) -> DataFrame:
    w = Window.partitionBy(*LINE).orderBy("seq", "gantry")
    return _line(catalogue.filter(F.col("km").isNotNull())).select(
        *LINE,
        "gantry",
        "km",
        F.row_number().over(w).alias("_i"),
        F.lead("gantry").over(w).alias("_next"),
        F.lead("km").over(w).alias("_next_km"),
    )


def bracket_gantries(
    events: DataFrame, catalogue: DataFrame, *, key: str = "event_id", cell_km: float = 1.0
) -> DataFrame:
    """Add `gantry_before` and `gantry_after` of each event's kilometre.

    The first bracket in running order wins; before the first post there is only an
    `after`, beyond the last only a `before`; a line of one post gives it as `after`.
    Sections are spread over kilometre cells, so the range join is an equi-join.
    """
    placed = _placed(catalogue)
    ends = placed.groupBy(*LINE).agg(
        F.max("_i").alias("_n"),
        F.max(F.when(F.col("_i") == 1, F.col("gantry"))).alias("_first"),
        F.max(F.when(F.col("_i") == 1, F.col("km"))).alias("_first_km"),
        F.max(F.when(F.col("_i") == 1, F.coalesce(F.col("km") <= F.col("_next_km"), F.lit(True)))).alias("_asc"),
        F.max(F.struct("_i", "gantry", "km")).alias("_last"),
    )
    steps = placed.filter(F.col("_next").isNotNull()).join(ends.select(*LINE, "_asc"), LINE)
    steps = steps.filter(F.when(F.col("_asc"), F.col("km") <= F.col("_next_km")).otherwise(F.col("km") >= F.col("_next_km")))
    low, high = F.least("km", "_next_km"), F.greatest("km", "_next_km")

    def cell(c: Column) -> Column:
        return F.floor(c / F.lit(cell_km))

    steps = steps.select(
        *LINE, "_i", F.col("gantry").alias("_from"), F.col("_next").alias("_to"), low.alias("_low"), high.alias("_high"),
        F.explode(F.sequence(cell(low), cell(high))).alias("_cell"),
    )
    points = _line(events)
    hits = (
        points.select(key, "km", *LINE, cell(F.col("km")).alias("_cell"))
        .join(steps, [*LINE, "_cell"])
        .filter(F.col("km").between(F.col("_low"), F.col("_high")))
        .groupBy(key)
        .agg(F.min(F.struct("_i", "_from", "_to")).alias("_hit"))
    )
    found = points.join(hits, key, "left").join(ends, LINE, "left")
    x, hit = F.col("km"), F.col("_hit").isNotNull()
    many = F.col("_n") >= 2
    ahead = many & F.when(F.col("_asc"), x < F.col("_first_km")).otherwise(x > F.col("_first_km"))
    past = many & F.when(F.col("_asc"), x > F.col("_last.km")).otherwise(x < F.col("_last.km"))
    before = F.when(hit, F.col("_hit._from")).when(past & ~F.coalesce(ahead, F.lit(False)), F.col("_last.gantry"))
    after = (
        F.when(hit, F.col("_hit._to")).when(ahead, F.col("_first")).when(F.col("_n") == 1, F.col("_first"))
    )
    return found.select(*[found[c] for c in events.columns], before.alias("gantry_before"), after.alias("gantry_after"))


def two_nearest(events: DataFrame, catalogue: DataFrame, *, key: str = "event_id", cell_km: float = 1.0) -> DataFrame:
    """The two gantries nearest by kilometre on the same line, nearest first.

    Only a post's neighbours in kilometre order can be nearest: events and posts are
    merged in that order and each event looks at two posts on either side.
    """
    posts = drop_duplicates_keep(
        catalogue.filter(F.col("km").isNotNull() & F.col("lat").isNotNull() & F.col("lon").isNotNull()).select(
            "axis", "carriageway", "gantry", "km", "lat", "lon", "seq"
        ),
        ["gantry"],
        ["seq"],
    )
    by_km = Window.partitionBy("axis", "carriageway").orderBy("km", "gantry")
    post = F.struct("km", "gantry", "lat", "lon")
    near = posts.select(
        "axis", "carriageway", "km",
        F.array(F.lag(post, 1).over(by_km), post, F.lead(post, 1).over(by_km), F.lead(post, 2).over(by_km)).alias("_posts"),
        F.coalesce(F.lead("km").over(by_km), F.lit(float("inf"))).alias("_to"),
        F.row_number().over(by_km).alias("_i"),
    )
    # Each event finds the last post not beyond it; before the first post it uses that one.
    span = near.select(
        "axis", "carriageway", "_posts",
        F.when(F.col("_i") == 1, F.lit(float("-inf"))).otherwise(F.col("km")).alias("_from"), "_to",
    )
    bounds = posts.groupBy("axis", "carriageway").agg(F.min("km").alias("_km0"), F.max("km").alias("_km1"))

    def cell(c: Column) -> Column:
        return F.floor(c / F.lit(cell_km)).cast("bigint")

    span = span.join(bounds, ["axis", "carriageway"]).select(
        "axis", "carriageway", "_posts", "_from", "_to",
        F.explode(F.sequence(cell(F.greatest("_from", "_km0")), cell(F.least("_to", "_km1")))).alias("_cell"),
    )
    inside = F.greatest(F.least("km", "_km1"), "_km0")
    located = (
        events.filter(F.col("km").isNotNull())
        .join(bounds, ["axis", "carriageway"])
        .withColumn("_cell", cell(inside))
        .join(span, ["axis", "carriageway", "_cell"])
        .filter((F.col("km") >= F.col("_from")) & (F.col("km") < F.col("_to")))
    )
    ranked = F.sort_array(
        F.transform(
            F.filter("_posts", lambda p: p.isNotNull()),
            lambda p: F.struct(
                F.abs(p["km"] - F.col("km")).alias("d"), p["km"].alias("km"), p["gantry"].alias("gantry"),
                p["lat"].alias("lat"), p["lon"].alias("lon"),
            ),
        )
    )
    return located.withColumn("_r", ranked).select(
        key, F.try_element_at("_r", F.lit(1)).alias("near1"), F.try_element_at("_r", F.lit(2)).alias("near2")
    )


def attach_coordinates(catalogue: DataFrame, coordinates: DataFrame) -> DataFrame:
    """Coordinates by gantry, axis and carriageway when all are known, else by gantry alone."""
    full = coordinates.filter(F.col("axis").isNotNull() & F.col("carriageway").isNotNull())
    full = drop_duplicates_keep(full, ["gantry", "axis", "carriageway"], ["lat", "lon"])
    by_id = drop_duplicates_keep(coordinates.select("gantry", "lat", "lon"), ["gantry"], ["lat", "lon"])
    out = catalogue.join(full.select("gantry", "axis", "carriageway", F.col("lat").alias("_a"), F.col("lon").alias("_b")),
                         ["gantry", "axis", "carriageway"], "left")
    out = out.join(by_id.select("gantry", F.col("lat").alias("_c"), F.col("lon").alias("_d")), "gantry", "left")
    return out.withColumns({"lat": F.coalesce("_a", "_c"), "lon": F.coalesce("_b", "_d")}).drop("_a", "_b", "_c", "_d")
