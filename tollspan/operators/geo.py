"""Event coordinates, snapping to the road network, density grid."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tollspan.functions import geo as G
from tollspan.functions import scalars as S
from tollspan.operators.catalog import two_nearest
from tollspan.operators.clean import drop_duplicates_keep
from tollspan.session import durable


def event_coordinates(events: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Coordinates between the bracketing gantries, else at the known one, else from the two nearest."""
    posts = drop_duplicates_keep(
        catalogue.filter(F.col("gantry").isNotNull()).select("gantry", "km", "lat", "lon", "seq"), ["gantry"], ["seq"]
    ).drop("seq")

    def end(tag: str) -> DataFrame:
        return posts.select(F.col("gantry").alias(f"_g{tag}"), *[F.col(c).alias(f"_{c}{tag}") for c in ("km", "lat", "lon")])

    rows = events.withColumns(
        {
            "_ga": F.coalesce(S.normalise_gantry(F.col("gantry_start")), S.normalise_gantry(F.col("last_gantry"))),
            "_gb": S.normalise_gantry(F.col("gantry_end")),
        }
    )
    rows = rows.join(end("a"), "_ga", "left").join(end("b"), "_gb", "left")
    near = two_nearest(events.select("event_id", "axis", "carriageway", "km"), catalogue)
    rows = rows.join(near, "event_id", "left")
    at_a = F.col("_lata").isNotNull() & F.col("_lona").isNotNull()
    at_b = F.col("_latb").isNotNull() & F.col("_lonb").isNotNull()
    share = G.km_fraction(F.col("km"), F.col("_kma"), F.col("_kmb"))
    mid = G.great_circle_point(F.col("_lata"), F.col("_lona"), F.col("_latb"), F.col("_lonb"), share)
    n1, n2 = (lambda f: F.col(f"near1.{f}")), (lambda f: F.col(f"near2.{f}"))
    share2 = G.km_fraction(F.col("km"), n1("km"), n2("km"))
    mid2 = G.great_circle_point(n1("lat"), n1("lon"), n2("lat"), n2("lon"), share2)

    def choose(i: int, c: str):
        return (
            F.when(at_a & at_b & share.isNotNull(), mid[i])
            .when(at_a, F.col(f"_{c}a"))
            .when(at_b, F.col(f"_{c}b"))
            .when(F.col("near2").isNotNull(), mid2[i])
            .otherwise(n1(c))
        )

    return rows.select(*[rows[c] for c in events.columns if c not in ("lat", "lon")],
                       choose(0, "lat").alias("lat"), choose(1, "lon").alias("lon"))


def road_segments(points: DataFrame) -> DataFrame:
    """Straight pieces of each way, from ordered points (way_id, point, lat, lon)."""
    nxt = points.select("way_id", (F.col("point") - 1).alias("point"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2"))
    return points.join(nxt, ["way_id", "point"]).select("way_id", "point", "lat", "lon", "lat2", "lon2")


def snap_to_road(points: DataFrame, segments: DataFrame, *, key: str = "event_id", cell: float = 0.01) -> DataFrame:
    """Nearest point of the road network for each located point: `snap_lat`, `snap_lon`, `snap_d2`.

    Segments are spread over a grid, one cell beyond their box, as far as points lie in its cells. A best match
    within one cell's length is final; the points left are tried again on a grid four times as
    coarse, until none is left. Exact, and no pairing of all points with all segments. Pairs are never sorted or
    kept: the least distance of a point is summed up as they arise, and only the pairs at that distance go on.
    """
    todo = points.filter(F.col("lat").isNotNull() & F.col("lon").isNotNull()).select(key, "lat", "lon")
    segments = durable(segments)
    box = segments.select("lat", "lon").unionByName(segments.select(F.col("lat2").alias("lat"), F.col("lon2").alias("lon"))).unionByName(
        todo.select("lat", "lon")
    ).agg(F.min("lat").alias("a"), F.max("lat").alias("b"), F.min("lon").alias("c"), F.max("lon").alias("d")).first()
    if box is None or box["a"] is None:
        return todo.select(key, *[F.lit(None).cast("double").alias(c) for c in ("snap_lat", "snap_lon", "snap_d2")])
    reach = max(box["b"] - box["a"], box["d"] - box["c"])
    done = None
    size = cell
    while True:
        last = size > reach

        def lane(c: str, side: int, size: float = size):
            return (F.floor(F.col(c) / F.lit(size)) + side).cast("bigint")

        def span(a: str, b: str):
            return F.sequence(F.least(lane(a, -1), lane(b, -1)), F.greatest(lane(a, 1), lane(b, 1)))

        placed = todo.withColumns({"_y": lane("lat", 0), "_x": lane("lon", 0)})
        grid = (
            segments.withColumn("_y", F.explode(span("lat", "lat2")))
            .withColumn("_x", F.explode(span("lon", "lon2")))
            .select("_x", "_y", "way_id", "point", F.col("lat").alias("_ay"), F.col("lon").alias("_ax"),
                    F.col("lat2").alias("_by"), F.col("lon2").alias("_bx"))
        )
        grid = durable(grid.join(placed.select("_x", "_y").distinct(), ["_x", "_y"], "left_semi"))
        x, y = G.project_on_segment(*[F.col(c) for c in ("lon", "lat", "_ax", "_ay", "_bx", "_by")])
        gap = F.pow(F.col("lon") - x, 2) + F.pow(F.col("lat") - y, 2)
        least = placed.join(grid, ["_x", "_y"]).select(key, gap.alias("d")).groupBy(key).agg(F.min("d").alias("_least"))
        if not last:
            least = least.filter(F.col("_least") <= size * size)
        least = least.withColumnRenamed(key, "_key")
        near = placed.join(least, F.col(key).eqNullSafe(F.col("_key"))).drop("_key").join(grid, ["_x", "_y"])
        pairs = near.filter(gap <= F.col("_least")).select(key, "way_id", "point", x.alias("x"), y.alias("y"), gap.alias("d"))
        best = pairs.groupBy(key).agg(F.min(F.struct("d", "way_id", "point", "x", "y")).alias("m"))
        best = durable(
            best.select(key, F.col("m.y").alias("snap_lat"), F.col("m.x").alias("snap_lon"), F.col("m.d").alias("snap_d2"))
        )
        done = best if done is None else done.unionByName(best)
        if last:
            return done
        todo = durable(todo.join(best.select(key), key, "left_anti"))
        if todo.isEmpty():
            return done
        size *= 4


def snapped(events: DataFrame, segments: DataFrame, **kw) -> DataFrame:
    """Events moved onto the road network; those without coordinates stay as they are."""
    near = snap_to_road(events, segments, **kw)
    out = events.join(near, "event_id", "left")
    return out.withColumns({"lat": F.coalesce("snap_lat", "lat"), "lon": F.coalesce("snap_lon", "lon")}).drop(
        "snap_lat", "snap_lon", "snap_d2"
    )


def mapped_events(events: DataFrame, located: DataFrame) -> DataFrame:
    """Fill missing coordinates only, drop events without any; the sub-type stands in for an empty description."""
    found = located.select("event_id", F.col("lat").alias("_lat"), F.col("lon").alias("_lon"))
    out = events.join(found, "event_id", "left").withColumns(
        {"lat": F.coalesce("lat", "_lat"), "lon": F.coalesce("lon", "_lon"),
         "description": F.coalesce(S.clean_text(F.col("description")), S.clean_text(F.col("subtype")), F.lit(""))}
    )
    return out.drop("_lat", "_lon").filter(F.col("lat").isNotNull() & F.col("lon").isNotNull())


def density_grid(events: DataFrame, digits: int = 3) -> DataFrame:
    nudge = F.lit(1e-9)
    return events.groupBy(
        F.round(F.col("lat") + nudge, digits).alias("lat"), F.round(F.col("lon") + nudge, digits).alias("lon")
    ).agg(F.count(F.lit(1)).alias("n"))
