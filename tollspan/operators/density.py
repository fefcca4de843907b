"""Density clustering by neighbours within a distance, with noise as -1.

Points of one place are one point with a weight. Points lie in pivot cells, and a point meets only the cells that can
hold another within `eps`. Inside a block of a cell the core points are joined first, so a point sends one link
for each group it touches there and never one for each neighbour.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tollspan.operators import nearest
from tollspan.session import durable
from tollspan.skew import running_totals

_PLACE = ["group", "cell", "block"]


def _gaps_to(y: np.ndarray, x) -> np.ndarray:
    return np.sqrt(((y - np.asarray(x, float)) ** 2).sum(axis=1))


def _weights_near(seen: DataFrame, held: DataFrame, eps: float) -> DataFrame:
    """`pid, weight`: rows within `eps` of each point, itself included."""

    def count(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"pid": np.empty(0, np.int64), "weight": np.empty(0, np.int64)})
        y, n = nearest.matrix(b["x"]), b["n"].to_numpy()
        return pd.DataFrame({"pid": a["pid"], "weight": [int(n[_gaps_to(y, x) <= eps].sum()) for x in a["x"]]})

    found = seen.groupBy(*_PLACE).cogroup(held.groupBy(*_PLACE)).applyInPandas(count, "pid bigint, weight bigint")
    return found.groupBy("pid").agg(F.sum("weight").alias("weight"))


def _joined_inside(core: DataFrame, eps: float) -> DataFrame:
    """Core points with `knot`, the smallest pid of those they reach in steps of `eps` inside their block."""

    def join(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("pid", ignore_index=True)
        y = nearest.matrix(block["x"])
        knot = np.full(len(block), -1)
        for first in range(len(block)):
            if knot[first] >= 0:
                continue
            knot[first] = first
            todo = [first]
            while todo:
                near = np.flatnonzero((knot < 0) & (_gaps_to(y, y[todo.pop()]) <= eps))
                knot[near] = first
                todo += near.tolist()
        return block.assign(knot=block["pid"].to_numpy()[knot])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in core.schema.fields)
    return core.groupBy(*_PLACE).applyInPandas(join, f"{kept}, knot bigint")


def _touched(seen: DataFrame, knots: DataFrame, eps: float) -> DataFrame:
    """`pid, knot, d`: the nearest core point within `eps` of each group of core points in a block."""

    def touch(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        who, to, gap = [], [], []
        if len(a) and len(b):
            b = b.sort_values("knot", ignore_index=True)
            y, knot = nearest.matrix(b["x"]), b["knot"].to_numpy()
            starts = np.flatnonzero(np.r_[True, knot[1:] != knot[:-1]])
            for x, pid in zip(a["x"], a["pid"], strict=True):
                least = np.minimum.reduceat(_gaps_to(y, x), starts)
                some = least <= eps
                who.append(np.full(some.sum(), pid))
                to.append(knot[starts][some])
                gap.append(least[some])
        none = np.empty(0, np.int64)
        return pd.DataFrame(
            {"pid": np.concatenate([*who, none]).astype(np.int64), "knot": np.concatenate([*to, none]).astype(np.int64), "d": np.concatenate([*gap, np.empty(0)])}
        )

    return seen.groupBy(*_PLACE).cogroup(knots.groupBy(*_PLACE)).applyInPandas(touch, "pid bigint, knot bigint, d double")


def density_level(
    scaled: DataFrame, key: str, *, eps: float = 0.5, min_samples: int = 10, min_cluster_size: int = 20
) -> DataFrame:
    """`key, cluster_label`: density clusters at one level.

    A row with `min_samples` rows within `eps` of its array `x`, itself included, is core. Core rows within `eps` of one
    another belong together over any number of steps; another row belongs to the nearest core row within
    `eps` (ties: the cluster with the smallest key). All others, and the rows of clusters with fewer than
    `min_cluster_size`, are noise, -1. Clusters are numbered by size, then by their smallest key. Only distances
    count, so moving all rows alike changes nothing. Keys stand once; null arrays are noise.
    """
    from tollspan.operators.cluster import connected

    rows = scaled.select(F.col(key).alias("key"), "x")
    places = rows.filter("x IS NOT NULL").groupBy("x").agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("first"))
    # numbers are given once and written, so they stay as they are whatever is worked out again
    points = durable(places.select(F.lit(0).alias("group"), F.monotonically_increasing_id().alias("pid"), "x", "n", "first"))
    pivots = nearest.choose_pivots(points)
    if not pivots.at:
        return scaled.select(key, F.lit(-1).alias("cluster_label"))
    placed = nearest.assigned(points, pivots)
    held = durable(nearest.dealt(placed, pivots))
    reach = placed.select("group", "pid", "x", "cell", F.lit(float(eps)).alias("reach"))
    seen = durable(nearest.visits(reach, pivots, None, own=True).unionByName(nearest.visits(reach, pivots, None, own=False)))
    core = _weights_near(seen, held, eps).filter(F.col("weight") >= min_samples).select("pid")
    knots = durable(_joined_inside(held.join(core, "pid", "left_semi"), eps))
    touched = durable(_touched(seen, knots, eps))
    own = knots.select("pid", F.col("knot").alias("mine"))
    links = touched.join(own, "pid").filter("mine != knot").select(F.col("mine").alias("a"), F.col("knot").alias("b")).distinct()
    groups = connected(knots.select(F.col("knot").alias("id")).distinct(), links)
    names = knots.join(groups.withColumnRenamed("id", "knot"), "knot").groupBy("label").agg(F.min("first").alias("name"))
    of_knot = durable(groups.join(names, "label").select(F.col("id").alias("knot"), "name"))
    edge = touched.join(own, "pid", "left_anti").join(of_knot, "knot")
    border = edge.groupBy("pid").agg(F.min(F.struct("d", "name")).alias("b")).select("pid", F.col("b.name").alias("name"))
    member = durable(knots.join(of_knot, "knot").select("pid", "name").unionByName(border).join(points.select("pid", "x", "n"), "pid"))
    sizes = member.groupBy("name").agg(F.sum("n").alias("size")).filter(F.col("size") >= min_cluster_size)
    cells = sizes.withColumns({"_g": F.lit(1), "_one": F.lit(1), "_bucket": F.floor(F.log2("size"))})
    numbered = running_totals(cells, ["_g"], [F.desc("size"), F.asc("name")], {"at": "_one"}, bucket_desc=True)
    labels = member.join(numbered.select("name", (F.col("at") - 1).cast("int").alias("cluster_label")), "name").select("x", "cluster_label")
    return rows.join(labels, "x", "left").select(F.col("key").alias(key), F.coalesce("cluster_label", F.lit(-1)).alias("cluster_label"))
