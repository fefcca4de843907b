"""Exact nearest neighbours inside groups, over pivot cells with triangle-inequality bounds.

Rows at one place become one point that keeps the few smallest ids, so copies of a row cost nothing more. Every
point belongs to the cell of its nearest pivot. Within its own cell and from the pivots a point learns how far its
k-th neighbour lies at most; it then visits only those other cells that can hold a point that near: the cell's
ball must reach into the point's, and the border half way between the two pivots must not lie beyond it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tollspan.session import durable

#: Points a cell should have; pivots of one group at most (their list goes to every task).
CELL_POINTS, MOST_PIVOTS = 1000, 2048
#: Bounds give way by this share, so rounding cannot hide a neighbour.
_SLACK = 1e-9


@dataclass
class Pivots:
    """Pivots by group, and once the cells are filled their radii and sizes."""

    at: dict
    radius: dict
    blocks: dict


def matrix(x: pd.Series) -> np.ndarray:
    return np.stack(x.to_numpy()).astype(float) if len(x) else np.empty((0, 0))


def _gaps(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Euclidean distances, one row of `x` at a time: no cancellation, equal places are at exactly 0."""
    return np.stack([np.sqrt(((y - v) ** 2).sum(axis=1)) for v in x]) if len(x) else np.empty((0, len(y)))


def _points(rows: DataFrame, keep: int) -> DataFrame:
    """`group, pid, x, ids`: distinct places with their `keep` smallest ids; the smallest names the point."""
    first = Window.partitionBy("group", "x").orderBy("id")
    few = rows.withColumn("_n", F.row_number().over(first)).filter(F.col("_n") <= keep)
    return few.groupBy("group", "x").agg(F.sort_array(F.collect_list("id")).alias("ids")).select("group", F.col("ids")[0].alias("pid"), "x", "ids")


def choose_pivots(points: DataFrame) -> Pivots:
    sizes = points.groupBy("group").agg(F.count(F.lit(1)).alias("_size"))
    order = Window.partitionBy("group").orderBy(F.xxhash64("pid", F.lit(3)), "pid")
    wanted = F.least(F.ceil(F.col("_size") / CELL_POINTS), F.lit(MOST_PIVOTS))
    # a hash below twice the wanted share, so that the ranking sees few rows of a large group
    share = F.pmod(F.xxhash64("pid", F.lit(3)), F.lit(1 << 20)) / (1 << 20)
    few = points.join(sizes, "group").filter((F.col("_size") <= 16 * CELL_POINTS) | (share * F.col("_size") <= 2 * wanted + 64))
    chosen = few.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= wanted).select("group", "x").collect()
    at: dict = {}
    for r in chosen:
        at.setdefault(r["group"], []).append(r["x"])
    return Pivots({g: np.array(v, float) for g, v in at.items()}, {}, {})


def _parts(frames: Iterator[pd.DataFrame]) -> Iterator[tuple]:
    """`(group, rows)` with at most 1,024 rows, so that their distances to all pivots stay small."""
    for frame in frames:
        for group, part in frame.groupby("group", sort=False):
            for at in range(0, len(part), 1024):
                yield group, part.iloc[at : at + 1024]


def assigned(points: DataFrame, pivots: Pivots) -> DataFrame:
    def assign(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for group, part in _parts(frames):
            d = _gaps(matrix(part["x"]), pivots.at[group])
            cell = d.argmin(axis=1)
            yield part.assign(cell=cell.astype(np.int32), far=d[np.arange(len(d)), cell])

    return durable(points.mapInPandas(assign, f"{_ddl(points)}, cell int, far double"))


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)


def visits(points: DataFrame, pivots: Pivots, k: int | None, own: bool) -> DataFrame:
    """Points with the cells to visit: their own, or all others that the distance `reach` does not rule out.

    With `k` the pivots bound that distance: they are points too, and the k-th other one is no nearer than the k-th
    neighbour. Without, `reach` stands as it is.
    """

    def visit(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        apart: dict = {}  # distances between the pivots of a group
        for group, part in _parts(frames):
            pivot, radius, blocks = pivots.at[group], pivots.radius[group], pivots.blocks[group]
            x, cell = matrix(part["x"]), part["cell"].to_numpy()
            if own:
                reach = np.full(len(part), np.inf)
                going = np.zeros((len(part), len(pivot)), bool)
                going[np.arange(len(part)), cell] = True
            else:
                d = _gaps(x, pivot)
                reach = part["reach"].to_numpy()
                if k and d.shape[1] >= k:
                    other = np.sort(np.where(d > 0, d, np.inf), axis=1)
                    reach = np.minimum(reach, other[:, k - 1])
                soft = reach * (1 + _SLACK)
                going = d - radius[None, :] <= soft[:, None]
                if group not in apart:
                    apart[group] = _gaps(pivot, pivot)
                between = apart[group][cell]
                mine = d[np.arange(len(d)), cell][:, None]
                with np.errstate(divide="ignore", invalid="ignore"):
                    border = (d**2 - mine**2) / (2 * between)
                going &= ~(border > soft[:, None] + _SLACK * (1 + mine))
                going[np.arange(len(part)), cell] = False
            who, to = np.nonzero(going)
            times = blocks[to]
            who, to = np.repeat(who, times), np.repeat(to, times)
            block = np.concatenate([np.arange(b) for b in times]) if len(times) else np.empty(0, int)
            out = part.iloc[who][["group", "pid", "x"]]
            yield out.assign(cell=to.astype(np.int32), block=block.astype(np.int32), reach=reach[who])

    kind = dict(points.dtypes)
    return points.mapInPandas(visit, f"group {kind['group']}, pid bigint, x array<double>, cell int, block int, reach double")


def _near(visits: DataFrame, held: DataFrame, k: int) -> DataFrame:
    """`group, pid, d, near, ids`: of each cell visited the k nearest points within reach."""

    def closest(key: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        who, gaps, near = [], [], []
        if len(a) and len(b):
            y, ids = matrix(b["x"]), b["pid"].to_numpy()
            for x, pid, reach in zip(a["x"], a["pid"], a["reach"], strict=True):
                d = np.sqrt(((y - np.asarray(x, float)) ** 2).sum(axis=1))
                fit = np.flatnonzero((d <= reach * (1 + _SLACK)) & (ids != pid))
                if len(fit) > k:
                    fit = fit[d[fit] <= np.partition(d[fit], k - 1)[k - 1]]
                    fit = fit[np.lexsort((ids[fit], d[fit]))][:k]
                who.append(np.full(len(fit), pid))
                gaps.append(d[fit])
                near.append(fit)
        at = np.concatenate([*near, np.empty(0, np.int64)]).astype(np.int64)
        return pd.DataFrame(
            {
                "group": pd.Series([key[0]] * len(at), dtype=object),
                "pid": np.concatenate([*who, np.empty(0, np.int64)]).astype(np.int64),
                "d": np.concatenate([*gaps, np.empty(0)]),
                "near": b["pid"].to_numpy()[at].astype(np.int64),
                "ids": pd.Series(list(b["ids"].to_numpy()[at]), dtype=object),
            }
        )

    kind = dict(held.dtypes)["group"]
    names = ["group", "cell", "block"]
    return visits.groupBy(*names).cogroup(held.groupBy(*names)).applyInPandas(
        closest, f"group {kind}, pid bigint, d double, near bigint, ids array<bigint>"
    )


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("group", "pid").orderBy("d", "near")
    return found.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= k)


def dealt(placed: DataFrame, pivots: Pivots) -> DataFrame:
    """The points with `block`: a cell of more than 4 * CELL_POINTS is cut. Fills in the cells' radii and blocks."""
    for r in placed.groupBy("group", "cell").agg(F.max("far").alias("far"), F.count(F.lit(1)).alias("n")).collect():
        cells = len(pivots.at[r["group"]])
        pivots.radius.setdefault(r["group"], np.full(cells, -np.inf))[r["cell"]] = r["far"]
        pivots.blocks.setdefault(r["group"], np.zeros(cells, int))[r["cell"]] = -(-r["n"] // (4 * CELL_POINTS))
    # at most one cell for each 4 * CELL_POINTS points is in the list
    cuts = placed.sparkSession.createDataFrame(
        [(g, c, int(n)) for g, b in pivots.blocks.items() for c, n in enumerate(b) if n > 1],
        f"group {dict(placed.dtypes)['group']}, cell int, cuts int",
    )
    block = F.pmod(F.xxhash64("pid", F.lit(7)), F.coalesce("cuts", F.lit(1))).cast("int")
    return placed.join(cuts, ["group", "cell"], "left").withColumn("block", block).drop("cuts")


def nearest(rows: DataFrame, k: int) -> DataFrame:
    """`group, id, rank, near_id, d`: for each row `(group, id, x)` the k nearest other rows of its group.

    Distance is Euclidean over the array `x`, equal distances by the smaller id, rank from 0; a group with fewer
    others gives them all. Ids are whole numbers and stand once in a group. Rows with a null id, group or array
    take no part. Work grows with the rows and the cells that their balls touch; copies of a row share one point.
    """
    rows = rows.select("group", F.col("id").cast("bigint").alias("id"), "x").dropna()
    points = durable(_points(rows, k + 1))
    pivots = choose_pivots(points)
    if not pivots.at:
        return rows.select("group", "id", F.lit(0).alias("rank"), F.col("id").alias("near_id"), F.lit(0.0).alias("d")).limit(0)
    placed = assigned(points, pivots)
    held = dealt(placed, pivots)
    at_home = durable(_near(visits(placed, pivots, k, own=True), held, k))
    # k points hold k ids at least, so the k-th of them is as far as the k-th neighbour can be
    home = _best(at_home, k).groupBy("group", "pid").agg(F.max("d").alias("d"), F.count(F.lit(1)).alias("n"))
    known = placed.join(home, ["group", "pid"], "left").withColumn("reach", F.when(F.col("n") >= k, F.col("d")).otherwise(float("inf")))
    away = _near(visits(known.drop("d", "n"), pivots, k, own=False), held, k)
    near = _best(at_home.unionByName(away), k).select("group", "pid", "d", F.explode("ids").alias("near_id"))
    same = points.select("group", "pid", F.lit(0.0).alias("d"), F.explode("ids").alias("near_id"))
    lists = near.unionByName(same).groupBy("group", "pid").agg(
        F.slice(F.sort_array(F.collect_list(F.struct("d", "near_id"))), 1, (k + 1) * (k + 1)).alias("s")
    )  # at most (k + 1) ids of each of k + 1 points
    of = rows.join(points.select("group", "x", "pid"), ["group", "x"]).select("group", "id", "pid")
    own = F.slice(F.filter("s", lambda p: p["near_id"] != F.col("id")), 1, k)
    return (
        of.join(lists, ["group", "pid"])
        .select("group", "id", F.posexplode(own).alias("rank", "p"))
        .select("group", "id", "rank", F.col("p.near_id").alias("near_id"), F.col("p.d").alias("d"))
    )
