"""Many forests at once: the trees of all sections, feature sets and trials grow together, level by level.

Features are binned once per group of rows (a section). A pass over the rows gives, for every open node of every
tree, the rows of either class by feature and bin; the counts are whole numbers, so their sum does not depend on
how the rows are dealt. Nodes are split from the summed counts, and the next pass looks one level deeper. A study
of any number of models takes as many passes as its deepest tree has levels.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bins of a feature; counts held by a task at a time, over all trees it works on.
BINS = 32
MOST_COUNTS = 1 << 26
#: How many times a row is drawn: shares of 0, 1, 2, ... draws from n of n.
_DRAWS = np.cumsum(np.exp(-1.0) / np.array([1, 1, 2, 6, 24, 120, 720, 5040], float))
_MIX = np.uint64(0x9E3779B97F4A7C15)


@dataclass
class Tree:
    """A tree as columns: of node i the feature and the last bin that goes left (-1: leaf), its children and counts."""

    feature: list[int] = field(default_factory=lambda: [-1])
    cut: list[int] = field(default_factory=lambda: [0])
    left: list[int] = field(default_factory=lambda: [-1])
    right: list[int] = field(default_factory=lambda: [-1])
    counts: list[tuple[int, int]] = field(default_factory=lambda: [(0, 0)])  # drawn rows of class 0 and 1
    gain: list[float] = field(default_factory=lambda: [0.0])
    open: list[int] = field(default_factory=lambda: [0])

    def nodes(self, bins: np.ndarray) -> np.ndarray:
        """The leaf (so far) of each row."""
        feature, cut = np.array(self.feature), np.array(self.cut)
        left, right = np.array(self.left), np.array(self.right)
        at = np.zeros(len(bins), np.int64)
        while True:
            f = feature[at]
            inner = f >= 0
            if not inner.any():
                return at
            goes = bins[np.arange(len(bins)), np.maximum(f, 0)] <= cut[at]
            at = np.where(inner, np.where(goes, left[at], right[at]), at)


@dataclass
class Forest:
    """One model: the group whose rows it learns, its number among the group's models and how it grows.

    `weight` is that of a row of class 0 and of class 1. A row with a null model is shared by all models of its
    group, another one belongs to the model of that number.
    """

    group: int
    model: int
    features: list[int]
    n_trees: int
    max_depth: int
    weight: tuple[float, float] = (1.0, 1.0)
    seed: int = 42
    trees: list[Tree] = field(default_factory=list)

    def tries(self, tree: int, node: int) -> np.ndarray:
        """The features looked at in a node: a random square root of them, in ascending order."""
        n = max(1, int(np.ceil(np.sqrt(len(self.features)))))
        rng = np.random.default_rng([self.seed, tree, node])
        return np.sort(np.array(self.features)[rng.choice(len(self.features), n, replace=False)])

    def leaf_shares(self) -> list[np.ndarray]:
        """By tree the weighted share of class 1 in each node."""
        out = []
        for tree in self.trees:
            n = np.array(tree.counts, float) * self.weight
            out.append(n[:, 1] / np.maximum(n.sum(axis=1), 1e-300))
        return out

    def scores(self, bins: np.ndarray) -> np.ndarray:
        """Mean share of class 1 over the trees' leaves."""
        total = np.zeros(len(bins))
        for tree, share in zip(self.trees, self.leaf_shares(), strict=True):
            total += share[tree.nodes(bins)]
        return total / max(1, len(self.trees))

    def importance(self, n_features: int) -> np.ndarray:
        """Gain by feature, each tree's adding up to one, then all of them."""
        total = np.zeros(n_features)
        for tree in self.trees:
            own = np.zeros(n_features)
            for f, g in zip(tree.feature, tree.gain, strict=True):
                if f >= 0:
                    own[f] += g
            if own.sum() > 0:
                total += own / own.sum()
        return total / total.sum() if total.sum() > 0 else total


def draws(row_id: np.ndarray, seed: int, tree: int) -> np.ndarray:
    """How often a row is in a tree's sample: Poisson with mean 1 from a hash, the same wherever the row is."""
    salt = np.uint64((seed * 1_000_003 + tree * 7_919 + 1) & 0xFFFFFFFFFFFFFFFF)
    with np.errstate(over="ignore"):
        h = (row_id.astype(np.int64).view(np.uint64) ^ (salt * _MIX)) * _MIX
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
    return np.searchsorted(_DRAWS, (h >> np.uint64(11)) * 2.0**-53, "right")


def counts_of(forest: Forest, number: int, bins: np.ndarray, target: np.ndarray, row_id: np.ndarray) -> np.ndarray:
    """`[open node, tried feature, bin, class]`: drawn rows of a tree."""
    tree = forest.trees[number]
    tries = np.array([forest.tries(number, n) for n in tree.open])
    place = np.full(len(tree.feature), -1)
    place[tree.open] = np.arange(len(tree.open))
    times = draws(row_id, forest.seed, number)
    node = place[tree.nodes(bins)]
    some = (node >= 0) & (times > 0)
    node, bins, target, times = node[some], bins[some], target[some], times[some]
    width = tries.shape[1]
    value = bins[np.arange(len(bins))[:, None], tries[node]] if len(bins) else np.empty((0, width), np.int64)
    cell = ((node[:, None] * width + np.arange(width)) * BINS + value) * 2 + target[:, None]
    found = np.bincount(cell.ravel(), np.repeat(times, width), len(tree.open) * width * BINS * 2)
    return found.astype(np.int64).reshape(len(tree.open), width, BINS, 2)


def grow_level(forest: Forest, number: int, counts: np.ndarray, deepest: bool) -> None:
    """Close the open nodes of a tree: split each by its best bound, or let it be a leaf."""
    tree = forest.trees[number]
    still: list[int] = []
    for i, node in enumerate(tree.open):
        n = counts[i, 0].sum(axis=0)
        tree.counts[node] = (int(n[0]), int(n[1]))
        if deepest or not n.all():
            continue
        below = np.cumsum(counts[i], axis=1)[:, :-1] * np.array(forest.weight)
        whole = n * np.array(forest.weight)
        above = whole - below
        drawn = np.cumsum(counts[i].sum(axis=2), axis=1)[:, :-1]

        def pure(c: np.ndarray) -> np.ndarray:  # sum of squared shares times the weight
            return (c**2).sum(axis=-1) / np.maximum(c.sum(axis=-1), 1e-300)

        gain = pure(below) + pure(above) - pure(whole)
        gain[(drawn == 0) | (drawn == n.sum())] = -1
        best = int(np.argmax(gain))
        f, cut = divmod(best, BINS - 1)
        if gain.flat[best] <= 1e-12:
            continue
        tree.feature[node], tree.cut[node] = int(forest.tries(number, node)[f]), cut
        tree.gain[node] = float(gain.flat[best])
        for side in ("left", "right"):
            getattr(tree, side)[node] = len(tree.feature)
            still.append(len(tree.feature))
            part = counts[i, f, : cut + 1].sum(axis=0) if side == "left" else counts[i, f, cut + 1 :].sum(axis=0)
            for column, value in ((tree.feature, -1), (tree.cut, 0), (tree.left, -1), (tree.right, -1), (tree.gain, 0.0)):
                column.append(value)
            tree.counts.append((int(part[0]), int(part[1])))
    tree.open = still


def _rows_by_group(frames: Iterator[pd.DataFrame], columns: Sequence[str]) -> Iterator[tuple[int, dict]]:
    for frame in frames:
        for group, part in frame.groupby("group", sort=False):
            out = {c: part[c].to_numpy() for c in columns}
            out["bins"] = np.frombuffer(b"".join(part["bins"]), np.uint8).reshape(len(part), -1).astype(np.int64)
            yield int(group), out


def _mine(model: np.ndarray, number: int) -> np.ndarray:
    return np.isnan(model) | (model == number)


def _level(rows: DataFrame, open_forests: list[Forest], deepest_of: dict[tuple[int, int], bool]) -> None:
    """One pass over the rows for some forests of the same turn."""
    by_group: dict[int, list[Forest]] = {}
    for f in open_forests:
        by_group.setdefault(f.group, []).append(f)

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: dict[tuple[int, int, int], np.ndarray] = {}
        for group, part in _rows_by_group(frames, ("row_id", "target", "model")):
            model = part["model"].astype(float)
            for forest in by_group.get(group, ()):
                own = _mine(model, forest.model)
                bins, target, ids = part["bins"][own], part["target"][own].astype(np.int64), part["row_id"][own]
                for number, tree in enumerate(forest.trees):
                    if tree.open:
                        key = (group, forest.model, number)
                        counts = counts_of(forest, number, bins, target, ids)
                        found[key] = found[key] + counts if key in found else counts
        keys = list(found)
        yield pd.DataFrame(
            {
                "group": np.array([k[0] for k in keys], np.int32),
                "model": np.array([k[1] for k in keys], np.int32),
                "tree": np.array([k[2] for k in keys], np.int32),
                "counts": pd.Series([found[k].tobytes() for k in keys], dtype=object),
            }
        )

    def split(key: tuple, parts: pd.DataFrame) -> pd.DataFrame:
        group, model, number = key
        forest = next(f for f in by_group[group] if f.model == model)
        total = sum(np.frombuffer(c, np.int64) for c in parts["counts"])
        tree = forest.trees[number]
        grow_level(forest, number, total.reshape(len(tree.open), -1, BINS, 2), deepest_of[group, model])
        return pd.DataFrame({"group": [group], "model": [model], "tree": [number], "grown": [pickle.dumps(tree)]})

    grown = (
        rows.mapInPandas(count, "group int, model int, tree int, counts binary")
        .groupBy("group", "model", "tree")
        .applyInPandas(split, "group int, model int, tree int, grown binary")
        .collect()
    )
    of = {(f.group, f.model): f for f in open_forests}
    met = set()
    for r in grown:
        of[r["group"], r["model"]].trees[r["tree"]] = pickle.loads(bytes(r["grown"]))  # noqa: S301
        met.add((r["group"], r["model"], r["tree"]))
    for f in open_forests:  # a tree without any row stays one leaf
        for number, tree in enumerate(f.trees):
            if (f.group, f.model, number) not in met:
                tree.open = []


def _room(forest: Forest) -> int:
    return sum(len(t.open) * max(1, int(np.ceil(np.sqrt(len(forest.features))))) * BINS * 2 for t in forest.trees)


def grow(rows: DataFrame, forests: Sequence[Forest]) -> None:
    """Grow all forests in place over `rows` `(group int, row_id bigint, model int, target int, bins binary)`.

    `bins` holds one byte a feature, below BINS. Rows should be dealt so that a task sees few groups; a large group
    may lie in many tasks. Each task keeps counts for the open nodes it meets, MOST_COUNTS at most: where a
    level has more, it takes several passes. The driver holds the trees, never rows or counts.
    """
    for f in forests:
        f.trees = [Tree() for _ in range(f.n_trees)]
    level = 0
    while True:
        turn = [f for f in forests if any(t.open for t in f.trees)]
        if not turn:
            return
        while turn:
            part, room = [], 0
            while turn and (not part or room + _room(turn[0]) <= MOST_COUNTS):
                room += _room(turn[0])
                part.append(turn.pop(0))
            _level(rows, part, {(f.group, f.model): level >= f.max_depth for f in part})
        level += 1


def score_counts(rows: DataFrame, forests: Sequence[Forest]) -> DataFrame:
    """`group, model, part, score, pos, neg`: rows of either class by score of each of their group's models.

    Equal scores meet inside a task first; `rows` has a column `part` beside those of `grow`.
    """
    by_group: dict[int, list[Forest]] = {}
    for f in forests:
        by_group.setdefault(f.group, []).append(f)

    def scored(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for group, part in _rows_by_group(frames, ("target", "part")):
            for forest in by_group.get(group, ()):
                out = pd.DataFrame({"part": part["part"], "score": forest.scores(part["bins"]), "pos": part["target"] == 1, "neg": part["target"] == 0})
                yield (
                    out.groupby(["part", "score"], as_index=False)[["pos", "neg"]].sum()
                    .assign(group=np.int32(group), model=np.int32(forest.model))
                    .astype({"pos": "int64", "neg": "int64", "part": "int32"})[["group", "model", "part", "score", "pos", "neg"]]
                )

    found = rows.mapInPandas(scored, "group int, model int, part int, score double, pos bigint, neg bigint")
    return found.groupBy("group", "model", "part", "score").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))


def cut_points(rows: DataFrame, n_features: int) -> dict[int, list[np.ndarray]]:
    """By group the bounds between the bins of each feature of the array `x`: quantiles, without repeats.

    One aggregation over all rows; one list a group and feature comes back.
    """
    shares = [float(i) / BINS for i in range(1, BINS)]
    found = rows.groupBy("group").agg(*[F.percentile_approx(F.col("x")[i], shares, 2000).alias(f"q{i}") for i in range(n_features)])
    return {r["group"]: [np.unique(np.array(r[f"q{i}"] or [], float)) for i in range(n_features)] for r in found.collect()}


def with_bins(rows: DataFrame, cuts: dict[int, list[np.ndarray]]) -> DataFrame:
    """The rows with `bins` in place of `x`: one byte a feature, how many bounds lie below the value."""

    def put(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for group, part in frame.groupby("group", sort=False):
                x = np.stack(part["x"].to_numpy()).astype(float)
                b = np.stack([np.searchsorted(c, x[:, i], "left") for i, c in enumerate(cuts[group])], axis=1).astype(np.uint8)
                yield part.drop(columns="x").assign(bins=[row.tobytes() for row in b])

    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != "x"]
    return rows.mapInPandas(put, ", ".join([*kept, "bins binary"]))
