"""Quality by a sparse ensemble of rules over text statistics.

Boosted trees over the statistics of labelled documents are taken apart: every path from a root to a node is a
rule, a conjunction of bounds. A lasso logistic regression keeps few of the rules and weighs them. The kept ones
become Spark column expressions over the statistics, which are column expressions themselves, so scoring is one
pass over the texts without Python.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tollspan.llm.common import free_name, remainder, table

#: Labelled documents of either class that are fitted on, at most.
SAMPLE_DOCS = 3000
TREES, DEPTH, RATE, CUTS = 40, 3, 0.1, 24
#: Lasso penalties tried, as shares of the one that leaves no rule.
PENALTIES = tuple(10 ** (-i / 4) for i in range(1, 13))
SEED = 11


def statistics(text: Column) -> dict[str, Column]:
    """Statistics of a whole text by name; shares of nothing are 0."""
    words = F.array_remove(F.split(text, "[ \\t-\\r]+"), "")
    lines = F.array_remove(F.split(text, "\\n"), "")
    chars = F.greatest(F.length(text), F.lit(1)).cast("double")

    def left(pattern: str) -> Column:
        """How many characters remain when those of the pattern are taken out."""
        return F.length(F.regexp_replace(text, pattern, "")).cast("double")

    return {
        "words": F.size(words).cast("double"),
        "distinct_words": F.size(F.array_distinct(words)).cast("double"),
        "lines": F.size(lines).cast("double"),
        "distinct_lines": F.size(F.array_distinct(lines)).cast("double"),
        "chars": F.length(text).cast("double"),
        "capitals": left("[^A-Z]+") / chars,
        "digits": left("[^0-9]+") / chars,
        "symbols": left("[^#$%&*|<>{}\\[\\]\\\\^~_=+@/]+") / chars,
        "marks": left("[^!?]+") / chars,
        "stops": left("[^.,;:]+") / chars,
        "beyond_ascii": left("[\\x00-\\x7F]+") / chars,
    }


def features(of: dict[str, Column]) -> dict[str, Column]:
    """Features by name, in the order of FEATURES, from columns that hold the statistics."""

    def share(a: str, b: str) -> Column:
        return of[a] / F.greatest(of[b], F.lit(1.0))

    made = [
        F.log1p(of["words"]),
        share("distinct_words", "words"),
        share("chars", "words"),
        share("words", "lines"),
        share("distinct_lines", "lines"),
        *[of[x] for x in FEATURES[5:]],
    ]
    return dict(zip(FEATURES, made, strict=True))


FEATURES = (
    "log_words", "distinct_word_share", "chars_a_word", "words_a_line", "distinct_line_share",
    "capitals", "digits", "symbols", "marks", "stops", "beyond_ascii",
)

#: A rule: bounds `(feature, above, cut)`, all of which hold: value > cut if above, else value <= cut.
Rule = tuple[tuple[int, bool, float], ...]


def holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for f, above, cut in rule:
        out &= (x[:, f] > cut) if above else (x[:, f] <= cut)
    return out


def _simple(path: list[tuple[int, bool, float]]) -> Rule:
    """The tightest bound of each feature and side, in a fixed order."""
    best: dict[tuple[int, bool], float] = {}
    for f, above, cut in path:
        old = best.get((f, above), cut)
        best[f, above] = max(old, cut) if above else min(old, cut)
    return tuple((f, above, cut) for (f, above), cut in sorted(best.items()))


def _split(x: np.ndarray, cuts: list[np.ndarray], slope: np.ndarray, bend: np.ndarray, rows: np.ndarray) -> tuple[int, float] | None:
    """The bound that gains most at a node, by sums of slopes and bends on either side."""
    best, gain = None, 1e-9
    s, b = slope[rows].sum(), bend[rows].sum()
    for f, at in enumerate(cuts):
        if not len(at):
            continue
        place = np.searchsorted(at, x[rows, f], "left")  # how many cuts lie below the value
        ls = np.cumsum(np.bincount(place, slope[rows], len(at) + 1))[:-1]
        lb = np.cumsum(np.bincount(place, bend[rows], len(at) + 1))[:-1]
        n = np.cumsum(np.bincount(place, minlength=len(at) + 1))[:-1]
        gains = ls**2 / (lb + 1) + (s - ls) ** 2 / (b - lb + 1) - s**2 / (b + 1)
        gains[(n < 5) | (len(rows) - n < 5)] = -1
        i = int(np.argmax(gains))
        if gains[i] > gain:
            best, gain = (f, float(at[i])), gains[i]
    return best


def tree_rules(x: np.ndarray, y: np.ndarray, weight: np.ndarray, trees: int = TREES, depth: int = DEPTH, seed: int = SEED) -> list[Rule]:
    """Rules on the way to every node but the root of boosted trees, each grown on a random half of the rows."""
    rng = np.random.default_rng(seed)
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, CUTS + 2)[1:-1], method="lower")) for c in x.T]
    cuts = [c[c < col.max()] for c, col in zip(cuts, x.T, strict=True)]
    level, rules = np.zeros(len(y)), {}
    for _ in range(trees):
        p = 1 / (1 + np.exp(-level))
        slope, bend = weight * (y - p), weight * p * (1 - p)
        some = np.flatnonzero(rng.random(len(y)) < 0.5)
        open_nodes: list[list] = [[]]
        for step in range(depth + 1):
            below: list[list] = []
            for path in open_nodes:
                rule = _simple(path)
                inside = holds(rule, x)
                rows = some[inside[some]]
                found = _split(x, cuts, slope, bend, rows) if step < depth and len(rows) >= 10 else None
                if path:
                    rules[rule] = None
                if found is None:
                    own = inside
                    level = level + np.where(own, RATE * slope[rows].sum() / (bend[rows].sum() + 1), 0)
                else:
                    below += [[*path, (found[0], side, found[1])] for side in (False, True)]
            open_nodes = below
    return list(rules)


def lasso(z: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float, start: np.ndarray | None = None, rounds: int = 2000) -> np.ndarray:
    """Weights (the last one free of the penalty) that minimise the mean logistic loss plus `penalty` times their sizes."""
    z = np.c_[z, np.ones(len(z))]
    weight = weight / weight.sum()
    length = 0.25 * np.linalg.norm(z * np.sqrt(weight)[:, None], 2) ** 2 + 1e-12
    beta = np.zeros(z.shape[1]) if start is None else start.copy()
    ahead, t = beta.copy(), 1.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ ahead, -30, 30)))
        new = ahead + z.T @ (weight * (y - p)) / length
        new[:-1] = np.sign(new[:-1]) * np.maximum(np.abs(new[:-1]) - penalty / length, 0)
        t_new = (1 + (1 + 4 * t * t) ** 0.5) / 2
        if np.dot(ahead - new, new - beta) > 0:  # start the momentum anew where it leads up
            t_new = 1.0
        ahead = new + (t - 1) / t_new * (new - beta)
        done = np.abs(new - beta).max() < 1e-7
        beta, t = new, t_new
        if done:
            break
    return beta


def _loss(z: np.ndarray, y: np.ndarray, weight: np.ndarray, beta: np.ndarray) -> float:
    level = z @ beta[:-1] + beta[-1]
    return float((weight * (np.logaddexp(0, level) - y * level)).sum() / weight.sum())


@dataclass
class RuleEnsemble:
    rules: list[Rule]
    weights: np.ndarray
    constant: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        level = np.full(len(x), self.constant)
        for rule, w in zip(self.rules, self.weights, strict=True):
            level += w * holds(rule, x)
        return 1 / (1 + np.exp(-level))

    def column(self, of: dict[str, Column]) -> Column:
        """The score as an expression over columns that hold the features."""
        level = F.lit(float(self.constant))
        for rule, w in zip(self.rules, self.weights, strict=True):
            bounds = F.lit(True)
            for f, above, cut in rule:
                value = of[FEATURES[f]]
                bounds = bounds & ((value > cut) if above else (value <= cut))
            level = level + F.when(bounds, F.lit(float(w))).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-level))

    def __str__(self) -> str:
        said = []
        for rule, w in zip(self.rules, self.weights, strict=True):
            said.append(f"{w:+.3f} if " + " and ".join(f"{FEATURES[f]} {'>' if above else '<='} {cut:.4g}" for f, above, cut in rule))
        return "\n".join([f"{self.constant:+.3f}", *said])


def fit_rules(x: np.ndarray, y: np.ndarray, share: float, seed: int = SEED) -> RuleEnsemble:
    """Trees and lasso on three quarters of the rows; the rest chooses the penalty. Classes weigh as `share` says.

    Of the penalties whose loss on the rest is within 2 % of the best, the largest (fewest rules) counts.
    """
    weight = np.where(y == 1, share / max(1, (y == 1).sum()), (1 - share) / max(1, (y != 1).sum())) * len(y)
    part = np.random.default_rng(seed).permutation(len(y)) % 4 == 0
    train = ~part
    rules = tree_rules(x[train], y[train], weight[train], seed=seed)
    seen: dict[bytes, Rule] = {}
    for rule in sorted(rules, key=lambda r: (len(r), r)):  # of rules with the same rows the shortest stays
        inside = holds(rule, x[train])
        if 0 < inside.sum() < len(inside):
            seen.setdefault(inside.tobytes(), rule)
    rules = list(seen.values())
    z = np.array([holds(r, x) for r in rules], float).reshape(-1, len(x)).T
    mean = np.average(y[train], weights=weight[train])
    most = np.abs(z[train].T @ (weight[train] * (y[train] - mean))).max(initial=0) / weight[train].sum()
    found, beta = [], None
    for factor in PENALTIES:
        beta = lasso(z[train], y[train], weight[train], most * factor, beta)
        found.append((_loss(z[part], y[part], weight[part], beta), beta))
    best = min(loss for loss, _ in found)
    beta = next(b for loss, b in found if loss <= best * 1.02 + 1e-4)
    kept = np.flatnonzero(np.abs(beta[:-1]) > 1e-9)
    return RuleEnsemble([rules[i] for i in kept], beta[kept], float(beta[-1]))


def _with_features(docs: DataFrame, text_col: str) -> tuple[DataFrame, dict[str, Column]]:
    """`docs` with columns for statistics and features, and the latter by name.

    They are columns of their own, not expressions inside one another, so Catalyst computes each once a row.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    counts = {n: (free_name(docs.columns, f"_count_{n}"), c) for n, c in statistics(text).items()}
    counted = docs.withColumns(dict(counts.values()))
    made = {n: (free_name(counted.columns, f"_feature_{n}"), c) for n, c in features({n: F.col(x) for n, (x, _) in counts.items()}).items()}
    return counted.withColumns(dict(made.values())), {n: F.col(x) for n, (x, _) in made.items()}


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
        sample_docs: int = SAMPLE_DOCS) -> RuleEnsemble | float:
    """Ensemble from at most `sample_docs` labelled documents of either class, in the order of a hash of the id.

    Only their features come to the driver. A document with two labels takes the larger, one with two texts the
    smaller; null labels and ids teach nothing. Where a class is missing, there is no ensemble but the share of
    label 1 (0.0 without labels).
    """
    marked = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(id_col).agg(F.max(label_col).alias("y"))
    share = marked.agg(F.avg((F.col("y") == 1).cast("double"))).first()[0]
    if not share or share == 1.0:
        return share or 0.0
    order = F.xxhash64(id_col), F.col(id_col)
    few = marked.filter("y = 1").orderBy(*order).limit(sample_docs).unionByName(marked.filter("y != 1").orderBy(*order).limit(sample_docs))
    met = (
        docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
        .join(F.broadcast(few.select(F.col(id_col).alias("id"), "y")), "id")  # at most 2 * sample_docs ids
        .groupBy("id")
        .agg(F.min("text").alias("text"), F.max("y").alias("y"))
    )
    featured, of = _with_features(met, "text")
    rows = featured.select("id", (F.col("y") == 1).cast("double").alias("y"), *[c.alias(n) for n, c in of.items()]).toPandas()
    rows = rows.sort_values("id")
    x, y = rows[list(FEATURES)].to_numpy(float), rows["y"].to_numpy()
    if len(set(y.tolist())) < 2:
        return share
    return fit_rules(x, y, share)


def with_quality(docs: DataFrame, model: RuleEnsemble | float, text_col: str = "text", name: str = "score") -> DataFrame:
    """`docs` with a column `name`: score from 0 to 1 of the whole text, null as empty. All columns stay."""
    if isinstance(model, float):
        return docs.withColumn(name, F.lit(model))
    featured, of = _with_features(docs, text_col)
    return featured.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() != name.lower()], model.column(of).alias(name))


def op13_rule_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document; repeated and null ids and empty texts get a row like any other."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = fit(docs, labels.filter(remainder("doc_id", 5) != 0))
    return with_quality(docs.select("doc_id", "text"), model).select(
        "doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted")
    )
