"""Driver types: scaling, K-means, Gaussian mixtures, density level, K choice."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from multiprocessing.pool import ThreadPool

import numpy as np
from pyspark import inheritable_thread_target
from pyspark.errors import IllegalArgumentException
from pyspark.ml.clustering import GaussianMixture, KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tollspan.functions import scalars as S
from tollspan.operators.clean import split_frequent, valid_rows
from tollspan.operators.explore import assignment_coverage
from tollspan.session import durable
from tollspan.skew import exact_quantiles

FEATURES = [
    "avg_speed_kmh",
    "avg_relative_speed",
    "avg_headway_s",
    "conflict_rate",
    "lane_prop_1",
    "lane_prop_2",
    "lane_change_rate",
]


# ---- scaling ---------------------------------------------------------------------------


def moments(df: DataFrame, features: Sequence[str]) -> dict[str, tuple[float, float]]:
    """Mean and population deviation per feature; a zero deviation counts as 1."""
    row = df.agg(
        *[F.avg(c).alias(f"m_{i}") for i, c in enumerate(features)],
        *[F.stddev_pop(c).alias(f"s_{i}") for i, c in enumerate(features)],
    ).first()
    return {c: (row[f"m_{i}"] or 0.0, row[f"s_{i}"] or 1.0) for i, c in enumerate(features)}


def scaled_array(stats: dict[str, tuple[float, float]]) -> Column:
    return F.array(*[(F.col(c) - F.lit(m)) / F.lit(s) for c, (m, s) in stats.items()])


def standardise(fit: DataFrame, df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Add array `x`: features scaled with the moments of `fit`."""
    return df.withColumn("x", scaled_array(moments(fit, features)))


def _vectors(df: DataFrame) -> DataFrame:
    return df.withColumn("v", array_to_vector("x"))


# ---- K-means ------------------------------------------------------------------------------


#: Fits that run at a time.
FITS_AT_ONCE = 8


def fit_kmeans(scaled: DataFrame, k: int, restarts: int = 10, seed: int = 42) -> np.ndarray:
    """Centroids of the cheapest of several fits, in ascending order."""
    if k == 1:
        d = len(scaled.select("x").first()["x"])
        return np.array([scaled.agg(*[F.avg(F.col("x")[j]) for j in range(d)]).first()], dtype=float)
    data = _vectors(scaled).select("v").persist()
    fits = _kmeans_fits(data, [(k, seed + i) for i in range(restarts)])
    data.unpersist()
    return _cheapest(fits)


def together(spark: SparkSession, calls: Sequence[Callable]) -> list:
    """Results of independent calls, several at a time.

    A fit is a chain of small jobs; one after the other, the cluster waits for the driver between any two of them.
    """
    with ThreadPool(max(1, min(FITS_AT_ONCE, len(calls)))) as pool:
        return pool.map(lambda call: call(), [inheritable_thread_target(spark)(c) for c in calls], chunksize=1)


def _kmeans_fits(data: DataFrame, jobs: Sequence[tuple[int, int]]) -> list[tuple[float, list]]:
    """Cost and centroids of the fit for each `(k, seed)`; `data` has a vector `v` and is persisted."""

    def fit(k: int, seed: int) -> tuple[float, list]:
        model = KMeans(k=k, featuresCol="v", seed=seed, maxIter=100).fit(data)
        return model.summary.trainingCost, model.clusterCenters()

    return together(data.sparkSession, [lambda k=k, seed=seed: fit(k, seed) for k, seed in jobs])


def _cheapest(fits: Sequence[tuple[float, list]]) -> np.ndarray:
    return np.array(sorted(map(tuple, min(fits, key=lambda f: f[0])[1])))


def nearest_centroid(df: DataFrame, centroids: np.ndarray) -> DataFrame:
    """Add `cluster_label` and `distance` to the nearest centroid of array `x`."""
    squared = [
        sum(((F.col("x")[j] - F.lit(float(v))) * (F.col("x")[j] - F.lit(float(v))) for j, v in enumerate(c)), F.lit(0.0))
        for c in centroids
    ]
    out = df.withColumn("_d", F.array(*squared))
    return out.withColumns(
        {
            "cluster_label": (F.array_position("_d", F.array_min("_d")) - 1).cast("int"),
            "distance": F.sqrt(F.array_min("_d")),
        }
    ).drop("_d")


def label_plates(
    frequent: DataFrame, rare: DataFrame, features: Sequence[str], centroids: np.ndarray, percentile: float = 95.0
) -> tuple[DataFrame, float]:
    """Nearest centroid for all; a rare plate beyond the frequent plates' distance percentile is -1."""
    near = nearest_centroid(standardise(frequent, frequent, features), centroids)
    limit = exact_quantiles(near, [], "distance", {"q": percentile / 100}).first()["q"]
    other = nearest_centroid(standardise(frequent, rare, features), centroids)
    unknown = F.when(F.col("distance") > limit, F.lit(-1)).otherwise(F.col("cluster_label"))
    both = near.withColumn("is_rare", F.lit(False)).unionByName(
        other.withColumn("cluster_label", unknown).withColumn("is_rare", F.lit(True))
    )
    return both.withColumnRenamed("distance", "confidence_score").drop("x"), limit


def kmeans_labels(
    plates: DataFrame, features: Sequence[str], k: int, *, percentile: float = 95.0, restarts: int = 10, seed: int = 42, **limits
) -> DataFrame:
    """K-means on frequent plates, distance-checked labels for rare ones."""
    rows = valid_rows(plates, features)
    frequent, rare = split_frequent(rows, **limits)
    centroids = fit_kmeans(standardise(frequent, frequent, features), k, restarts, seed)
    return label_plates(frequent, rare, features, centroids, percentile)[0]


# ---- quality -------------------------------------------------------------------------------


def separation(df: DataFrame, label: str = "cluster_label") -> DataFrame:
    """Davies-Bouldin and Calinski-Harabasz of labelled arrays `x`, from grouped sums.

    Only one row per cluster reaches the driver.
    """
    d = len(df.select("x").first()["x"])
    rows = df.groupBy(label).agg(
        F.count(F.lit(1)).alias("n"), *[F.avg(F.col("x")[j]).alias(f"m{j}") for j in range(d)]
    ).orderBy(label).collect()
    centre = {r[label]: np.array([r[f"m{j}"] for j in range(d)]) for r in rows}
    size = {r[label]: r["n"] for r in rows}
    n, k = sum(size.values()), len(rows)
    own = F.create_map(*[x for l, c in centre.items() for x in (F.lit(l), F.array(*[F.lit(float(v)) for v in c]))])
    gap = F.aggregate(
        F.zip_with("x", F.try_element_at(own, F.col(label)), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v
    )
    spread = df.groupBy(label).agg(F.avg(F.sqrt(gap)).alias("s"), F.sum(gap).alias("w")).collect()
    s = {r[label]: r["s"] for r in spread}
    within = sum(r["w"] for r in spread)
    grand = sum(size[l] * centre[l] for l in centre) / n
    between = sum(size[l] * float(((centre[l] - grand) ** 2).sum()) for l in centre)
    worst = [
        max((s[a] + s[b]) / float(np.linalg.norm(centre[a] - centre[b])) for b in centre if b != a) for a in centre
    ] if k > 1 else []
    db = float(np.mean(worst)) if worst else None
    ch = float((between / (k - 1)) / (within / (n - k))) if k > 1 and n > k and within > 0 else None
    return df.sparkSession.createDataFrame(
        [(k, db, ch)], "k int, davies_bouldin double, calinski_harabasz double"
    )


def sweep_kmeans(scaled: DataFrame, ks: Sequence[int], restarts: int = 3, seed: int = 42) -> DataFrame:
    """Silhouette (squared Euclidean, linear time), Davies-Bouldin and Calinski-Harabasz per K."""
    data = _vectors(scaled).persist()
    v = data.select("v").persist()
    judge = ClusteringEvaluator(featuresCol="v", predictionCol="cluster_label", metricName="silhouette")
    jobs = [(k, seed + i) for k in ks if k > 1 for i in range(restarts)]
    fits = list(zip(jobs, _kmeans_fits(v, jobs)))
    v.unpersist()

    def judged(k: int) -> DataFrame:
        centroids = fit_kmeans(data, k) if k == 1 else _cheapest([f for (of, _), f in fits if of == k])
        near = nearest_centroid(data, centroids)
        return separation(near).withColumns({"k": F.lit(k), "silhouette": F.lit(float(judge.evaluate(near)))})

    out = None
    for row in together(data.sparkSession, [lambda k=k: judged(k) for k in ks]):
        out = row if out is None else out.unionByName(row)
    data.unpersist()
    return out


# ---- Gaussian mixture ------------------------------------------------------------------------


@dataclass
class Mixture:
    """Weights, means and one covariance per component, ordered by mean."""

    weights: np.ndarray
    means: np.ndarray
    covariances: np.ndarray
    kind: str
    log_likelihood: float
    n: int

    @property
    def n_parameters(self) -> int:
        k, d = self.means.shape
        shape = {"full": k * d * (d + 1) // 2, "tied": d * (d + 1) // 2, "diag": k * d, "spherical": k}[self.kind]
        return shape + k * d + k - 1

    @property
    def bic(self) -> float:
        return -2 * self.log_likelihood + self.n_parameters * math.log(self.n)

    @property
    def aic(self) -> float:
        return -2 * self.log_likelihood + 2 * self.n_parameters


def _ordered(weights, means, covariances, kind, ll, n) -> Mixture:
    order = sorted(range(len(means)), key=lambda i: tuple(means[i]))
    return Mixture(np.asarray(weights)[order], np.asarray(means)[order], np.asarray(covariances)[order], kind, ll, n)


def fit_gaussian_mixture(scaled: DataFrame, k: int, restarts: int = 3, seed: int = 42) -> Mixture:
    """Full covariances, fitted by the built-in estimator; the likeliest of several starts."""
    data = _vectors(scaled).select("v").persist()
    n, best = data.count(), None
    for i in range(restarts):
        model = GaussianMixture(k=k, featuresCol="v", seed=seed + i, maxIter=100, tol=1e-3).fit(data)
        ll = float(model.summary.logLikelihood)
        if best is None or ll > best.log_likelihood:
            means = [g.mean.toArray() for g in model.gaussians]
            covs = [g.cov.toArray() for g in model.gaussians]
            best = _ordered(model.weights, means, covs, "full", ll, n)
    data.unpersist()
    return best


def _log_density(x: np.ndarray, m: Mixture) -> np.ndarray:
    out = np.empty((len(x), len(m.weights)))
    for j, (w, mean, cov) in enumerate(zip(m.weights, m.means, m.covariances)):
        root = np.linalg.cholesky(cov)
        z = np.linalg.solve(root, (x - mean).T)
        out[:, j] = (
            math.log(max(w, 1e-300)) - 0.5 * (z * z).sum(0) - np.log(np.diag(root)).sum() - 0.5 * x.shape[1] * math.log(2 * math.pi)
        )
    return out


def _responsibilities(x: np.ndarray, m: Mixture) -> tuple[np.ndarray, np.ndarray]:
    dens = _log_density(x, m)
    top = dens.max(axis=1, keepdims=True)
    total = top[:, 0] + np.log(np.exp(dens - top).sum(axis=1))
    return np.exp(dens - total[:, None]), total


def _shape_covariances(s0, s1, s2, kind: str, floor: float) -> np.ndarray:
    """Covariances of the wanted kind from weighted sums."""
    means = s1 / s0[:, None]
    full = s2 / s0[:, None, None] - np.einsum("ki,kj->kij", means, means)
    d = means.shape[1]
    if kind == "tied":
        full = np.repeat(((full * s0[:, None, None]).sum(0) / s0.sum())[None], len(s0), axis=0)
    elif kind == "diag":
        full = np.stack([np.diag(np.diag(c)) for c in full])
    elif kind == "spherical":
        full = np.stack([np.eye(d) * np.trace(c) / d for c in full])
    return full + floor * np.eye(d)


def fit_mixture(
    scaled: DataFrame, k: int, kind: str = "full", max_iter: int = 200, tol: float = 1e-3, seed: int = 42, floor: float = 1e-6,
    restarts: int = 1,
) -> Mixture:
    """Expectation-maximisation for any covariance kind; of several starts, the likeliest."""
    found = fit_mixtures(scaled, [(k, kind, seed + i) for i in range(max(1, restarts))], max_iter, tol, floor)
    return max(found, key=lambda m: m.log_likelihood)


def fit_mixtures(
    scaled: DataFrame, wanted: Sequence[tuple[int, str, int]], max_iter: int = 200, tol: float = 1e-3, floor: float = 1e-6
) -> list[Mixture]:
    """One fitted mixture for each `(k, kind, seed)`, all in the same passes over the rows.

    A pass serves every mixture that has not converged yet. Each task reduces its rows to weighted sums, Spark adds
    them up, and only those k * (1 + d + d^2) numbers a mixture reach the driver. Kinds share the starts of a K and seed.
    """
    for _, kind, _ in wanted:
        if kind not in ("full", "tied", "diag", "spherical"):
            raise ValueError(f"unknown covariance kind {kind!r}")
    data = scaled.select("x").persist()
    starts = sorted({(k, seed) for k, _, seed in wanted})
    v = _vectors(data).select("v").persist()
    several = [at for at in starts if at[0] > 1]
    means = {at: _cheapest([fit]) for at, fit in zip(several, _kmeans_fits(v, several))}
    v.unpersist()
    means |= {at: fit_kmeans(data, 1) for at in starts if at[0] == 1}
    d = next(iter(means.values())).shape[1]
    var = np.array(data.agg(*[F.var_pop(F.col("x")[j]) for j in range(d)]).first(), dtype=float)

    def first(k: int, kind: str, seed: int) -> Mixture:
        start = np.stack([np.diag(np.maximum(var, floor))] * k)
        return Mixture(np.full(k, 1.0 / k), means[k, seed], start, kind, -math.inf, 0)

    found = {i: first(*w) for i, w in enumerate(wanted)}
    going = list(found)
    for _ in range(max_iter):
        sums = _weighted_sums(data, {i: found[i] for i in going})
        for i in list(going):
            m, (k, kind, _) = found[i], wanted[i]
            s0 = np.maximum(sums[i][:k], 1e-12)
            s1 = sums[i][k : k + k * d].reshape(k, d)
            s2 = sums[i][k + k * d : k + k * d + k * d * d].reshape(k, d, d)
            ll, n = float(sums[i][-2]), int(round(sums[i][-1]))
            if abs(ll - m.log_likelihood) <= tol * n:
                going.remove(i)
            found[i] = Mixture(s0 / s0.sum(), s1 / s0[:, None], _shape_covariances(s0, s1, s2, kind, floor), kind, ll, n)
        if not going:
            break
    last = _weighted_sums(data, found)
    data.unpersist()
    return [
        _ordered(m.weights, m.means, m.covariances, m.kind, float(last[i][-2]), int(round(last[i][-1]))) for i, m in found.items()
    ]


def _weighted_sums(data: DataFrame, mixtures: dict[int, Mixture]) -> dict[int, np.ndarray]:
    import pandas as pd

    def reduce_rows(batches):
        totals: dict = {}
        for pdf in batches:
            if len(pdf) == 0:
                continue
            x = np.stack(pdf["x"].to_numpy())
            for of, m in mixtures.items():
                r, ll = _responsibilities(x, m)
                squares = np.stack([(x * w[:, None]).T @ x for w in r.T])
                part = np.concatenate([r.sum(0), (r.T @ x).ravel(), squares.ravel(), [ll.sum(), len(x)]])
                totals[of] = part if of not in totals else totals[of] + part
        for of, total in totals.items():
            yield pd.DataFrame({"m": of, "i": np.arange(len(total)), "s": total})

    rows = data.mapInPandas(reduce_rows, "m int, i int, s double").groupBy("m", "i").agg(F.sum("s").alias("s")).collect()
    out: dict = {}
    for r in sorted(rows):
        out.setdefault(r["m"], []).append(r["s"])
    return {of: np.array(values) for of, values in out.items()}


def with_responsibilities(df: DataFrame, m: Mixture) -> DataFrame:
    """Add `resp`, `cluster_label`, `max_prob` and `entropy` from array `x`."""

    def add(batches):
        for pdf in batches:
            if len(pdf):
                r, _ = _responsibilities(np.stack(pdf["x"].to_numpy()), m)
                pdf["resp"] = list(r)
            else:
                pdf["resp"] = []
            yield pdf

    schema = f"{', '.join(f'`{c}` {t}' for c, t in df.dtypes)}, resp array<double>"
    out = df.mapInPandas(add, schema)
    return out.withColumns(
        {
            "cluster_label": (F.array_position("resp", F.array_max("resp")) - 1).cast("int"),
            "max_prob": F.array_max("resp"),
            "entropy": S.soft_entropy(F.col("resp")),
        }
    )


def mixture_labels(
    plates: DataFrame, features: Sequence[str], k: int, *, posterior: float = 0.70, restarts: int = 3, seed: int = 42, **limits
) -> DataFrame:
    """Mixture on frequent plates; a rare plate below the posterior threshold is -1."""
    rows = valid_rows(plates, features)
    frequent, rare = split_frequent(rows, **limits)
    m = fit_gaussian_mixture(standardise(frequent, frequent, features), k, restarts, seed)
    a = with_responsibilities(standardise(frequent, frequent, features), m).withColumn("is_rare", F.lit(False))
    b = with_responsibilities(standardise(frequent, rare, features), m).withColumn("is_rare", F.lit(True))
    b = b.withColumn("cluster_label", F.when(F.col("max_prob") < posterior, F.lit(-1)).otherwise(F.col("cluster_label")))
    return a.unionByName(b).withColumnRenamed("max_prob", "confidence_score").drop("x")


def sweep_mixture(
    scaled: DataFrame, ks: Sequence[int], kinds: Sequence[str] = ("full",), seed: int = 42, restarts: int = 3
) -> DataFrame:
    """Log-likelihood, BIC and AIC per K and covariance kind, of the likeliest of several starts."""
    asked = [(kind, k) for kind in kinds for k in ks]
    wanted = [(k, kind, seed + i) for kind, k in asked for i in range(max(1, restarts))]
    found = list(zip(wanted, fit_mixtures(scaled, wanted)))
    rows = []
    for kind, k in asked:
        m = max((m for (of_k, of_kind, _), m in found if (of_kind, of_k) == (kind, k)), key=lambda m: m.log_likelihood)
        rows.append((kind, k, m.log_likelihood, m.n_parameters, m.bic, m.aic))
    return scaled.sparkSession.createDataFrame(
        rows, "kind string, k int, log_likelihood double, n_parameters int, bic double, aic double"
    )


def component_report(df: DataFrame, low: float = 0.7, m: Mixture | None = None) -> DataFrame:
    """Size, certainty and, given the mixture, weight and covariance condition per component."""
    total = F.sum("n_hard").over(Window.partitionBy(F.lit(1)))
    out = (
        df.groupBy("cluster_label")
        .agg(
            F.count(F.lit(1)).alias("n_hard"),
            F.avg("max_prob").alias("mean_max_prob"),
            F.avg("entropy").alias("mean_entropy"),
            F.avg((F.col("max_prob") < low).cast("double")).alias("low_confidence_share"),
        )
        .withColumn("hard_share", F.col("n_hard") / total)
    )
    if m is not None:
        facts = [(i, float(w), float(np.linalg.cond(c))) for i, (w, c) in enumerate(zip(m.weights, m.covariances))]
        table = df.sparkSession.createDataFrame(facts, "cluster_label int, weight double, cov_condition double")
        out = out.join(table, "cluster_label", "left")
    return out


def principal_plane(scaled: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Two principal components of centred arrays `x`; each axis points along its largest loading."""
    data = _vectors(scaled)
    model = PCA(k=2, inputCol="v", outputCol="p").fit(data)
    axes = np.array(model.pc.toArray())
    signs = [float(np.sign(axes[np.argmax(np.abs(axes[:, j])), j]) or 1.0) for j in range(axes.shape[1])]
    p = vector_to_array("p")
    return model.transform(data).select(*keep, *[(p[j] * F.lit(s)).alias(f"pc{j + 1}") for j, s in enumerate(signs)])


# ---- K by coverage, fit-all, density ---------------------------------------------------------------


def optimal_k(plates: DataFrame, features: Sequence[str], ks: Sequence[int], method: str = "kmeans", **kw) -> DataFrame:
    """K that leaves out the smallest share of rare plates, then the smallest K."""
    rows = k_coverage(plates, features, ks, method, **kw)
    return rows.filter("error IS NULL").drop("error").orderBy("rare_excluded_pct", "k").limit(1)


def k_coverage(plates: DataFrame, features: Sequence[str], ks: Sequence[int], method: str = "kmeans", **kw) -> DataFrame:
    """Coverage for each K; a K that cannot be fitted (too few plates for it) is a row with its error."""
    spark = plates.sparkSession
    out, failed = None, []
    for k in ks:
        try:
            labels = (kmeans_labels if method == "kmeans" else mixture_labels)(plates, features, k, **kw)
        except (ValueError, IllegalArgumentException) as e:
            failed.append((k, str(e)))
            continue
        row = assignment_coverage(labels).withColumns({"k": F.lit(k), "error": F.lit(None).cast("string")})
        out = row if out is None else out.unionByName(row)
    if not failed:
        return out
    errors = spark.createDataFrame(failed, "k int, error string")
    return errors if out is None else out.unionByName(errors, allowMissingColumns=True)


def fit_all(plates: DataFrame, features: Sequence[str], k: int, method: str = "kmeans", restarts: int = 10, seed: int = 42) -> DataFrame:
    """Label every valid plate, with no frequent and rare split."""
    rows = valid_rows(plates, features)
    scaled = standardise(rows, rows, features)
    if method == "kmeans":
        return nearest_centroid(scaled, fit_kmeans(scaled, k, restarts, seed)).drop("x")
    return with_responsibilities(scaled, fit_gaussian_mixture(scaled, k, restarts, seed)).drop("x")


def connected(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """Connected components: the smallest node id each node reaches, in (id, label)."""
    both = durable(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    labels = durable(nodes.select("id", F.col("id").alias("label")))
    while True:
        seen = both.join(labels.select(F.col("id").alias("b"), "label"), "b").groupBy(F.col("a").alias("id")).agg(
            F.min("label").alias("m")
        )
        near = labels.join(seen, "id", "left").select("id", F.least("label", "m").alias("label"), F.col("label").alias("old"))
        jump = near.select(F.col("id").alias("label"), F.col("label").alias("far"))
        nxt = durable(near.join(jump, "label").select("id", F.least("label", "far").alias("label"), "old"))
        if nxt.filter(F.col("label") != F.col("old")).isEmpty():
            return nxt.select("id", "label")
        labels = nxt.select("id", "label")
