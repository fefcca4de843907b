"""Toxicity by compression distance: windows are compressed with a dictionary of toxic and one of ordinary text.

The ordinary dictionary is trained on windows of ordinary documents. Toxic documents are ordinary text for the
most part, so the toxic dictionary is trained on what sets them apart: of every word, the beginning that is much
more frequent in toxic documents. It stands before the ordinary one, so a window compresses better
only where it holds something toxic. The bytes gained in a document's windows go through calibrated weights.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tollspan.llm.common import remainder, table, words_of

#: Labelled documents of either class that are fitted on, at most.
SAMPLE_DOCS = 3000
WINDOW_WORDS = 12
TOXIC_BYTES, ORDINARY_BYTES = 1024, 1 << 16
#: A beginning counts as toxic from this share of the toxic documents and this log odds on.
LEAST_SHARE, LEAST_ODDS = 0.03, 3.0
SHORTEST, LONGEST = 4, 12
_EDGES = b".,;:!?()[]\"'"
_TOP = 12.0
FEATURES = 7


def text_windows(text: str | None) -> list[bytes]:
    """The words of a text, lowered, in windows of WINDOW_WORDS with a blank at either end."""
    words = words_of(text)
    return [b" " + b" ".join(words[i : i + WINDOW_WORDS]) + b" " for i in range(0, len(words), WINDOW_WORDS)]


def _beginnings(word: bytes) -> list[bytes]:
    return [word[:n] for n in range(SHORTEST, min(len(word), LONGEST) + 1)]


def _counts(texts: list[str]) -> tuple[Counter, Counter]:
    """How often each beginning occurs, and in how many texts."""
    times, holders = Counter(), Counter()
    for text in texts:
        own = Counter(w.strip(_EDGES) for w in words_of(text))
        found: Counter = Counter()
        for word, n in own.items():
            for b in _beginnings(word):
                found[b] += n
        times.update(found)
        holders.update(found.keys())
    return times, holders


def toxic_dictionary(toxic: list[str], ordinary: list[str], size: int) -> bytes:
    """The beginnings of words that set toxic documents apart, each once, the weightiest last (and so nearest).

    Every word of a toxic document stands for its weightiest beginning. A beginning weighs as its number of
    documents times the log odds of how often it occurs in a toxic and in an ordinary one.
    """
    (mine, holders), (theirs, _) = _counts(toxic), _counts(ordinary)

    def odds(b: bytes) -> float:
        return math.log((mine[b] + 0.5) / (len(toxic) + 1)) - math.log((theirs[b] + 0.5) / (len(ordinary) + 1))

    least = max(3, LEAST_SHARE * len(toxic))
    weight = {b: n * odds(b) for b, n in holders.items() if n >= least and odds(b) >= LEAST_ODDS}
    stands: Counter = Counter()
    for text in toxic:
        met = set()
        for word in {w.strip(_EDGES) for w in words_of(text)}:
            telling = [b for b in _beginnings(word) if b in weight]
            if telling:
                met.add(max(telling, key=lambda b: (weight[b], len(b))))
        stands.update(met)
    stems = sorted((b for b, n in stands.items() if n >= least), key=lambda b: (-weight[b], b))
    # longer beginnings with such a stem save more bytes where they fit
    longer = {b for b, n in holders.items() if n >= least / 3 and b not in stands and any(b[:k] in stands for k in range(SHORTEST, len(b)))}
    content = b" "
    for b in [*stems, *sorted(longer, key=lambda b: (-holders[b] * len(b), b))]:
        if b" " + b not in content:
            content = b" " + b + content
        if len(content) > size:
            break
    return content[-size:]


def _dictionary(samples: list[bytes], size: int, k: int, d: int) -> bytes:
    import zstandard

    total = sum(map(len, samples))
    if len(samples) < 8 or total < 8 * size:  # too little to train on: the text itself is the dictionary
        return b"".join(samples)[-size:]
    return zstandard.train_dictionary(size, samples, k=k, d=d).as_bytes()


@dataclass
class Model:
    toxic: bytes
    ordinary: bytes
    weights: np.ndarray  # the last one is the constant

    def scores(self, texts: Iterator[str | None]) -> np.ndarray:
        features = np.array([self.gains(t) for t in texts]).reshape(-1, len(self.weights) - 1)
        return 1 / (1 + np.exp(-(features @ self.weights[:-1] + self.weights[-1])))

    def gains(self, text: str | None) -> list[float]:
        """Of the bytes gained by window: the three largest, the sum of those from 3 on, the mean and the share from 1 on."""
        if not hasattr(self, "_compressors"):
            self._compressors = _compressor(self.ordinary), _compressor(self.toxic + self.ordinary)
        plain, toxic = self._compressors
        found = sorted((len(plain(w)) - len(toxic(w)) for w in text_windows(text)), reverse=True)
        n = max(1, len(found))
        top = [min(max(g, 0), _TOP) for g in (*found[:3], 0, 0, 0)][:3]
        clear = math.log1p(sum(g for g in found if g >= 3))
        return [*top, clear, min(sum(found) / n, _TOP), sum(g > 0 for g in found) / n, math.log1p(len(found))]

    def __getstate__(self) -> tuple:
        return self.toxic, self.ordinary, self.weights

    def __setstate__(self, state: tuple) -> None:
        self.toxic, self.ordinary, self.weights = state


def _compressor(content: bytes):
    import zstandard

    settings = zstandard.ZstdCompressionParameters(
        window_log=17, chain_log=17, hash_log=17, search_log=5, min_match=4, target_length=64,
        strategy=zstandard.STRATEGY_LAZY2, write_content_size=False, write_checksum=False, write_dict_id=False,
    )
    dictionary = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    dictionary.precompute_compress(compression_params=settings)
    return zstandard.ZstdCompressor(dict_data=dictionary, compression_params=settings).compress


def _logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float = 1e-2, rounds: int = 60) -> np.ndarray:
    x = np.c_[x, np.ones(len(x))]
    beta = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        slope = x.T @ (w * (y - p)) - ridge * beta
        bend = (x * (w * p * (1 - p) + 1e-9)[:, None]).T @ x + ridge * np.eye(len(beta))
        step = np.linalg.solve(bend, slope)
        beta += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return beta


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
        sample_docs: int = SAMPLE_DOCS) -> Model | float:
    """Model from at most `sample_docs` labelled documents of either class, taken in the order of a hash of the id.

    Three fifths of them train the dictionaries, the rest calibrates the weights, at the share of either class
    among all labels. A document with two labels takes the larger; null labels and ids teach nothing. Where a
    class is missing, there is no model but the share of label 1 (0.0 without labels).
    """
    marked = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(id_col).agg(F.max(label_col).alias("y"))
    share = marked.agg(F.avg((F.col("y") == 1).cast("double"))).first()[0]
    if not share or share == 1.0:
        return share or 0.0
    order = F.xxhash64(id_col), F.col(id_col)
    few = marked.filter("y = 1").orderBy(*order).limit(sample_docs).unionByName(marked.filter("y != 1").orderBy(*order).limit(sample_docs))
    met = (
        docs.select(id_col, text_col)
        .join(F.broadcast(few), id_col)  # at most 2 * sample_docs ids
        .dropDuplicates([id_col])
        .orderBy(*order)
        .select(F.coalesce(text_col, F.lit("")).alias("text"), (F.col("y") == 1).alias("y"))
        .toPandas()
    )
    parts = {y: met["text"][met["y"] == y].tolist() for y in (True, False)}
    if not all(len(p) > 1 for p in parts.values()):
        return share
    cut = {y: max(1, len(p) * 3 // 5) for y, p in parts.items()}
    ordinary = [w for t in parts[False][: cut[False]] for w in text_windows(t)]
    stride = max(1, len(ordinary) // 20_000)
    model = Model(
        toxic_dictionary(parts[True][: cut[True]], parts[False][: cut[False]], TOXIC_BYTES),
        _dictionary(ordinary[::stride], ORDINARY_BYTES, 200, 8),
        np.zeros(FEATURES + 1),
    )
    rest = {y: p[cut[y] :] for y, p in parts.items()}
    x = np.array([model.gains(t) for y in (True, False) for t in rest[y]])
    n1, n0 = len(rest[True]), len(rest[False])
    weight = np.r_[np.full(n1, share / n1), np.full(n0, (1 - share) / n0)] * (n1 + n0)
    model.weights = _logistic(x, np.r_[np.ones(n1), np.zeros(n0)], weight)
    return model


def toxicity(model: Model | float, text: Column) -> Column:
    """Score from 0 to 1 of a text column, whole texts, null as empty."""
    if isinstance(model, float):
        return F.lit(model)

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(model.scores(texts))

    return scored(text)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = fit(docs, labels.filter(remainder("doc_id", 5) != 0))
    return docs.select(
        "doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), toxicity(model, F.col("text")).alias("score")
    ).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
