"""Language identification by hierarchical discrimination over hashed character n-grams.

One-versus-one linear support vector machines first choose among language families and then, inside the family,
among its languages. Features are the shares of a text's letter trigrams, hashed; a text's margin is the mean of
its trigrams' weights, so scoring is one table look-up for each character.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tollspan.llm.common import remainder, table

UNDETERMINED = "und"
#: Families of language codes; a code that is not listed is a family of its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af", "lb", "fy", "yi"),
    "romance": ("es", "fr", "it", "pt", "ro", "ca", "gl", "oc"),
    "slavic": ("ru", "uk", "be", "pl", "cs", "sk", "sl", "hr", "sr", "bs", "mk", "bg"),
    "uralic": ("fi", "et", "hu"),
    "turkic": ("tr", "az", "kk", "uz"),
    "indic": ("hi", "mr", "ne", "bn", "gu", "pa"),
}
#: Documents of each language that are fitted on, about.
SAMPLE_DOCS = 1000
BITS = 13
#: Scales the shares, which sum to one, so that margins near one are in reach of small weights.
SCALE = 60.0
_PIECE = 1 << 20


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Code points of letters, by code point; all others become a blank."""
    return np.array([i if chr(i).isalpha() else 32 for i in range(0x110000)], np.uint32)


def trigrams(text: str) -> Iterator[np.ndarray]:
    """Hashed trigrams around every letter of a text, piece by piece; nothing where there is no letter."""
    codes = _letters()[np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")]
    for at in range(0, len(codes), _PIECE):
        mid = codes[at : at + _PIECE]
        left = np.r_[codes[at - 1] if at else np.uint32(32), mid[:-1]]
        end = codes[at + len(mid)] if at + len(mid) < len(codes) else np.uint32(32)
        right = np.r_[mid[1:], end]
        mix = left * np.uint32(2654435761) + mid * np.uint32(2246822519) + right * np.uint32(3266489917)
        mix ^= mix >> np.uint32(15)
        mix *= np.uint32(2246822519)
        yield ((mix >> np.uint32(32 - BITS))[mid != 32]).astype(np.int64)


def family_of(lang: str) -> str:
    return next((f for f, langs in FAMILIES.items() if lang in langs), lang)


#: Share of rightly judged texts that may lie below a model's `least` score.
SURE_MISSED = 0.001


@dataclass
class Model:
    langs: list[str] = field(default_factory=list)
    #: A level's classes, and for each pair of them the column of its machine.
    families: list[str] = field(default_factory=list)
    weights: np.ndarray = field(default_factory=lambda: np.zeros((1 << BITS, 0), np.float32))
    bias: np.ndarray = field(default_factory=lambda: np.zeros(0))
    column: dict[tuple[str, str], int] = field(default_factory=dict)
    #: The score that all but SURE_MISSED of the fitted texts given their own language exceed, with a tenth of slack.
    least: float = 0.0

    def margins(self, text: str) -> np.ndarray | None:
        total, n = np.zeros(len(self.bias)), 0
        for grams in trigrams(text):
            counts = np.bincount(grams, minlength=1 << BITS)
            total += counts @ self.weights
            n += len(grams)
        return SCALE * total / n + self.bias if n else None

    def _choose(self, classes: list[str], margins: np.ndarray) -> tuple[str, float]:
        """Class with most duels won, ties to the larger sum of margins, then to the first name; its worst duel."""
        won = dict.fromkeys(classes, 0.0)
        gain = dict.fromkeys(classes, 0.0)
        worst = dict.fromkeys(classes, np.inf)
        for a, b in combinations(classes, 2):
            m = float(margins[self.column[a, b]])
            won[a if m > 0 else b] += 1
            for c, v in ((a, m), (b, -m)):
                gain[c] += v
                worst[c] = min(worst[c], v)
        best = min(classes, key=lambda c: (-won[c], -gain[c], c))
        return best, worst[best]

    def predict(self, text: str | None) -> tuple[str, float]:
        margins = self.margins(text) if text and self.langs else None
        return (UNDETERMINED, 0.0) if margins is None else self._judge(margins)

    def _judge(self, margins: np.ndarray) -> tuple[str, float]:
        family, first = self._choose(self.families, margins)
        lang, second = self._choose([c for c in self.langs if family_of(c) == family], margins)
        return lang, float(np.prod([1 / (1 + np.exp(-4.0 * np.clip(m, -9, 9))) for m in (first, second)]))


def _machine(grams: list[np.ndarray], shares: list[np.ndarray], y: np.ndarray, ridge: float = 1e-4, rounds: int = 150) -> tuple[np.ndarray, float]:
    """Linear machine with squared hinge loss over sparse rows, by accelerated gradient steps; classes weigh the same."""
    sizes = np.array([len(g) for g in grams])
    starts = np.cumsum(sizes) - sizes
    at, value = np.concatenate(grams), SCALE * np.concatenate(shares)
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum()))
    w, b = np.zeros(1 << BITS), 0.0
    look_w, look_b, t = w, b, 1.0
    rate = 1.0 / (2 * float(np.add.reduceat(value * value, starts).max()) + 2.0)
    for _ in range(rounds):
        slack = np.maximum(0, 1 - y * (np.add.reduceat(look_w[at] * value, starts) + look_b)) * weight * y
        new_w = look_w + rate * 2 * (np.bincount(at, weights=value * np.repeat(slack, sizes), minlength=1 << BITS) - ridge * look_w)
        new_b = look_b + rate * 2 * slack.sum()
        nxt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        look_w, look_b = new_w + (t - 1) / nxt * (new_w - w), new_b + (t - 1) / nxt * (new_b - b)
        w, b, t = new_w, new_b, nxt
    return w.astype(np.float32), float(b)


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id",
        sample_docs: int = SAMPLE_DOCS) -> Model:
    """Machines from about `sample_docs` documents of each language, taken by a hash of the id.

    Null languages, and texts that are null or have no letter, teach nothing. Without any language the model
    answers `und` to every text; with one, that language.
    """
    known = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    sizes = {r[0]: r[1] for r in known.groupBy(lang_col).count().collect()}
    if not sizes:
        return Model()
    share = F.create_map(*[F.lit(v) for lang, n in sizes.items() for v in (lang, min(1.0, sample_docs / n))])
    few = known.filter(F.pmod(F.xxhash64(id_col), F.lit(1_000_000)) < share[F.col(lang_col)] * 1_000_000)

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for lang, text in frame.itertuples(index=False):
                counts = sum(np.bincount(g, minlength=1 << BITS) for g in trigrams(text))
                if np.any(counts):
                    met = np.flatnonzero(counts)
                    out.append((lang, met.tolist(), (counts[met] / counts.sum()).tolist()))
            yield pd.DataFrame(out, columns=["lang", "grams", "shares"])

    rows = few.select(lang_col, text_col).mapInPandas(count, "lang string, grams array<int>, shares array<float>").toPandas()
    if rows.empty:
        return Model()
    grams, shares = [np.asarray(g, np.int32) for g in rows["grams"]], [np.asarray(v, np.float32) for v in rows["shares"]]
    lang = rows["lang"].to_numpy()
    family = np.array([family_of(c) for c in lang])
    langs, families = sorted(set(lang)), sorted(set(family))
    duels = [(a, b, family) for a, b in combinations(families, 2)]
    for f in families:
        duels += [(a, b, lang) for a, b in combinations([c for c in langs if family_of(c) == f], 2)]
    weights, bias, column = [], [], {}
    for a, b, of in duels:
        part = np.flatnonzero((of == a) | (of == b))
        w, c = _machine([grams[i] for i in part], [shares[i] for i in part], np.where(of[part] == a, 1.0, -1.0))
        column[a, b] = len(bias)
        weights.append(w)
        bias.append(c)
    table_ = np.stack(weights, 1) if weights else np.zeros((1 << BITS, 0), np.float32)
    model = Model(langs, families, table_, np.array(bias), column)
    judged = [model._judge(SCALE * (v @ table_[g]) + model.bias) for g, v in zip(grams, shares, strict=True)]
    right = [score for (found, score), own in zip(judged, lang, strict=True) if found == own]
    model.least = 0.9 * float(np.quantile(right, SURE_MISSED)) if right else 0.0
    return model


def language(model: Model, text: Column) -> Column:
    """Struct `lang, score` of a whole text; `und` and 0.0 where it is null or has no letter."""

    @F.pandas_udf("lang string, score double")
    def predicted(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame([model.predict(t) for t in texts], columns=["lang", "score"])

    return predicted(text)


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", (remainder("doc_id", 4) == 2).alias("held_out"))
    model = fit(docs.filter("not held_out"))
    return docs.select("doc_id", "held_out", language(model, F.col("text")).alias("p")).select(
        "doc_id", "held_out", F.col("p.lang").alias("lang_pred"), "p.score"
    )
