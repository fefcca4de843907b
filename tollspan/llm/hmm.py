"""Hidden Markov language model: Baum-Welch over the whole corpus, exact likelihood by the scaled forward pass.

Tokens are the words of a text and one end. The `FREQUENT` most frequent training tokens have an emission of
their own in every state; all others share one symbol, and inside it a word has its add-one share of the rest of
the training tokens. That factor does not depend on the state, so it is summed by a join with the full count
table, and the likelihood over the open vocabulary stays exact. The frequent list is the only thing sent to
the executors, and its size does not grow with the corpus.
"""

from __future__ import annotations

import heapq
from bisect import bisect
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tollspan.llm.common import remainder, table
from tollspan.session import durable

END = b""  # no word is empty
SYMBOL = np.dtype("<u2")
ENCODED = ("_row", "_symbols", "_rest", "_times")
SCORED = ("n_tokens", "n_known", "train_tokens", "base_score", "score")
FREQUENT = 1 << 15
STATES = 8
ROUNDS = 5
SEED = 7
#: Added to expected counts, so that no probability is zero.
PSEUDO = 0.1
#: Tokens scored together, and the lanes they are dealt over.
BLOCK_TOKENS = 3 << 18
LANES = 1024
LENGTHS = (512, 2048, 8192)
#: Bytes of text whose words are parted and looked up together.
PART_BYTES = 1 << 23


def count_tokens(texts: DataFrame, text_col: str) -> DataFrame:
    """`(word, n)` over all texts; the end has the empty word. Counts are summed in each task before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _parts(batch.column(0)):
                words, sizes = _words(part)
                coded = words.dictionary_encode()
                n = np.bincount(coded.indices.to_numpy(), minlength=len(coded.dictionary))
                columns = [pa.concat_arrays([coded.dictionary, pa.array([END], pa.binary())]), pa.array(np.r_[n, len(sizes)], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["word", "n"])

    partial = texts.select(text_col).mapInArrow(count, "word binary, n bigint")
    return partial.groupBy("word").agg(F.sum("n").alias("n"))


def _parts(texts: pa.Array) -> Iterator[pa.Array]:
    """Texts of about PART_BYTES at a time, null ones empty."""
    texts = pc.fill_null(texts, "")
    ends = np.cumsum(pc.binary_length(texts).to_numpy().astype(np.int64)) // PART_BYTES
    cuts = [0, *(np.flatnonzero(np.diff(ends)) + 1).tolist(), len(texts)]
    yield from (texts.slice(i, j - i) for i, j in pairwise(cuts) if i < j)


def _words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts (`words_of`, as one column), and how many each text has."""
    lists = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(pc.ascii_lower(texts)))
    sizes = pc.list_value_length(lists).to_numpy().astype(np.int64)
    found = lists.flatten()
    none = pc.equal(found, "")
    if pc.any(none).as_py():  # a text without a word is one empty piece
        owner = np.repeat(np.arange(len(sizes)), sizes)
        sizes = np.bincount(owner[~none.to_numpy(zero_copy_only=False)], minlength=len(sizes))
        found = found.filter(pc.invert(none))
    return found.cast(pa.binary()), sizes


class Parameters:
    """Start, transition and emission probabilities; the last emission column is the shared rare symbol."""

    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray) -> None:
        self.start, self.move, self.emit = start, move, emit

    @classmethod
    def first(cls, counts: np.ndarray, states: int, seed: int) -> Parameters:
        rng = np.random.default_rng(seed)
        emit = (counts + PSEUDO) * rng.gamma(2.0, 0.5, (states, len(counts)))
        move = np.full((states, states), 1.0) + 4.0 * states * np.eye(states)
        return cls(np.full(states, 1 / states), _rows(move), _rows(emit))


def _rows(m: np.ndarray) -> np.ndarray:
    return m / m.sum(-1, keepdims=True)


def _lanes(docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[int]]:
    """Documents laid end to end in lanes, stored step by step, the longest lanes first and without gaps.

    Returns the symbols, the document numbers, whether a token opens its document, and where each step begins.
    """
    lanes: list[list[int]] = [[] for _ in range(min(LANES, len(docs)))]
    heap = [(0, k) for k in range(len(lanes))]
    for i in sorted(range(len(docs)), key=lambda i: -len(docs[i])):
        filled, k = heap[0]
        lanes[k].append(i)
        heapq.heapreplace(heap, (filled + len(docs[i]), k))
    heap.sort(key=lambda x: -x[0])
    lengths = np.array([filled for filled, _ in heap])
    used = len(lengths) - np.searchsorted(lengths[::-1], np.arange(lengths[0]), side="right")
    base = np.r_[0, np.cumsum(used)]
    order = [i for _, k in heap for i in lanes[k]]
    sizes = np.array([len(docs[i]) for i in order])
    step = np.arange(base[-1]) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    place = base[step] + np.repeat(np.arange(len(lengths)), lengths)
    symbols = np.empty(base[-1], np.intp)
    owner = np.empty(base[-1], np.int32)
    opens = np.zeros(base[-1], bool)
    symbols[place] = np.concatenate([docs[i] for i in order])
    owner[place] = np.repeat(order, sizes)
    opens[place[np.cumsum(sizes) - sizes]] = True
    return symbols, owner, opens, base.tolist()


def forward(docs: list[np.ndarray], p: Parameters, counts: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """log10 likelihood of each document by the scaled forward recursion.

    With `counts` (start, move, emit by symbol) the backward pass follows and adds the expected counts.
    """
    if not docs:
        return np.zeros(0)
    symbols, owner, opens, base = _lanes(docs)
    steps, states = len(base) - 1, len(p.start)
    emit, forth, first = np.ascontiguousarray(p.emit.T), np.ascontiguousarray(p.move.T), p.start[:, None]
    fresh = np.flatnonzero(opens)
    bounds = np.searchsorted(fresh, base).tolist()
    # one over the sum that each step is scaled by
    scale = np.empty(len(symbols))
    # a state is a row, so that operations run along the lanes; only emissions are read a symbol at a time
    alphas = np.empty((states, len(symbols))) if counts else None
    alpha = np.zeros((states, base[1]))
    for t in range(steps):
        at, end = base[t], base[t + 1]
        prior = forth @ alpha[:, : end - at]
        if bounds[t] < bounds[t + 1]:
            prior[:, fresh[bounds[t] : bounds[t + 1]] - at] = first
        prior *= emit.take(symbols[at:end], axis=0, mode="clip").T
        over = np.divide(1.0, prior.sum(0), out=scale[at:end])
        alpha = np.multiply(prior, over, out=alphas[:, at:end] if counts else prior)
    score = -np.bincount(owner, weights=np.log10(scale), minlength=len(docs))
    if counts:
        start, move, by_symbol = counts
        pairs, back = np.zeros((states, states)), np.ascontiguousarray(p.move)
        beta = np.ones((states, base[steps] - base[steps - 1]))
        for t in range(steps - 1, -1, -1):
            at, end = base[t], base[t + 1]
            here = alphas[:, at:end]
            if t:
                weighted = np.multiply(emit.take(symbols[at:end], axis=0, mode="clip").T, beta, order="C")
                weighted *= scale[at:end]
                opened = fresh[bounds[t] : bounds[t + 1]] - at if bounds[t] < bounds[t + 1] else None
                if opened is not None:
                    weighted[:, opened] = 0.0
                n, m = end - at, at - base[t - 1]
                pairs += alphas[:, at - m : at - m + n] @ weighted.T
                here *= beta  # from here on the state probabilities
                beta = back @ weighted
                if opened is not None:
                    beta[:, opened] = 1.0
                if n < m:
                    beta = np.concatenate([beta, np.ones((states, m - n))], axis=1)
            else:
                here *= beta
        start += alphas[:, fresh].sum(1)
        move += p.move * pairs
        for k in range(states):
            by_symbol[k] += np.bincount(symbols, weights=alphas[k], minlength=by_symbol.shape[1])
    return score


def _blocks(frames: Iterator[pd.DataFrame]) -> Iterator[tuple[list, list[np.ndarray]]]:
    """Row numbers and symbols of about BLOCK_TOKENS tokens at a time, texts of a like length together.

    A block takes as many steps as its longest text has tokens, so long texts wait for one another. What is left
    at the end goes out by falling length, so that there are few blocks of few lanes.
    """
    held: list[tuple[list, list[np.ndarray]]] = [([], []) for _ in range(len(LENGTHS) + 1)]
    size = [0] * len(held)
    for frame in frames:
        for row, symbols in zip(frame.iloc[:, 0], frame.iloc[:, 1], strict=True):
            found = np.frombuffer(symbols, SYMBOL)
            k = bisect(LENGTHS, len(found))
            held[k][0].append(row)
            held[k][1].append(found)
            size[k] += len(found)
            if size[k] >= BLOCK_TOKENS:
                yield held[k]
                held[k], size[k] = ([], []), 0
    rest = sorted(((row, found) for block in held for row, found in zip(*block, strict=True)), key=lambda x: -len(x[1]))
    ends = np.cumsum([0, *(len(found) for _, found in rest)]) // BLOCK_TOKENS
    for cut in np.split(np.arange(len(rest)), np.flatnonzero(np.diff(ends[:-1])) + 1):
        if len(cut):
            rows, docs = zip(*rest[cut[0] : cut[-1] + 1], strict=True)
            yield list(rows), list(docs)


@dataclass
class Vocabulary:
    """Count table of the training tokens, its frequent words with their counts, and its sums."""

    counts: DataFrame
    words: list[bytes]
    n: np.ndarray
    tokens: int
    distinct: int

    @property
    def index(self) -> dict[bytes, int]:
        return {w: i for i, w in enumerate(self.words)}

    @property
    def symbol_counts(self) -> np.ndarray:
        return np.r_[self.n, self.tokens - self.n.sum()].astype(float)


def vocabulary(docs: DataFrame, text_col: str = "text", frequent: int = FREQUENT) -> Vocabulary:
    """Counts of all tokens of `docs`. Frequent words are those with the largest counts, ties to the smaller bytes."""
    if not 0 < frequent < 1 << 16:
        raise ValueError("frequent must be from 1 to 65535")
    counts = durable(count_tokens(docs, text_col))
    tokens, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    top = counts.orderBy(F.desc("n"), "word").limit(frequent).collect()
    return Vocabulary(counts, [bytes(r[0]) for r in top], np.array([r[1] for r in top], np.int64), tokens, distinct)


def encode(docs: DataFrame, vocab: Vocabulary, text_col: str = "text") -> DataFrame:
    """`docs` without the text, with `_row` (unique), `_symbols` (16-bit numbers, the end last), `_rest`, `_times`.

    `_rest` are the words outside the frequent list, each once a document, and `_times` how often they occur. A
    null text is empty. The table is written, as training and scoring read it many times. Columns of those names
    in `docs` are an error.
    """
    sent = docs.sparkSession.sparkContext.broadcast(vocab.words)
    if set(ENCODED) & {c.lower() for c in docs.columns}:
        raise ValueError(f"columns {ENCODED} are taken")

    @F.arrow_udf("symbols binary, rest array<binary>, times array<int>")
    def encoded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        listed = pa.array(sent.value, pa.binary())
        for texts in batches:
            parts = [_encoded(part, listed) for part in _parts(texts)]
            yield pa.concat_arrays(parts) if parts else _encoded(pa.array([], pa.string()), listed)

    numbered = docs.withColumn("_row", F.monotonically_increasing_id()).withColumn("_e", encoded(F.col(text_col)))
    kept = [F.col(f"`{c}`") for c in docs.columns if c != text_col]
    return durable(numbered.select(*kept, "_row", *[F.col(f"_e.{c}").alias(f"_{c}") for c in ("symbols", "rest", "times")]))


def _encoded(texts: pa.Array, listed: pa.Array) -> pa.Array:
    """Symbols, words outside the list and how often they occur, as one struct a text."""
    words, sizes = _words(texts)
    rare, count = len(listed), len(texts)
    ends = np.cumsum(sizes + 1)
    last = pc.index_in(pa.array([END], pa.binary()), listed).fill_null(rare)[0].as_py()
    symbols = np.full(len(words) + count, last, SYMBOL)
    inside = np.ones(len(symbols), bool)
    inside[ends - 1] = False
    found = pc.index_in(words, listed).fill_null(rare).to_numpy()
    symbols[inside] = found
    # each other word once a text, the end as well where it is not listed
    other = np.flatnonzero(found == rare)
    owner = np.repeat(np.arange(count), sizes)[other]
    coded = words.take(pa.array(other)).dictionary_encode()
    names, codes = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
    if last == rare:
        owner, codes = np.r_[owner, np.arange(count)], np.r_[codes, np.full(count, len(names))]
        names = pa.concat_arrays([names, pa.array([END], pa.binary())])
    width = max(1, len(names))
    pair, times = np.unique(owner * width + codes, return_counts=True)
    at = pa.array(np.r_[0, np.cumsum(np.bincount(pair // width, minlength=count))], pa.int32())
    offsets = pa.py_buffer((2 * np.r_[0, ends]).astype(np.int32))
    return pa.StructArray.from_arrays(
        [
            pa.Array.from_buffers(pa.binary(), count, [None, offsets, pa.py_buffer(symbols)]),
            pa.ListArray.from_arrays(at, names.take(pa.array(pair % width))),
            pa.ListArray.from_arrays(at, pa.array(times, pa.int32())),
        ],
        names=["symbols", "rest", "times"],
    )


def train(encoded: DataFrame, vocab: Vocabulary, *, states: int = STATES, rounds: int = ROUNDS, seed: int = SEED) -> Parameters:
    """`rounds` Baum-Welch rounds over all rows of an encoded table.

    A task adds up its expected counts and hands on one row for each symbol it met; they are summed by symbol
    and read by the driver, which holds (frequent + 1) x states numbers, however large the corpus is. Without
    tokens the first parameters stay.
    """
    context = encoded.sparkSession.sparkContext
    symbol_counts = vocab.symbol_counts
    # one for each word, and for any unseen word in the shared symbol, which so is never impossible
    smoothing = symbol_counts + np.r_[np.ones(len(vocab.words)), vocab.distinct - len(vocab.words) + 1]
    p = Parameters.first(symbol_counts, states, seed)
    columns = ", ".join(f"s{k} double" for k in range(states))
    for _ in range(rounds if vocab.tokens else 0):
        sent = context.broadcast(p)

        def expect(frames: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            p = sent.value
            start, move, emit = np.zeros(states), np.zeros((states, states)), np.zeros(p.emit.shape)
            for _, docs in _blocks(frames):
                forward(docs, p, (start, move, emit))
            met = np.flatnonzero(emit.sum(0))
            frame = pd.DataFrame(np.vstack([start, move, emit[:, met].T]), columns=[f"s{k}" for k in range(states)])
            frame.insert(0, "symbol", np.r_[np.arange(-states - 1, 0), met])
            yield frame

        expected = (
            encoded.select("_row", "_symbols")
            .mapInPandas(expect, f"symbol bigint, {columns}")
            .groupBy("symbol")
            .agg(*[F.sum(f"s{k}").alias(f"s{k}") for k in range(states)])
            .toPandas()
            .set_index("symbol")
            .reindex(np.arange(-states - 1, len(symbol_counts)), fill_value=0.0)
            .to_numpy()
        )
        sent.unpersist()
        p = Parameters(
            _rows(expected[0] + PSEUDO),
            _rows(expected[1 : states + 1] + PSEUDO),
            _rows(expected[states + 1 :].T + PSEUDO * smoothing / smoothing.sum()),
        )
    return p


def score(encoded: DataFrame, vocab: Vocabulary, p: Parameters) -> DataFrame:
    """Encoded rows with n_tokens, n_known, train_tokens (longs), base_score and score (log10 probabilities).

    The base score adds log10((c + 1) / (N + V + 1)) over all tokens, with counts from the whole table. Words
    outside the frequent list are joined with the count table, each word once a document. Rows are told apart
    by their own number, so null and repeated ids do no harm. An empty text is one token, the end. Columns of
    the five names are replaced.
    """
    size = vocab.tokens + vocab.distinct + 1
    rare_size = int(vocab.symbol_counts[-1]) + vocab.distinct - len(vocab.words) + 1
    sent = encoded.sparkSession.sparkContext.broadcast((p, np.r_[np.log10((vocab.n + 1) / size), 0.0]))
    rare = len(vocab.words)

    def scored(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p, base_of = sent.value
        for rows, docs in _blocks(frames):
            yield pd.DataFrame(
                {
                    "_row": rows,
                    "n_tokens": [len(d) for d in docs],
                    "n_listed": [int((d != rare).sum()) for d in docs],
                    "base": [float(base_of[d].sum()) for d in docs],
                    "part": forward(docs, p),
                }
            )

    first = encoded.select("_row", "_symbols").mapInPandas(
        scored, "_row bigint, n_tokens bigint, n_listed bigint, base double, part double"
    )
    rest = encoded.select("_row", F.inline(F.arrays_zip(F.col("_rest").alias("word"), F.col("_times").alias("times"))))
    c = F.coalesce("n", F.lit(0)) + 1
    summed = (
        rest.join(vocab.counts, "word", "left")
        .groupBy("_row")
        .agg(
            F.sum(F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0)).alias("n_rest_known"),
            F.sum(F.col("times") * F.log10(c / F.lit(float(size)))).alias("rest_base"),
            F.sum(F.col("times") * F.log10(c / F.lit(float(rare_size)))).alias("rest_part"),
        )
    )
    return (
        encoded.drop(*ENCODED[1:], *SCORED)
        .join(first, "_row")
        .join(summed, "_row", "left")
        .select(
            *[F.col(f"`{c}`") for c in encoded.columns if c not in ENCODED and c.lower() not in SCORED],
            "n_tokens",
            (F.col("n_listed") + F.coalesce("n_rest_known", F.lit(0))).alias("n_known"),
            F.lit(vocab.tokens).cast("bigint").alias("train_tokens"),
            (F.col("base") + F.coalesce("rest_base", F.lit(0.0))).alias("base_score"),
            (F.col("part") + F.coalesce("rest_part", F.lit(0.0))).alias("score"),
        )
    )


def op10_hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", (remainder("doc_id", 7) == 2).alias("held_out"))
    vocab = vocabulary(docs.filter("not held_out"))
    encoded = encode(docs, vocab)
    return score(encoded, vocab, train(encoded.filter("not held_out"), vocab))
