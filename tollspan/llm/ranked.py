"""Ranked lexical search by MaxScore with pair bounds.

The documents become blocks of an inverted index: postings with whole impacts, and for pairs of terms that
queries hold together an intersection entry with the largest impact the two reach jointly in one document of
the block. A query bounds what a document can score by pairs instead of single terms: two terms seldom reach
their largest impacts in the same document, so the bound is tighter, more terms are non-essential and more
blocks are passed over whole. The score to beat comes from exact scores of the documents in the intersections
of each query's weightiest pair, over all blocks. Scores and bounds are 64-bit integers and no document that can
reach the score to beat is passed over, so the result is exact.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tollspan.llm.common import table
from tollspan.session import durable

#: Queries and query terms that are taken at a time, and documents and postings of a block, at most (one row more may fit).
QUERY_BLOCK, QUERY_TERMS = 1024, 1 << 20
BLOCK_DOCS, BLOCK_POSTINGS = 8192, 1 << 21
_TERM_BYTES = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)
)


def terms_of(text: str | None) -> list[bytes]:
    """Terms of a text as UTF-8: runs of letters, digits and all that is not ASCII, only A-Z lowered."""
    return text.encode("utf-8", "surrogatepass").translate(_TERM_BYTES).split() if text else []


@dataclass
class Queries:
    """Up to QUERY_BLOCK queries: their terms as numbers, how often each holds them, weights and pairs."""

    items: list = field(default_factory=list)
    terms: list[np.ndarray] = field(default_factory=list)
    times: list[np.ndarray] = field(default_factory=list)
    words: dict[bytes, int] = field(default_factory=dict)
    weight: np.ndarray | None = None
    pairs: np.ndarray | None = None  # (pair, two terms)
    pair_of: list[np.ndarray] = field(default_factory=list)  # by query, one pair for each two of its terms in order
    docs: int = 0
    tokens: int = 0

    def add(self, item, text: str | None) -> None:
        found: dict[int, int] = {}
        for w in terms_of(text):
            n = self.words.setdefault(w, len(self.words))
            found[n] = found.get(n, 0) + 1
        self.items.append(item)
        self.terms.append(np.fromiter(found.keys(), np.int64, len(found)))
        self.times.append(np.fromiter(found.values(), np.int64, len(found)))

    def weigh(self, docs: int, tokens: int, holders: dict[int, int]) -> None:
        """Weights from the documents' counts; then each query's terms by weight, two neighbours making a pair."""
        self.docs, self.tokens = docs, tokens
        self.weight = np.array(
            [math.floor(1000 * math.log((2 * docs + 2) / (2 * holders.get(t, 0) + 1))) for t in range(len(self.words))], np.int64
        )
        numbers: dict[tuple[int, int], int] = {}
        for q, terms in enumerate(self.terms):
            order = np.lexsort((terms, self.weight[terms]))
            self.terms[q], self.times[q] = terms[order], self.times[q][order]
            two = [tuple(sorted(p)) for p in zip(self.terms[q][0::2].tolist(), self.terms[q][1::2].tolist(), strict=False)]
            self.pair_of.append(np.array([numbers.setdefault(p, len(numbers)) for p in two], np.int64))
        self.pairs = np.array(list(numbers), np.int64).reshape(-1, 2)


class Block:
    """Postings of some documents: for each of `terms` the documents `docs[starts[i]:starts[i + 1]]` and impacts."""

    def __init__(self, n: int, terms: np.ndarray, starts: np.ndarray, docs: np.ndarray, impacts: np.ndarray) -> None:
        self.n, self.starts, self.docs, self.impacts = n, starts, docs, impacts
        self.place = {int(t): i for i, t in enumerate(terms)}
        self.top = np.maximum.reduceat(impacts, starts[:-1]) if len(terms) else np.empty(0, np.int64)
        self.room = np.zeros(n, np.int64)

    def postings(self, term: int) -> tuple[np.ndarray, np.ndarray]:
        i = self.place.get(term)
        if i is None:
            return self.docs[:0], self.impacts[:0]
        return self.docs[self.starts[i] : self.starts[i + 1]], self.impacts[self.starts[i] : self.starts[i + 1]]

    def best(self, term: int) -> int:
        i = self.place.get(term)
        return 0 if i is None else int(self.top[i])

    def joint(self, one: int, two: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents that hold both terms, and the two impacts' sum in each."""
        (da, ia), (db, ib) = self.postings(one), self.postings(two)
        self.room[da] = ia
        own = self.room[db]
        self.room[da] = 0
        both = own > 0
        return db[both], own[both] + ib[both]

    def add_to(self, score: np.ndarray, chosen: np.ndarray, term: int, times: int) -> None:
        """Add `times` the term's impact to the scores of the chosen documents (ascending)."""
        docs, impacts = self.postings(term)
        if not len(docs):
            return
        if len(docs) > 16 * len(chosen):
            at = np.minimum(np.searchsorted(docs, chosen), len(docs) - 1)
            score += np.where(docs[at] == chosen, times * impacts[at], 0)
        else:
            self.room[docs] = impacts
            score += times * self.room[chosen]
            self.room[docs] = 0


def _top(scores: np.ndarray, docs: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best, equal scores by the document's place."""
    return np.lexsort((docs, -scores))[:k]


def seeds(block: Block, queries: Queries, k: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each query exact scores of the k best documents of its weightiest pair's intersection (or last term's list)."""
    for q, terms in enumerate(queries.terms):
        if not len(terms):
            continue
        docs, reach = block.joint(int(terms[-2]), int(terms[-1])) if len(terms) > 1 else block.postings(int(terms[-1]))
        if not len(docs):
            docs, reach = block.postings(int(terms[-1]))
        if len(docs):
            chosen = np.sort(docs[_top(reach, docs, k)])
            score = np.zeros(len(chosen), np.int64)
            for t, c in zip(terms.tolist(), queries.times[q].tolist(), strict=True):
                block.add_to(score, chosen, t, c)
            yield q, score


def pair_maxima(block: Block, queries: Queries) -> tuple[np.ndarray, np.ndarray]:
    """The pairs with a document that holds both terms, and the largest joint impact of each."""
    found = []
    for p, (one, two) in enumerate(queries.pairs.tolist()):
        if one in block.place and two in block.place:
            reach = block.joint(one, two)[1]
            if len(reach):
                found.append((p, int(reach.max())))
    both = np.array(found, np.int64).reshape(-1, 2)
    return both[:, 0], both[:, 1]


def search_block(block: Block, joint: dict[int, int], queries: Queries, q: int, least: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """`(docs, scores)` of the k best documents of a block with `least` points or more."""
    terms, times = queries.terms[q].tolist(), queries.times[q].tolist()
    units = []  # the most that a document can get from two terms, and those terms
    for i in range(0, len(terms), 2):
        tops = [times[j] * block.best(terms[j]) for j in range(i, min(i + 2, len(terms)))]
        bound = max(tops)
        if len(tops) == 2 and min(tops):
            both = joint.get(int(queries.pair_of[q][i // 2]), 0)
            low, more = min(times[i], times[i + 1]), times[i] - times[i + 1]
            extra = more * block.best(terms[i]) if more > 0 else -more * block.best(terms[i + 1])
            bound = max(bound, low * both + extra if both else 0)
        if bound:
            units.append((bound, [(terms[j], times[j]) for j in range(i, i + len(tops))]))
    units.sort(key=lambda u: u[0])
    rest, spare = 0, 0
    while spare < len(units) and rest + units[spare][0] < least:
        rest += units[spare][0]
        spare += 1
    if spare == len(units):  # no document of the block can reach the score to beat
        return block.docs[:0], block.impacts[:0]
    score = np.zeros(block.n, np.int64)
    for _, unit in units[spare:]:
        for t, c in unit:
            docs, impacts = block.postings(t)
            score[docs] += c * impacts
    chosen = np.flatnonzero((score > 0) & (score + rest >= least))
    score = score[chosen]
    for bound, unit in reversed(units[:spare]):
        if not len(chosen):
            break
        for t, c in unit:
            block.add_to(score, chosen, t, c)
        rest -= bound
        keep = score + rest >= least
        chosen, score = chosen[keep], score[keep]
    best = _top(score, chosen, k)
    return chosen[best], score[best]


def _forward(docs: DataFrame, queries: Queries) -> DataFrame:
    """`doc_id, n, terms, counts`: length of each document and its query terms."""
    words = queries.words

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths, terms, counts = [], [], []
            for text in batch.column("text"):
                all_terms = terms_of(text.as_py())
                own, times = np.unique(np.fromiter((t for t in map(words.get, all_terms) if t is not None), np.int32), return_counts=True)
                lengths.append(len(all_terms))
                terms.append(own)
                counts.append(times.astype(np.int32))
            lists = [pa.array(x, pa.list_(pa.int32())) for x in (terms, counts)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(lengths, pa.int64()), *lists], names=schema.names)

    schema = T.StructType([docs.schema["doc_id"], *T.StructType.fromDDL("n long, terms array<int>, counts array<int>").fields])
    return durable(docs.mapInArrow(parse, schema))


def _frame(batch: pa.RecordBatch) -> pd.DataFrame:
    """The rows with ids as objects: a null among them must not turn the others into floats."""
    rest = batch.drop_columns(["doc_id"]).to_pandas()
    return rest.assign(doc_id=pd.Series(batch.column("doc_id").to_pylist(), dtype=object))


def _batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The rows again, in frames of at most BLOCK_DOCS rows and (but for one row) BLOCK_POSTINGS postings."""
    kept: list[pd.DataFrame] = []
    docs = postings = 0
    for frame in frames:
        sizes = frame["terms"].map(len).to_numpy()
        at = 0
        while at < len(frame):
            room = np.searchsorted(np.cumsum(sizes[at:]), BLOCK_POSTINGS - postings, "right")
            step = int(min(max(room, 0 if kept else 1), BLOCK_DOCS - docs, len(frame) - at))
            if step:
                kept.append(frame.iloc[at : at + step])
                docs, postings, at = docs + step, postings + int(sizes[at : at + step].sum()), at + step
            if at < len(frame):
                yield pd.concat(kept, ignore_index=True)
                kept, docs, postings = [], 0, 0
    if kept:
        yield pd.concat(kept, ignore_index=True)


def _block_of(frame: pd.DataFrame, queries: Queries) -> tuple[Block, np.ndarray]:
    sizes = frame["terms"].map(len).to_numpy()
    terms = np.concatenate([*frame["terms"], np.empty(0, np.int32)]).astype(np.int64)
    tf = np.concatenate([*frame["counts"], np.empty(0, np.int32)]).astype(np.int64)
    docs = np.repeat(np.arange(len(frame)), sizes)
    order = np.argsort(terms, kind="stable")
    terms, tf, docs = terms[order], tf[order], docs[order]
    m = 100 - 25 + (25 * frame["n"].to_numpy() * queries.docs) // queries.tokens
    impacts = queries.weight[terms] * ((1_000_000_000 * tf) // (1000 * tf + 12 * m[docs]))
    some = impacts > 0
    terms, docs, impacts = terms[some], docs[some], impacts[some]
    own, first = np.unique(terms, return_index=True)
    return Block(len(frame), own, np.r_[first, len(terms)], docs, impacts), own


_INDEX = "terms array<int>, starts array<int>, docs array<int>, impacts array<long>, pairs array<int>, joint array<long>, seed_query array<int>, seed_score array<long>"
_LONG = ("impacts", "joint", "seed_score")


def _index(forward: DataFrame, queries: Queries, k: int) -> DataFrame:
    """One row a block: its documents in order of their ids, postings and pair entries; at a task's end a row with its seeds."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, np.ndarray] = {}
        none = np.empty(0, np.int32)
        kind = pa.null()

        def row(ids: list, *values: np.ndarray) -> pa.RecordBatch:
            columns = [pa.array([ids], pa.list_(kind))]
            columns += [pa.array([v], pa.list_(pa.int64() if name in _LONG else pa.int32())) for name, v in zip(names[1:], values, strict=True)]
            return pa.RecordBatch.from_arrays(columns, names=names)

        def frames() -> Iterator[pd.DataFrame]:
            nonlocal kind
            for batch in batches:
                kind = batch.schema.field("doc_id").type
                yield _frame(batch)

        for frame in _batches(frames()):
            frame = frame.sort_values("doc_id", kind="stable", na_position="first", ignore_index=True)
            block, terms = _block_of(frame, queries)
            pairs, joint = pair_maxima(block, queries)
            for q, scores in seeds(block, queries, k):
                best[q] = np.sort(np.concatenate([best.get(q, none), scores]))[-k:]
            yield row(frame["doc_id"].tolist(), terms, block.starts, block.docs, block.impacts, pairs, joint, none, none)
        if best:
            of = np.repeat(np.fromiter(best, np.int32), [len(s) for s in best.values()])
            yield row([], *[none] * 6, of, np.concatenate(list(best.values())))

    ids = T.StructField("ids", T.ArrayType(forward.schema["doc_id"].dataType))
    schema = T.StructType([ids, *T.StructType.fromDDL(_INDEX).fields])
    names = schema.names
    return durable(forward.mapInArrow(build, schema))


def _to_beat(index: DataFrame, k: int) -> dict[int, int]:
    """By query the k-th best seed: so many documents have that score at least. One row a query comes back."""
    seeds = index.select(F.explode(F.arrays_zip("seed_query", "seed_score")).alias("s")).select("s.*")
    order = Window.partitionBy("seed_query").orderBy(F.desc("seed_score"))
    kth = seeds.withColumn("at", F.row_number().over(order)).filter(F.col("at") <= k).filter(F.col("at") == k)
    return {r[0]: r[1] for r in kth.select("seed_query", "seed_score").collect()}


def _merged(ids: list, scores: np.ndarray, k: int) -> tuple[list, np.ndarray, int]:
    """The k best of a task's finds so far, equal scores by ascending id, and the k-th best score (0: fewer)."""
    if len(ids) < k:
        return ids, scores, 0
    order = pd.DataFrame({"s": -scores, "i": pd.Series(ids, dtype=object)}).sort_values(["s", "i"], na_position="first").index[:k]
    return [ids[j] for j in order], scores[order], int(scores[order[-1]])


def _searched(index: DataFrame, queries: Queries, item: T.StructField, k: int) -> DataFrame:
    least = _to_beat(index, k)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, tuple[list, np.ndarray]] = {}
        bar = dict(least)
        kind = None
        for batch in batches:
            kind = batch.schema.field("ids").type.value_type
            for i in range(batch.num_rows):
                ids = batch.column("ids")[i].as_py()
                of = {name: batch.column(name)[i].values.to_numpy().astype(np.int64) for name in ("terms", "starts", "docs", "impacts", "pairs", "joint")}
                block = Block(len(ids), of["terms"], of["starts"], of["docs"], of["impacts"])
                joint = dict(zip(of["pairs"].tolist(), of["joint"].tolist(), strict=True))
                for q in range(len(queries.items)):
                    docs, scores = search_block(block, joint, queries, q, bar.get(q, 1), k)
                    if len(docs):
                        old_ids, old = found.get(q, ([], scores[:0]))
                        best_ids, best, kth = _merged([*old_ids, *(ids[d] for d in docs)], np.concatenate([old, scores]), k)
                        found[q] = best_ids, best
                        bar[q] = max(bar.get(q, 1), kth)
        if found:
            of = [q for q, (ids, _) in found.items() for _ in ids]
            columns = [pa.array(of, pa.int32()), pa.array([i for ids, _ in found.values() for i in ids], kind)]
            columns.append(pa.array(np.concatenate([s for _, s in found.values()]), pa.int64()))
            yield pa.RecordBatch.from_arrays(columns, names=["q", "doc_id", "score"])

    doc = T.StructField("doc_id", index.schema["ids"].dataType.elementType)
    schema = T.StructType([T.StructField("q", T.IntegerType()), doc, T.StructField("score", T.LongType())])
    rows = index.filter(F.size("ids") > 0).mapInArrow(search, schema)
    order = Window.partitionBy("q").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_first())
    best = rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    names = T.StructType([T.StructField("q", T.IntegerType()), item])
    # at most QUERY_BLOCK rows
    of = index.sparkSession.createDataFrame(list(enumerate(queries.items)), names)
    return durable(best.join(F.broadcast(of), "q").select("item_id", "rank", "doc_id", "score"))


def ranked(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", k: int = 20
) -> DataFrame:
    """`item_id, rank, doc_id, score`: the k best documents above 0 of each item, equal scores by ascending id.

    Null and empty texts have no terms and no rows. Of several items with one id the smallest text counts; a
    null id is an item like any other. Every row of `docs` is a document, also where ids repeat; a null id
    comes before all others. Only the named columns are read. Where a table is empty there are no rows.

    Items are taken QUERY_BLOCK at a time, each block against all documents; nothing but a block of items, its
    counts and its scores to beat passes through the driver.
    """
    docs = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    asked = items.select(F.col(f"`{item_col}`").alias("item_id"), F.col(f"`{item_text}`").alias("text"))
    item = asked.schema["item_id"]
    out, queries = None, Queries()

    def answered(queries: Queries) -> DataFrame | None:
        forward = _forward(docs, queries)
        n, tokens = forward.agg(F.count_if(F.col("n") > 0), F.sum("n")).first()
        if not n:
            return None
        holders = {r[0]: r[1] for r in forward.select(F.explode("terms").alias("t")).groupBy("t").count().collect()}
        queries.weigh(n, tokens, holders)
        return _searched(_index(forward, queries, k), queries, item, k)

    blocks, terms = [], 0
    texts = asked.groupBy("item_id").agg(F.min("text").alias("text")).filter("text != ''").orderBy("item_id")
    for row in texts.toLocalIterator():
        queries.add(row["item_id"], row["text"])
        terms += len(queries.terms[-1])
        if len(queries.items) >= QUERY_BLOCK or terms >= QUERY_TERMS:
            blocks.append(answered(queries))
            queries, terms = Queries(), 0
    if queries.words:
        blocks.append(answered(queries))
    for found in blocks:
        if found is not None:
            out = found if out is None else out.unionByName(found)
    if out is None:
        fields = [item, T.StructField("rank", T.IntegerType()), docs.schema["doc_id"], T.StructField("score", T.LongType())]
        return docs.sparkSession.createDataFrame([], T.StructType(fields))
    return out


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=20)


ORACLE = """
WITH terms AS (
    SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                             '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term
    FROM documents
), asked AS (
    SELECT item_id, term, count(*) AS times FROM (
        SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                  '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term
        FROM benchmark
    ) GROUP BY item_id, term
), lengths AS (
    SELECT doc_id, count(*) AS n FROM terms GROUP BY doc_id
), total AS (
    SELECT count(*) AS docs, sum(n)::BIGINT AS tokens FROM lengths
), postings AS (
    SELECT doc_id, term, count(*) AS tf FROM terms WHERE term IN (SELECT term FROM asked) GROUP BY doc_id, term
), weights AS (
    SELECT term, floor(1000 * ln((2 * docs + 2) / (2 * df + 1)))::BIGINT AS w
    FROM (SELECT term, count(*) AS df FROM postings GROUP BY term), total
), scored AS (
    SELECT item_id, doc_id,
           sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * docs) // tokens))))::BIGINT AS score
    FROM asked JOIN weights USING (term) JOIN postings USING (term) JOIN lengths USING (doc_id), total
    GROUP BY item_id, doc_id
)
SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INTEGER AS rank, doc_id, score
FROM scored WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 20
"""
