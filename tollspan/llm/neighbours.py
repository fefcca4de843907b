"""Nearest neighbours by cosine over randomly rotated one-bit codes, with error bounds that choose what is reranked.

A vector is made unit length, moved by the mean of all unit vectors, rotated and cut to its signs. The packed
signs and two scalars (the length and how well the signs stand for the direction) give an estimate of its inner
product with a query and a bound on the error. Only vectors whose upper bound reaches the fifth best lower bound
are compared exactly, in double precision, on the original vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tollspan.llm.common import table
from tollspan.session import durable

#: Standard deviations of the estimate's error that the bound takes in; one vector in about 160 lies above it.
BOUND = 2.5
#: Queries that meet a block of vectors together, and the blocks that vectors are dealt over.
QUERY_BLOCK, VECTOR_BLOCK = 2048, 4096
SEED = 5


@lru_cache(maxsize=8)
def rotation(dim: int) -> np.ndarray:
    """Random orthogonal matrix, the same in every task."""
    q, r = np.linalg.qr(np.random.default_rng((SEED, dim)).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def _units(rows: np.ndarray) -> np.ndarray:
    """Unit vectors; scaled first, so that squares neither overflow nor vanish."""
    rows = rows / np.abs(rows).max(1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(1, keepdims=True))


def encode(units: np.ndarray, centre: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed signs, length and alignment of the rotated differences from the centre."""
    moved = units - centre
    length = np.sqrt((moved * moved).sum(1))
    turned = (moved / np.where(length, length, 1.0)[:, None]) @ rotation(units.shape[1]).T
    aligned = np.abs(turned).sum(1) / np.sqrt(units.shape[1])  # inner product with the sign vector of unit length
    return np.packbits(turned > 0, axis=1), length, aligned


def bounds(query: np.ndarray, centre: np.ndarray, bits: np.ndarray, length: np.ndarray, aligned: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Estimated cosine of one unit query with every code, and the bound on its error."""
    dim = len(query)
    moved = query - centre
    far = np.sqrt(moved @ moved)
    turned = rotation(dim) @ (moved / far if far else moved)
    # the sum over set bits, a byte of the code at a time, from a table of all byte values
    padded = np.zeros(bits.shape[1] * 8)
    padded[:dim] = turned
    tables = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(float) @ padded.reshape(-1, 8).T
    on = tables[bits, np.arange(bits.shape[1])].sum(1)
    with np.errstate(divide="ignore", invalid="ignore"):
        direction = (2 * on - turned.sum()) / np.sqrt(dim) / aligned
        spread = np.sqrt(np.maximum(0.0, 1 - aligned**2)) / aligned * BOUND / np.sqrt(max(1, dim - 1))
    # <u, q> = <u - c, q - c> + <u, c> + <c, q> - <c, c>, and |u| = 1 gives <u, c> from the length
    with_centre = (1 + centre @ centre - length**2) / 2
    estimate = length * far * np.where(length > 0, direction, 0.0) + with_centre + centre @ query - centre @ centre
    return estimate, np.where(length > 0, length * far * spread, 0.0) + 1e-9


def cosines(query: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Cosine in double precision, every sum from the first dimension to the last."""
    dot, a, b = np.zeros(len(rows)), 0.0, np.zeros(len(rows))
    for k in range(len(query)):
        dot = dot + query[k] * rows[:, k]
        a = a + query[k] * query[k]
        b = b + rows[:, k] * rows[:, k]
    return dot / (np.sqrt(a) * np.sqrt(b))


def search_block(queries: pd.DataFrame, ids: np.ndarray, rows: np.ndarray, codes: tuple, centre: np.ndarray, top: int) -> list[tuple]:
    """The `top` nearest of one block of vectors for every query: (query id, vector id, cosine)."""
    out = []
    for query_id, query in queries.itertuples(index=False):
        query = np.asarray(query, float)
        estimate, error = bounds(_units(query[None])[0], centre, *codes)
        other = ids != query_id
        low = np.where(other, estimate - error, -np.inf)
        worst = np.partition(low, -top)[-top] if len(low) > top else -np.inf
        near = np.flatnonzero(other & (estimate + error >= worst))
        exact = cosines(query, rows[near])
        best = np.lexsort((ids[near], -exact))[:top]
        out += zip([query_id] * len(best), ids[near][best].tolist(), exact[best].tolist(), strict=True)
    return out


def nearest(
    vectors: DataFrame, queries: DataFrame, top: int = 5, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """`query_id, rank, vec_id, score`: the `top` nearest by cosine for every query, ties to the smaller id.

    Both tables have an id and an array column. Vectors that are null, empty, all zero, or hold a null or a
    non-finite component take no part, nor do rows without an id. A row never finds its own id. Vectors are only
    compared with vectors of as many dimensions. Rows that repeat an id and vector count once. Every query
    meets every block of vectors; a task holds one block of either, and hands on `top` rows a query.
    """
    parts = []
    for given in (vectors, queries):
        plain = given.select(F.col(id_col).alias("id"), F.transform(vector_col, lambda x: x.cast("double")).alias("v"))
        sound = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
        parts.append(durable(plain.filter(F.col("id").isNotNull() & sound).distinct().withColumn("dim", F.size("v"))))
    every, asked = parts
    sizes = {r["dim"]: r["n"] for r in every.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).collect()}
    spark = vectors.sparkSession
    found = None
    for dim, n in sorted(sizes.items()):
        part, ask = every.filter(F.col("dim") == dim), asked.filter(F.col("dim") == dim)
        blocks = max(1, -(-n // VECTOR_BLOCK))
        asked_blocks = max(1, -(-ask.count() // QUERY_BLOCK))
        centre = _centre(part, dim, n)
        sent = spark.sparkContext.broadcast(centre)
        here = _search(part, ask, blocks, asked_blocks, sent, top)
        found = here if found is None else found.unionByName(here)
    if found is None:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    # repeated ids with different vectors: the nearest counts
    once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    ranked = once.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return ranked.select("query_id", "rank", "vec_id", "score")


def _centre(part: DataFrame, dim: int, n: int) -> np.ndarray:
    """Mean of the unit vectors, from one row of sums a task."""

    def add(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(dim)
        for frame in frames:
            if len(frame):
                total += _units(np.array(frame["v"].tolist(), float)).sum(0)
        yield pd.DataFrame({"k": np.arange(dim), "s": total})

    sums = part.select("v").mapInPandas(add, "k bigint, s double").groupBy("k").agg(F.sum("s").alias("s")).orderBy("k").collect()
    return np.array([r["s"] for r in sums]) / n


def _search(part: DataFrame, ask: DataFrame, blocks: int, asked_blocks: int, sent, top: int) -> DataFrame:
    deal = F.pmod(F.xxhash64("id", "v"), F.lit(1 << 30)).cast("int")
    left = part.select(
        F.pmod(deal, F.lit(blocks)).alias("block"), F.explode(F.sequence(F.lit(0), F.lit(asked_blocks - 1))).alias("asked"), "id", "v"
    )
    right = ask.select(
        F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.pmod(deal, F.lit(asked_blocks)).alias("asked"), "id", "v"
    )

    def meet(rows: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if len(rows) and len(queries):
            centre = sent.value
            vectors = np.array(rows["v"].tolist(), float)
            codes = encode(_units(vectors), centre)
            out = search_block(queries[["id", "v"]], rows["id"].to_numpy(), vectors, codes, centre, top)
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

    return left.groupBy("block", "asked").cogroup(right.groupBy("block", "asked")).applyInPandas(
        meet, "query_id bigint, vec_id bigint, score double"
    )


def op2_rotated_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest(vectors, vectors.filter("vec_id % 50 = 0"), top=5)


ORACLE = """
WITH sound AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
lengths AS (
  SELECT vec_id, v, sqrt(list_reduce(list_prepend(CAST(0 AS DOUBLE), list_transform(v, lambda x: x * x)), lambda a, x: a + x)) AS n FROM sound),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         list_reduce(list_prepend(CAST(0 AS DOUBLE), list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])), lambda a, x: a + x)
           / (q.n * c.n) AS score
  FROM lengths q JOIN lengths c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0),
once AS (SELECT query_id, vec_id, max(score) AS score FROM scored GROUP BY ALL),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM once)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""
