"""SimHash near-duplicates: segment bit counts as a grid, Manhattan distance as a lower bound, exact check.

Of a 64-bit fingerprint, the bit counts of its 32 two-bit segments form a vector with entries 0, 1, 2. The
Manhattan distance of two such vectors is never above the Hamming distance, so two fingerprints that differ
in at most two bits meet in a grid point one step or less from both. Fingerprints alone in all their grid
points are out; of the others, those that meet in one and the same 64-bit value, one flipped bit or less
from each, are exactly the pairs at two or fewer bits, and all that meet there are linked with one another.
At most 65 fingerprints meet in a value, so links are written as a star and never as pairs of a group.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tollspan.llm.common import words_of
from tollspan.llm.graph import components
from tollspan.session import durable

SEED = 42


def shingle_hashes(text: str | None, size: int) -> np.ndarray:
    """XXH64 (seed 42) of every word shingle, repeats included; a shorter text is one shingle."""
    import xxhash

    words = words_of(text)
    if not words:
        return np.empty(0, np.uint64)
    if len(words) <= size:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(size)), strict=False))
    return np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64)


def simhash(hashes: np.ndarray, block: int = 1 << 16) -> int:
    """Signed 64-bit fingerprint: a bit is 1 when it is set in over half the hashes; none: 0."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), block):
        bits = np.unpackbits(hashes[at : at + block].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(0, dtype=np.int64)
    ones = np.packbits(counts * 2 > len(hashes), bitorder="little")
    return int(ones.view("<i8")[0])


def fingerprint(text: Column, size: int) -> Column:
    @F.pandas_udf("long")
    def fingerprints(texts: pd.Series) -> pd.Series:
        return pd.Series([simhash(shingle_hashes(t, size)) for t in texts], dtype="int64")

    return fingerprints(text)


def with_grid_points(fingerprints: DataFrame) -> DataFrame:
    """`(fp, cell)`: the point of a fingerprint's bit counts, packed two bits an entry, and all points one step away."""
    odd = 6148914691236517205  # every second bit
    pair = f"shiftrightunsigned(fp, 1) & {odd}"
    point = f"((fp & {odd}) ^ ({pair})) | shiftleft(fp & {pair}, 1)"
    entry = "(shiftrightunsigned(point, 2 * i) & 3)"
    around = f"""concat(array(point),
        transform(sequence(0, 31), i -> point ^ shiftleft(IF({entry} = 2, 3L, 1L), 2 * i)),
        transform(filter(sequence(0, 31), i -> {entry} = 1), i -> point ^ shiftleft(3L, 2 * i)))"""
    return fingerprints.select("fp", F.expr(point).alias("point")).select("fp", F.explode(F.expr(around)).alias("cell"))


def near_links(fingerprints: DataFrame, radius: int = 2) -> DataFrame:
    """Links `(a, b)` among distinct values of column `fp`, as stars that connect all pairs within `radius` bits."""
    if radius not in (0, 1, 2):
        raise ValueError("radius must be 0, 1 or 2")
    distinct = fingerprints.select("fp").distinct()
    if not radius:
        return distinct.select(F.col("fp").alias("a"), F.col("fp").alias("b")).filter("a != b")
    cells = with_grid_points(distinct)
    shared = cells.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("cell")
    close = cells.join(shared, "cell", "left_semi").select("fp").distinct()
    flips = F.expr("concat(array(fp), transform(sequence(0, 63), i -> fp ^ shiftleft(1L, i)))")
    met = (
        close.select("fp", F.explode(flips).alias("value"))
        .groupBy("value")
        .agg(F.collect_set("fp").alias("fps"))
        .filter(F.size("fps") > 1)
    )
    if radius == 1:
        met = met.filter(F.array_contains("fps", F.col("value"))).withColumn("hub", F.col("value"))
    else:
        met = met.withColumn("hub", F.array_min("fps"))
    return met.select(F.explode("fps").alias("a"), F.col("hub").alias("b")).filter("a != b")


def near_duplicate_classes(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, shingle: int = 3, radius: int = 2
) -> DataFrame:
    """One row per row of `docs`: `doc_id, fp (signed 64 bits), component_id`.

    Fingerprints link at `radius` or fewer differing bits; component_id is the smallest id reachable. Null and
    empty texts have fingerprint 0 and link like any other. A null id gets a row and is never a component_id
    unless its component holds no other id (then null). Rows with the same id are all kept. Only the two named
    columns are read. An empty table gives no rows.
    """
    fps = durable(docs.select(F.col(id_col).alias("doc_id"), fingerprint(F.col(text_col), shingle).alias("fp")))
    nodes = durable(fps.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    labels = components(near_links(nodes, radius))
    named = nodes.join(labels.withColumnRenamed("node", "fp"), "fp", "left")
    linked = named.filter("label IS NOT NULL")
    whole = linked.groupBy("label").agg(F.min("first_id").alias("component_id"))
    # fingerprints without a link stay out of the join by label, where they would all be one null key
    alone = named.filter("label IS NULL").select("fp", F.col("first_id").alias("component_id"))
    classes = linked.join(whole, "label").select("fp", "component_id").unionByName(alone)
    return fps.join(classes, "fp").select("doc_id", "fp", "component_id")


def op6_simhash(spark, sf_dir: str) -> DataFrame:
    from tollspan.llm.common import table

    found = near_duplicate_classes(table(spark, sf_dir, "documents"), shingle=3, radius=2)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
