"""Near copies by word shingles at a given Jaccard similarity: SimHash links and exact prefix filtering.

One 64-bit fingerprint of a whole text tells copies apart only when they share almost all shingles: at a
similarity of 0.8 about ten bits differ. So besides the links of `simhash`, texts meet in single shingles. All
shingles stand in one order, rarest first; of a text with n shingles only the first n - ceil(similarity n) + 1 are
keys, and two texts that reach the similarity have one of those in common, whatever the order is. With frequent
shingles last, a passage that many texts share is seldom a key. Frequencies come from a counter table of
fixed size over all texts. Every candidate is then checked exactly on the shingle sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tollspan.llm.common import free_name
from tollspan.llm.graph import components
from tollspan.llm.simhash import near_links, shingle_hashes, simhash
from tollspan.session import dealt, durable, swept

#: Counters (2 to this power) of the frequency table, and the parts it is summed in.
COUNTER_BITS, COUNTER_PARTS = 22, 64
#: Members of a key that are compared with one another, or with as many others, in one place.
BLOCK = 256
#: 64-bit words of the parity bits that tell two texts apart before their sets are read.
PARITY_WORDS = 16
#: Texts that are worked on at a time.
TEXTS = 500
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _counter(shingles: np.ndarray) -> np.ndarray:
    return ((shingles * _MIX) >> np.uint64(64 - COUNTER_BITS)).astype(np.int64)


def frequency_classes(docs: DataFrame, text_col: str = "text", *, shingle: int = 5) -> np.ndarray:
    """One byte a counter: 0 for shingles as frequent as chance makes any counter, else four steps for each doubling.

    A shingle is counted once a row. The table has the same size for any input: a task sends COUNTER_PARTS
    packed parts of it, each summed as a stream, and the sums come to the driver.
    """
    import zstandard

    width = 1 << COUNTER_BITS
    size = width // COUNTER_PARTS

    def packed(values: np.ndarray, number: int) -> pa.RecordBatch:
        data = zstandard.ZstdCompressor(level=1).compress(values.astype(np.uint32).tobytes())
        return pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), pa.array([data], pa.binary())], names=["part", "counts"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width, np.uint32)
        for batch in batches:
            texts = batch.column(0)
            for at in range(0, len(texts), TEXTS):
                places = [_counter(np.unique(shingle_hashes(t, shingle))) for t in texts.slice(at, TEXTS).to_pylist()]
                place, times = np.unique(np.concatenate(places), return_counts=True)
                total[place] += times.astype(np.uint32)
        for number in range(COUNTER_PARTS):
            part = total[number * size : (number + 1) * size]
            if part.any():
                yield packed(part, number)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for number, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                values = np.frombuffer(zstandard.ZstdDecompressor().decompress(data.as_py()), np.uint32)
                sums[number] = sums[number] + values if number in sums else values.astype(np.int64)
        for number, values in sums.items():
            yield packed(np.minimum(values, 0xFFFFFFFF), number)

    kind = "part int, counts binary"
    total = np.zeros(width, np.int64)
    for r in docs.select(text_col).mapInArrow(count, kind).repartition("part").mapInArrow(add, kind).collect():
        values = np.frombuffer(zstandard.ZstdDecompressor().decompress(bytes(r["counts"])), np.uint32)
        total[r["part"] * size : (r["part"] + 1) * size] = values
    chance = total.mean()
    above = total - chance - 3 * math.sqrt(chance) - 1
    return np.where(above > 0, np.minimum(255, 1 + 4 * np.log2(1 + np.maximum(above, 0))), 0).astype(np.uint8)


def part_keys(shingles: np.ndarray, similarity: float, classes: np.ndarray | None = None) -> list[int]:
    """The first shingles (distinct, ascending) of a text, rarest first: as many as it takes to miss no similar text."""
    n = len(shingles)
    if not n:
        return []
    lead = n - math.ceil(similarity * n - 1e-9) + 1
    if classes is None:
        return shingles[:lead].view(np.int64).tolist()
    return shingles[np.lexsort((shingles, classes[_counter(shingles)]))[:lead]].view(np.int64).tolist()


def parity_bits(shingles: np.ndarray) -> np.ndarray:
    """Of each of 64 * PARITY_WORDS buckets, whether an odd number of the shingles fall into it.

    Two texts differ in at most as many of these bits as there are shingles that only one of them has.
    """
    width = 64 * PARITY_WORDS
    odd = np.bincount(((shingles * _MIX) >> np.uint64(32)).astype(np.int64) % width, minlength=width) & 1
    return np.packbits(odd.astype(bool), bitorder="little").view(np.int64)


def _near_enough(similarity: float) -> Column:
    """Whether parity bits x and y of texts of n and m shingles leave the similarity possible."""
    apart = F.lit(0)
    for i in range(PARITY_WORDS):
        apart = apart + F.bit_count(F.col("x")[i].bitwiseXOR(F.col("y")[i]))
    return apart <= (F.col("n") + F.col("m")) * ((1 - similarity) / (1 + similarity)) + 1e-6


def _leads(n: Column, similarity: float) -> Column:
    """How many of a text's keys count towards texts of its own size or larger ones.

    The shorter of two similar texts has 2 similarity / (1 + similarity) of its n shingles in common with the other at
    least, so fewer of its keys do. A text whose own rare shingles fill them meets none of its kind.
    """
    return n - F.ceil(n * (2 * similarity / (1 + similarity)) - 1e-9) + 1


def _fitting(similarity: float) -> Column:
    """Sizes n and m that allow the similarity."""
    return F.least("n", "m") >= F.lit(similarity) * F.greatest("n", "m")


def _alike(pairs: DataFrame, held: DataFrame, similarity: float) -> DataFrame:
    """Those of the pairs `(a, b)` whose sets of hashes reach the similarity.

    The sets lie dealt out by node, so only pairs and the one set that they bring along are shuffled. Members bring
    none to a hub `b` that many have in common: it is looked up first, and its set goes to them.
    """
    both = pairs.join(held.toDF("b", "y"), "b").join(held.toDF("a", "x"), "a")
    shared = F.size(F.array_intersect("x", "y"))
    union = F.size("x") + F.size("y") - shared
    return durable(both.filter((shared >= F.lit(similarity) * union) | (union == 0)).select("a", "b"))


def _ordered(pairs: DataFrame) -> DataFrame:
    """Each pair once, whichever way round; `b` is one that stood there."""
    ends = pairs.select(F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high"), (F.col("a") < F.col("b")).alias("up"))
    once = ends.groupBy("low", "high").agg(F.max("up").alias("up"))
    return durable(once.select(F.when(F.col("up"), F.col("low")).otherwise(F.col("high")).alias("a"), F.when(F.col("up"), F.col("high")).otherwise(F.col("low")).alias("b")))


def _joined(members: DataFrame, held: DataFrame, bits: DataFrame, similarity: float) -> DataFrame:
    """`(node, label)` of the components that all pairs with a key in common (`key, node, n, short, central`) make.

    Two texts of a key are a pair where the smaller has it among its short keys. A turn compares two members of each
    key with all others; they are then done in that key, and a key whose other members are in one component is
    settled. Turns go on while they settle a quarter of what is open. What remains is compared pair by pair, a large
    key in square blocks, so that no task holds a whole group; parity bits rule out most pairs there.
    """
    links, labels, left = None, None, None
    while True:
        hubs = members.groupBy("key").agg(F.max(F.struct("central", "node", "n")).alias("top"), F.min(F.struct("node", "n")).alias("first"))
        met = members.join(hubs, "key")
        two = F.explode(F.array(F.struct("top.node", "top.n"), F.col("first"))).alias("h")
        pairs = met.select(F.col("node").alias("a"), "n", two, *([F.col("label")] if links else []))
        pairs = pairs.select("a", F.col("h.node").alias("b"), "n", F.col("h.n").alias("m"), *(["label"] if links else [])).filter("a != b")
        pairs = pairs.filter(_fitting(similarity))
        if links:
            other = labels.select(F.col("node").alias("b"), F.col("label").alias("other"))
            pairs = pairs.join(other, "b", "left").filter(F.col("label") != F.coalesce("other", "b"))
        found = _alike(_ordered(pairs), held, similarity)
        links = links.unionByName(found) if links else found
        labels = durable(components(links))
        rest = met.filter("node != top.node AND node != first.node").select("key", "node", "n", "short", "central")
        named = durable(rest.join(labels, "node", "left").select(*rest.columns, F.coalesce("label", "node").alias("label")))
        spread = named.groupBy("key").agg(
            F.min("label").alias("low"), F.max("label").alias("high"), F.count(F.lit(1)).alias("rows"), F.max("short").alias("any")
        )
        members = durable(named.join(spread.filter("low < high AND any").select("key", "rows"), "key"))
        before, left = left, members.count()
        if not left:
            return labels
        if before is not None and left > before * 3 // 4:
            break
    cuts = F.ceil(F.col("rows") / BLOCK)
    block = F.pmod(F.xxhash64("node", F.lit(5)), cuts)
    placed = members.join(bits, "node").select("key", "node", "label", "n", "short", "bits", block.alias("at"), (cuts - 1).alias("last"))
    one = placed.select("key", F.col("bits").alias("x"), F.col("node").alias("a"), F.col("label").alias("of_a"), "n", F.col("short").alias("short_a"),
                        F.col("at").alias("i"), F.explode(F.sequence("at", "last")).alias("j"))
    two = placed.select("key", F.col("bits").alias("y"), F.col("node").alias("b"), F.col("label").alias("of_b"), F.col("n").alias("m"), F.col("short").alias("short_b"),
                        F.col("at").alias("j"), F.explode(F.sequence(F.lit(0).cast("bigint"), "at")).alias("i"))
    once = "of_a != of_b AND (i < j OR a < b)"
    smaller = ((F.col("n") <= F.col("m")) & F.col("short_a")) | ((F.col("m") <= F.col("n")) & F.col("short_b"))
    met = one.join(two, ["key", "i", "j"]).filter(F.expr(once) & smaller & _fitting(similarity) & _near_enough(similarity))
    return components(links.unionByName(_alike(_ordered(met.select("a", "b")), held, similarity)))


def near_copy_classes(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, shingle: int = 5, similarity: float = 0.8
) -> DataFrame:
    """`digest, id, component`: one row per distinct text, with its smallest id; near copies share a component.

    Shingle sets are compared as sets of 32-bit hashes. Any two texts with a key in common end in one component or
    are compared: first the most central and the first member of the key with all others, and so on with those
    that are left as long as this joins groups; then all pairs that are still in two components. So a large group
    of copies gives a few pairs for each member.
    """
    classes = docs.sparkSession.sparkContext.broadcast(frequency_classes(docs, text_col, shingle=shingle))

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS):
                part = batch.slice(at, TEXTS)
                fps, sizes, centrals, keys, hashes, bits = [], [], [], [], [], []
                for text in part.column("text").to_pylist():
                    every = shingle_hashes(text, shingle)
                    one = np.unique(every)
                    fps.append(simhash(every))
                    sizes.append(len(one))
                    bits.append(parity_bits(one))
                    keys.append(np.array(part_keys(one, similarity, classes.value), np.int64))
                    # the text that others are copies of has few shingles of its own
                    centrals.append(int((classes.value[_counter(keys[-1].view(np.uint64))] > 0).sum()))
                    hashes.append(np.unique((one >> np.uint64(32)).astype(np.uint32)).view(np.int32))
                made = [pa.array(fps, pa.int64()), pa.array(sizes, pa.int32()), pa.array(centrals, pa.int32()), pa.array(keys, pa.list_(pa.int64())), pa.array(hashes, pa.list_(pa.int32()))]
                made.append(pa.array(bits, pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays([part.column(c) for c in ("digest", "node", "id")] + made, names=schema.names)

    digest = F.sha2(F.coalesce(text_col, F.lit("")), 256).alias("digest")
    texts = docs.select(digest, F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    texts = texts.select("digest", F.xxhash64("digest").alias("node"), "id", "text")
    made = "fp long, n int, central int, keys array<long>, hashes array<int>, bits array<long>"
    schema = T.StructType([*texts.drop("text").schema.fields, *T.StructType.fromDDL(made).fields])
    # a map over the rows: copies of a text are worked out again, but no text is shuffled for it; what copies share is
    # the same for all, any will do. All that is read later by node is shuffled here and then lies where it is
    same = [F.first(c).alias(c) for c in schema.names[3:]]
    best = F.min(F.struct(F.col("id").isNull().alias("null"), "id", "digest")).alias("best")
    once = texts.mapInArrow(prints, schema).groupBy("node").agg(best, *same)
    nodes = dealt(once.select("best.digest", "node", "best.id", *schema.names[3:]), "node")
    whole = near_links(nodes, 2).select(F.explode(F.array("a", "b")).alias("fp"), F.col("b").alias("hub"))
    # most rows are single and go no further, so they are kept narrow: size, role and rank in one number
    shape = F.shiftleft(F.col("central").cast("bigint"), 33).bitwiseOR(F.shiftleft(F.col("n").cast("bigint"), 1))
    by_print = nodes.select("node", "fp", shape.bitwiseOR(F.lit(1)).alias("shape"))
    # texts whose whole fingerprints meet in a hub form a group, like those that share a key; so do equal ones
    met = by_print.join(whole.distinct(), "fp").select("node", "shape", F.xxhash64("hub", F.lit("whole")).alias("key"))
    equal = by_print.select("node", "shape", F.xxhash64("fp", F.lit("print")).alias("key"))
    parts = nodes.select("node", "n", shape.alias("shape"), F.posexplode("keys").alias("at", "key"))
    short = (F.col("at") < _leads(F.col("n"), similarity)).cast("bigint")
    members = parts.select("node", F.col("shape").bitwiseOR(short).alias("shape"), "key").unionByName(equal).unionByName(met)
    # nearly all keys are single, so summing before the shuffle saves nothing: dealt once, for the sums and the join
    members = members.repartition("key")
    sizes = members.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high"), F.max(F.col("shape") % 2).alias("any"))
    grouped = members.join(sizes.filter("low < high AND any = 1").select("key"), "key").distinct()
    n = F.shiftright("shape", 1).bitwiseAND(F.lit((1 << 32) - 1)).cast("int")
    ranked = durable(grouped.select("key", "node", n.alias("n"), (F.col("shape") % 2 == 1).alias("short"), F.shiftright("shape", 33).cast("int").alias("central")))
    labels = _joined(ranked, nodes.select("node", "hashes"), nodes.select("node", "bits"), similarity)
    return nodes.join(labels, "node", "left").select(
        "digest", "id", F.coalesce("label", "node").alias("component")
    )


def drop_near_copies(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, shingle: int = 5, similarity: float = 0.8
) -> DataFrame:
    """`docs` with one row of each group of near copies: that of the smallest id.

    Copies are texts whose sets of word shingles reach the similarity, linked over any number of steps; texts
    of fewer words than a shingle are one shingle. Null and empty texts are copies of one another. A null id
    stays only where its group has no other. Rows with the same id and text count once. All columns stay.
    """
    digest, taken = free_name(docs.columns, "_digest"), free_name(docs.columns, "_turn")
    of = F.sha2(F.coalesce(text_col, F.lit("")), 256)
    best = F.min(F.struct(F.col("id").isNull().alias("null"), F.col("id"), F.col("digest")))
    with swept(docs.sparkSession):
        classes = near_copy_classes(docs, id_col, text_col, shingle=shingle, similarity=similarity)
        kept = durable(classes.groupBy("component").agg(best.alias("k")).select("k.id", "k.digest"))
    # one key for the join and the choice among rows of an id and text, so that texts are shuffled once; null ids are equal in it
    marked = docs.withColumn(digest, F.struct(of.alias("digest"), F.col(id_col).alias("id")))
    found = marked.join(kept.select(F.struct("digest", "id").alias(digest)), digest)
    order = Window.partitionBy(digest).orderBy(*[F.col(f"`{c}`").asc_nulls_first() for c in docs.columns if c != text_col])
    return found.withColumn(taken, F.row_number().over(order)).filter(F.col(taken) == 1).select(*[F.col(f"`{c}`") for c in docs.columns])
