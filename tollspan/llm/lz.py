"""Lempel-Ziv phrase fingerprints: dictionary phrases of a document, hashed, kept as minimum-hash signatures."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HASHES = 128
#: Odd multipliers, so that each product permutes the 64-bit numbers.
_FACTORS = np.random.default_rng(11).integers(0, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MIX = np.uint64(0x9E3779B97F4A7C15)
_NONE = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
#: Ranges of ids dealt out for each shuffle partition.
RANGES = 4


def parse(text: str, seen: set[str], phrase: str = "") -> str:
    """Adds the phrases of `text` to the dictionary `seen`; returns the phrase still open at its end.

    A phrase is the shortest run of characters, from where the last one ended, that the dictionary lacks.
    """
    add = seen.add
    for c in text:
        phrase += c
        if phrase not in seen:
            add(phrase)
            phrase = ""
    return phrase


def smallest(phrases: Iterable[str], count: int) -> np.ndarray:
    """Smallest value of each of the hash permutations over the phrases."""
    import xxhash

    low = _NONE
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, phrases, repeat(0)), np.uint64, count)
    for at in range(0, count, 2048):
        low = np.minimum(low, (hashes[at : at + 2048, None] * _FACTORS).min(0))
    return low


def signature(low: np.ndarray) -> str:
    """16 mixed bits of each smallest value, in hex; a text without phrases, and only that, has only f.

    The smallest of many values begins with zeros, so its upper bits say ever less about it as texts grow.
    """
    mixed = (low ^ (low >> np.uint64(32))) * _MIX
    bits = np.minimum(mixed >> np.uint64(48), np.uint64(0xFFFE))
    return np.where(low == _NONE, np.uint64(0xFFFF), bits).astype(">u2").tobytes().hex()


def likeness(a: str, b: str) -> float:
    """Share of equal places of two signatures, an estimate of the Jaccard index of the phrase sets."""
    x, y = (np.frombuffer(bytes.fromhex(s), ">u2") for s in (a, b))
    return float((x == y).mean())


class Parsed:
    """A text with the signature of the whole and, kept for edits, the state of its parse before the last half."""

    def __init__(self, text: str) -> None:
        self.text, self.kept = text, len(text) - len(text) // 2
        self.seen: set[str] = set()
        self.open = parse(text[: self.kept], self.seen)
        self.low_kept = smallest(self.seen, len(self.seen))
        whole = set(self.seen)
        left = parse(text[self.kept :], whole, self.open)
        whole -= self.seen
        if left:  # the phrase that the end cuts off is in the dictionary already
            whole.add(left)
        self.low = np.minimum(self.low_kept, smallest(whole, len(whole)))
        self.fingerprint = signature(self.low)

    def edited(self, following: str) -> tuple[str, str]:
        """Text and fingerprint with the last half replaced by as much (or all) of the following text."""
        added = following[: len(self.text) - self.kept]
        if added:
            seen = set(self.seen)
            left = parse(added, seen, self.open)
            seen -= self.seen
            if left:
                seen.add(left)
            low = np.minimum(self.low_kept, smallest(seen, len(seen)))
        elif self.open:
            low = np.minimum(self.low_kept, smallest([self.open], 1))
        else:
            low = self.low_kept
        return self.text[: self.kept] + added, signature(low)


def ranged(docs: DataFrame, order_col: str, payload: list[str]) -> DataFrame:
    """Rows in ranges of `order_col`, sorted inside a partition, each range followed by the next one's first row.

    Adds `_range` and `_after` (true for that repeated row; the last range is followed by the very first row).
    The ranges come from approximate quantiles of the order column; only their bounds and first values, one a
    range, pass through the driver.
    """
    spark = docs.sparkSession
    n = max(2, RANGES * int(spark.conf.get("spark.sql.shuffle.partitions")))
    cuts = docs.agg(F.percentile_approx(order_col, [i / n for i in range(1, n)], 100 * n)).first()[0] or []
    cuts = sorted(set(cuts))
    number = F.coalesce(F.expr(f"array_size(filter(array({', '.join(f'{c}L' for c in cuts)}), c -> c < `{order_col}`))"), F.lit(0)) if cuts else F.lit(0)
    firsts = docs.groupBy(number.alias("_range")).agg(F.min(F.struct(order_col)).alias("first")).orderBy("_range").select("_range", f"first.{order_col}").collect()
    before = {firsts[i][1]: firsts[i - 1][0] for i in range(len(firsts))}
    pairs = [x for k, v in before.items() if k is not None for x in (F.lit(k), F.lit(v))]
    host = F.create_map(*pairs)[F.col(order_col)] if pairs else F.lit(None).cast("int")
    if None in before:
        host = F.when(F.col(order_col).isNull(), F.lit(before[None])).otherwise(host)
    own = F.struct(number.cast("int").alias("_range"), F.lit(False).alias("_after"))
    again = F.struct(host.cast("int").alias("_range"), F.lit(True).alias("_after"))
    dealt = docs.select(*payload, F.inline(F.when(host.isNull(), F.array(own)).otherwise(F.array(own, again))))
    return dealt.repartition("_range").sortWithinPartitions("_range", "_after", *payload)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of all texts and of their edits by the next document, in ascending id.

    Columns: doc_id, n_chars (code points), edited_text, fingerprint, edited_fingerprint, near_edited,
    near_next. Null texts are empty; a text without phrases is like another such text (1.0) and like no other.
    Null ids come first; rows with one id come in the order of their texts. A single row is its own next
    document. An empty table gives no rows. Only the two named columns are read.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    plain = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        place = last = None  # the range and the (id, parse) that wait for their next document
        for frame in frames:
            out = []
            for doc_id, text, at, after in frame.itertuples(index=False):
                if at != place:
                    place, last = at, None
                elif last is None:
                    continue  # the range has met its next document
                now = Parsed(text)
                if last is not None:
                    edited, print_edited = last[1].edited(text)
                    out.append(
                        (last[0], len(last[1].text), edited, last[1].fingerprint, print_edited,
                         likeness(last[1].fingerprint, print_edited), likeness(last[1].fingerprint, now.fingerprint))
                    )
                last = None if after else (doc_id, now)
            frame = pd.DataFrame(out, columns=[c.split()[0] for c in fields])
            frame["doc_id"] = frame["doc_id"].astype("Int64") if kind in ("bigint", "int") else frame["doc_id"]
            yield frame

    fields = [f"doc_id {kind}", "n_chars bigint", "edited_text string", "fingerprint string", "edited_fingerprint string",
              "near_edited double", "near_next double"]
    return ranged(plain, "doc_id", ["doc_id", "text"]).mapInPandas(run, ", ".join(fields))


def op1_lz_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tollspan.llm.common import table

    found = fingerprints(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_chars", F.sha2("edited_text", 256).alias("edited_sha256"),
        "fingerprint", "edited_fingerprint", "near_edited", "near_next",
    )
