"""URL verdicts: longest host and path rule, else exact list membership by a cascade of Bloom filters.

Level 0 holds the listed keys, level 1 the keys of the universe outside the list that pass level 0, level 2 the
listed keys that pass level 1, and so on until none is left over. The first level that a key does not pass tells
on which side it is, for every key of the universe. All of it is DataFrame and SQL functions.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tollspan.llm.common import LOWER, UPPER, free_name, table
from tollspan.session import durable

RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
BITS_PER_KEY, HASHES = 12, 5
#: A host is listed if a block rule fits one in so many of its pages, or more.
BLOCKED_IN = 4
#: Bytes of filters that go to the executors as part of the plan; larger cascades are cut into shards of this size.
MOST_BYTES = 1 << 20


def _after_scheme(url: Column) -> Column:
    """What follows the first `://`; empty for a null url or one without it."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1), F.lit(""))


def host_of(url: Column) -> Column:
    """From behind the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased."""
    return F.translate(F.regexp_extract(_after_scheme(url), r"^[^/?#]*", 0), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """From behind the host up to `?`, `#` or the end."""
    return F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1)


def longest_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> Column:
    """Struct `rule, verdict` of the longest rule (ties to the first by text) that fits; nulls where none does.

    A rule fits its host and all subdomains where the path starts with the rule's. The rules are part of the
    plan, so they should be a short list; long lists belong in the cascade.
    """
    found = F.lit(None).cast("struct<rule: string, verdict: string>")
    for verdict, at, start in sorted(rules, key=lambda r: (len(r[1] + r[2]), [-ord(c) for c in r[1] + r[2]])):
        fits = ((host == at) | host.endswith(f".{at}")) & path.startswith(start)
        found = F.when(fits, F.struct(F.lit(at + start).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def _places(key: Column, level: int, bits: int) -> list[Column]:
    """The key's bits in a level: a 31-bit start and an odd step from one hash seeded by the level."""
    h = F.xxhash64(key, F.lit(level))
    start, step = h.bitwiseAND(F.lit(0x7FFFFFFF)), F.shiftrightunsigned(h, 33).bitwiseOR(F.lit(1))
    return [F.pmod(start + step * F.lit(i), F.lit(bits)) for i in range(HASHES)]


def _passes(key: Column, level: int, bits: int, words: Column) -> Column:
    """Whether all of the key's bits are set in the level's words."""
    passed = F.lit(True)
    for place in _places(key, level, bits):
        word = F.get(words, F.shiftright(place, 6).cast("int"))
        passed &= F.getbit(word, F.pmod(place, F.lit(64)).cast("int")) == 1
    return passed


class Cascade:
    """Exact membership for every key of the universe it was built over."""

    def __init__(self, bits: list[int], shards: int, words: DataFrame) -> None:
        self.bits, self.shards, self.words = bits, shards, words

    def shard(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key, F.lit(-1)), F.lit(self.shards)).cast("int")

    def _listed(self, key: Column, levels: list[Column]) -> Column:
        listed = F.lit(len(self.bits) % 2 == 1)  # passes all levels: in the set that the last one holds
        for level in reversed(range(len(self.bits))):
            listed = F.when(~_passes(key, level, self.bits[level], levels[level]), F.lit(level % 2 == 1)).otherwise(listed)
        return listed

    def mark(self, rows: DataFrame, key: Column, name: str) -> DataFrame:
        """`rows` with the boolean column `name`: is the key listed. A null key is not.

        A cascade of up to MOST_BYTES is part of the plan, so there is no join and no shuffle. A larger one has a
        row for each shard, and rows meet the row of their key's shard; large shards are split by Spark's
        skew-join handling.
        """
        if self.shards == 1:
            held = {r["level"]: r["words"] for r in self.words.collect()}
            levels = [F.from_json(F.lit(json.dumps(held[k])), "array<bigint>") for k in range(len(self.bits))]
            return rows.withColumn(name, F.coalesce(self._listed(key, levels), F.lit(False)) & key.isNotNull())
        at, cells = free_name(rows.columns, "_shard"), free_name(rows.columns, "_words")
        by_shard = self.words.groupBy("shard").agg(F.map_from_entries(F.collect_list(F.struct("level", "words"))).alias(cells))
        met = rows.withColumn(at, F.coalesce(self.shard(key), F.lit(-1))).join(by_shard.withColumnRenamed("shard", at), at, "left")
        levels = [F.col(cells)[F.lit(k)] for k in range(len(self.bits))]
        return met.withColumn(name, F.coalesce(self._listed(key, levels), F.lit(False)) & key.isNotNull()).drop(at, cells)


def build_cascade(keys: DataFrame, most_bytes: int = MOST_BYTES) -> Cascade:
    """Cascade from `(key, listed)` rows, which must hold every key that will be asked for.

    A key with several rows is listed if one of them says so; null keys are left out. Filters take BITS_PER_KEY
    bits for each key of their level. The sets of a level are written and shrink from level to level; the driver
    sees their sizes and, where all filters fit into `most_bytes`, the filters. No key at all: nothing is listed.
    """
    every = keys.filter("key is not null").groupBy("key").agg(F.max(F.coalesce("listed", F.lit(False))).alias("listed"))
    held = durable(every)
    total = held.filter("listed").count()
    shards = max(1, -(-total * BITS_PER_KEY // (8 * most_bytes // 2)))  # the first level takes half of the bytes or less
    cascade = Cascade([], shards, None)
    inside, outside = held.filter("listed").select("key"), held.filter("not listed").select("key")
    written: list[DataFrame] = []
    while True:
        level = len(cascade.bits)
        sized = inside.groupBy(cascade.shard(F.col("key")).alias("shard")).agg(F.count(F.lit(1)).alias("n"))
        most = sized.agg(F.max("n")).first()[0]
        if most is None and level:
            break
        bits = 64 * max(1, -(-(most or 0) * BITS_PER_KEY // 64))
        zero = keys.sparkSession.range(shards).select(
            F.col("id").cast("int").alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(bits // 64 - 1))).alias("word"), F.lit(0).cast("bigint").alias("b")
        )
        ones = inside.select(
            cascade.shard(F.col("key")).alias("shard"), F.explode(F.array(*_places(F.col("key"), level, bits))).alias("p")
        ).select("shard", F.shiftright("p", 6).cast("int").alias("word"), F.expr("shiftleft(1L, CAST(p % 64 AS INT))").alias("b"))
        words = durable(
            ones.unionByName(zero)
            .groupBy("shard", "word")
            .agg(F.bit_or("b").alias("b"))
            .groupBy("shard")
            .agg(F.array_sort(F.collect_list(F.struct("word", "b"))).alias("w"))
            .select("shard", F.lit(level).alias("level"), F.col("w.b").alias("words"))
        )
        written.append(words)
        cascade.bits.append(bits)
        step = Cascade([bits], shards, words)
        passing = durable(_passing(outside, step, level))
        inside, outside = passing, inside
    cascade.words = written[0]
    for words in written[1:]:
        cascade.words = cascade.words.unionByName(words)
    return cascade


def _passing(keys: DataFrame, step: Cascade, level: int) -> DataFrame:
    """The keys that pass one level."""
    if step.shards == 1:
        words = F.from_json(F.lit(json.dumps(step.words.first()["words"])), "array<bigint>")
        return keys.filter(_passes(F.col("key"), level, step.bits[0], words))
    met = keys.withColumn("shard", step.shard(F.col("key"))).join(step.words, "shard")
    return met.filter(_passes(F.col("key"), level, step.bits[0], F.col("words"))).select("key")


def judge_urls(pages: DataFrame, url_col: str = "url", rules: Sequence[tuple[str, str, str]] = RULES,
               listed: DataFrame | None = None, most_bytes: int = MOST_BYTES) -> DataFrame:
    """`pages` with host, path, rule, verdict (`allow` or `block`) and listed.

    Where no rule fits, a host on the list is blocked and any other allowed. `listed` holds hosts in a column
    `key`; without it, the list is of the hosts on which a block rule fits one page in BLOCKED_IN or more. A null url, or
    one without `://`, has an empty host and path, which no rule fits. Columns of the result that `pages` has
    already are replaced. An empty table gives no rows.
    """
    taken = {"host", "path", "rule", "verdict", "listed"}
    plain = pages.select(*[c for c in pages.columns if c.lower() not in taken])
    parted = plain.withColumn("host", host_of(F.col(url_col))).withColumn("path", path_of(F.col(url_col)))
    fit = free_name([*plain.columns, *taken], "_rule")
    ruled = parted.withColumn(fit, longest_rule(F.col("host"), F.col("path"), rules))
    hosts = ruled.groupBy("host").agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(F.col(f"{fit}.verdict") == "block", 1)).alias("blocked")
    )
    if listed is None:
        keys = hosts.select(F.col("host").alias("key"), (BLOCKED_IN * F.col("blocked") >= F.col("n")).alias("listed"))
    else:
        keys = hosts.select(F.col("host").alias("key"), F.lit(False).alias("listed")).unionByName(
            listed.select("key", F.lit(True).alias("listed"))
        )
    marked = build_cascade(keys, most_bytes).mark(ruled, F.col("host"), "listed")
    return marked.select(
        *plain.columns,
        "host",
        "path",
        F.col(f"{fit}.rule").alias("rule"),
        F.coalesce(F.col(f"{fit}.verdict"), F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict"),
        "listed",
    )


def op4_url_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge_urls(pages).select("page_id", "host", "path", "rule", "verdict", "listed")


ORACLE = """
WITH parted AS (
  SELECT page_id,
         CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS tail FROM pages),
split AS (
  SELECT page_id,
         translate(regexp_extract(tail, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(tail, '^[^/?#]*([^?#]*)', 1) AS path FROM parted),
rules(verdict, site, start) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'),
  ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
fits AS (
  SELECT page_id, arg_max(site || start, length(site || start)) AS rule, arg_max(verdict, length(site || start)) AS ruled
  FROM split JOIN rules ON (host = site OR ends_with(host, '.' || site)) AND starts_with(path, start) GROUP BY page_id),
ruled AS (SELECT split.*, rule, ruled FROM split LEFT JOIN fits USING (page_id)),
hosts AS (SELECT host, 4 * count(*) FILTER (ruled = 'block') >= count(*) AS listed FROM ruled GROUP BY host)
SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN listed THEN 'block' ELSE 'allow' END) AS verdict, listed
FROM ruled JOIN hosts USING (host)
"""
