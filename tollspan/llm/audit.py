"""Filter interaction audit: what each of five filters removes, by itself and in every order.

A document's failed filters are bits: A to D come from its own text, E ("a copy of a document with a smaller
id") from a left-semi self-join on hash, exact text and smaller id. The ids found there are united with the
other failures, and documents are counted by combination of bits; at most 32 rows a part remain, from which
all orders of the filters are worked out. Texts are shuffled once, to find those whose hash occurs twice.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tollspan.llm.common import table
from tollspan.session import durable

FILTERS = "ABCDE"
COPY = 16  # the bit of filter E
#: A hash with more rows than this, or than one in HOT_SHARE of all, is dealt to several tasks. At most
#: HOT_SHARE hashes can have so many rows, so the list of them is safe to broadcast.
HOT_ROWS, HOT_SHARE = 256, 10_000


def own_failures(words: Column, text: Column) -> Column:
    """Bits of the filters A to D, which look at one text alone."""
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    failed = [n < 100, 100 * distinct < 80 * n, 100 * capitals > 10 * F.length(text), text.rlike("[#$%&*|]")]
    bits = [F.when(f, F.lit(1 << i)).otherwise(F.lit(0)) for i, f in enumerate(failed)]
    return bits[0] + bits[1] + bits[2] + bits[3]


def _dealt(rows: DataFrame, hot: DataFrame) -> DataFrame:
    """Add `salt`: rows of a hot hash are spread by their id, all others have 0."""
    salt = F.pmod(F.xxhash64("id", F.lit(11)), F.coalesce("cuts", F.lit(1)))
    return rows.join(F.broadcast(hot), "h", "left").withColumn("salt", salt).drop("cuts")


def _repeated(rows: DataFrame, hot: DataFrame) -> DataFrame:
    """One row for each salt that `_dealt` may give to the row's hash."""
    every = F.explode(F.sequence(F.lit(0).cast("bigint"), F.coalesce("cuts", F.lit(1)) - 1))
    return rows.join(F.broadcast(hot), "h", "left").withColumn("salt", every).drop("cuts")


def later_copies(rows: DataFrame, hashes: DataFrame, total: int) -> DataFrame:
    """`(id, part, h)` of rows `(id, part, h, text)` whose very text stands under a smaller id as well.

    `hashes` holds the column h of all rows. Null ids are neither smaller nor larger than any other.
    """
    shared = durable(hashes.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))
    most = max(HOT_ROWS, -(-total // HOT_SHARE))
    hot = shared.filter(F.col("n") > most).select("h", F.ceil(F.col("n") / most).alias("cuts"))
    twice = _repeated(shared.select("h"), hot)
    known = rows.filter("id IS NOT NULL")
    # texts move at every size alike; the few hashes of a partition are held, its texts stream past them unsorted
    found = durable(_dealt(known, hot).join(twice.hint("shuffle_hash"), ["h", "salt"], "left_semi"))
    first = found.groupBy("h", "text").agg(F.min("id").alias("first"))
    smaller = _repeated(first, hot).toDF("h2", "text2", "first", "salt2")
    same = (F.col("h") == F.col("h2")) & (F.col("salt") == F.col("salt2")) & (F.col("text") == F.col("text2"))
    return found.join(smaller, same & (F.col("first") < F.col("id")), "left_semi").select("id", "part", "h")


def combinations(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """`part, bits, n, good, toxic`: documents by part and failed filters, and how many have which label."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = docs.select(
        F.col(f"`{id_col}`").alias("id"),
        F.coalesce(F.col(f"`{part_col}`").cast("string"), F.lit("")).alias("part"),
        F.xxhash64(text).alias("h"),
        text.alias("text"),
    )
    words = F.array_remove(F.split("text", "[ \\t-\\r]+"), "")
    facts = durable(
        rows.select("*", words.alias("words")).select("id", "part", "h", own_failures(F.col("words"), F.col("text")).alias("bits"))
    )
    copies = later_copies(rows, facts.filter("id IS NOT NULL").select("h"), facts.count())
    failures = facts.withColumn("rows", F.lit(1)).unionByName(copies.select("*", F.lit(COPY).alias("bits"), F.lit(0).alias("rows")))
    one = failures.groupBy("id", "part", "h").agg(F.bit_or("bits").alias("bits"), F.sum("rows").alias("rows"))
    known = labels.groupBy(F.col(f"`{id_col}`").alias("id")).agg(
        F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"), F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic")
    )
    return (
        one.join(known.filter("id IS NOT NULL"), "id", "left")
        .groupBy("part", "bits")
        .agg(
            F.sum("rows").alias("n"),
            F.coalesce(F.sum(F.col("rows") * F.col("good")), F.lit(0)).alias("good"),
            F.coalesce(F.sum(F.col("rows") * F.col("toxic")), F.lit(0)).alias("toxic"),
        )
    )


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """One row per part, order of the five filters and step; counts are documents of the part.

    Null texts count as empty, null parts as the empty string. Every row of `docs` is a document; rows with one
    id, part and text share their failures. A document with several labels has what any of them says; null
    labels say nothing. A null id has no labels, and no copy of a null id fails E. Columns beyond those named
    are not read. A part without documents, and so an empty table, gives no rows.
    """
    orders = ",".join("".join(p) for p in permutations(FILTERS))
    letter = F.expr("substring(filter_order, step, 1)")
    bit = "shiftleft(1, ascii(substring(filter_order, {0}, 1)) - 65)"
    steps = (
        combinations(docs, labels, id_col, text_col, part_col)
        .withColumn("filter_order", F.explode(F.split(F.lit(orders), ",")))
        .withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(5))))
        .withColumn("letter", letter)
        .withColumn("mine", F.expr(bit.format("step")))
        .withColumn("seen", F.expr(f"aggregate(filter(sequence(1, 5), i -> i < step), 0, (m, i) -> m | {bit.format('i')})"))
    )
    bits, mine, seen = F.col("bits"), F.col("mine"), F.col("seen")
    fails, before = bits.bitwiseAND(mine) != 0, bits.bitwiseAND(seen) != 0

    def total(when: Column, what: str) -> Column:
        return F.sum(F.when(when, F.col(what)).otherwise(0)).cast("bigint")

    counted = steps.groupBy("part", "filter_order", "step", "letter").agg(
        total(~fails & ~before, "n").alias("kept"),
        total(fails & ~before, "n").alias("removed"),
        total(fails & before, "n").alias("redundant"),
        total(bits == mine, "n").alias("unique_fails"),
        total(fails & ~before, "good").alias("good_lost"),
        total(fails & ~before, "toxic").alias("toxic_lost"),
    )
    shapley = F.sum("removed").over(Window.partitionBy("part", "letter")).alias("shapley")
    return counted.select("part", "filter_order", "step", *counted.columns[4:], shapley)


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


ORACLE = """
WITH texts AS (
    SELECT doc_id, coalesce(text, '') AS t, coalesce(lang, '') AS part,
           regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w
    FROM documents
), failed AS (
    SELECT doc_id, part,
           CASE WHEN len(w) < 100 THEN 1 ELSE 0 END
           + CASE WHEN 100 * len(list_distinct(w)) < 80 * len(w) THEN 2 ELSE 0 END
           + CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > 10 * length(t) THEN 4 ELSE 0 END
           + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
           + CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 16 ELSE 0 END AS bits
    FROM texts
), known AS (
    SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
    FROM labels GROUP BY doc_id
), counted AS (
    SELECT part, bits, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic
    FROM failed LEFT JOIN known USING (doc_id) GROUP BY part, bits
), letter AS (
    SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x
), orders AS (
    SELECT a.x || b.x || c.x || d.x || e.x AS filter_order
    FROM letter a, letter b, letter c, letter d, letter e
    WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
), steps AS (
    SELECT filter_order, step, substring(filter_order, step, 1) AS letter,
           (1 << (ascii(substring(filter_order, step, 1)) - 65)) AS mine,
           coalesce(list_sum([1 << (ascii(substring(filter_order, i, 1)) - 65) FOR i IN range(1, step)]), 0)::INTEGER AS seen
    FROM orders, (SELECT unnest(range(1, 6)) AS step)
), summed AS (
    SELECT part, filter_order, step::INTEGER AS step, letter,
           sum(CASE WHEN (bits & (seen | mine)) = 0 THEN n ELSE 0 END)::BIGINT AS kept,
           sum(CASE WHEN (bits & mine) != 0 AND (bits & seen) = 0 THEN n ELSE 0 END)::BIGINT AS removed,
           sum(CASE WHEN (bits & mine) != 0 AND (bits & seen) != 0 THEN n ELSE 0 END)::BIGINT AS redundant,
           sum(CASE WHEN bits = mine THEN n ELSE 0 END)::BIGINT AS unique_fails,
           sum(CASE WHEN (bits & mine) != 0 AND (bits & seen) = 0 THEN good ELSE 0 END)::BIGINT AS good_lost,
           sum(CASE WHEN (bits & mine) != 0 AND (bits & seen) = 0 THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
    FROM counted, steps GROUP BY ALL
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       sum(removed) OVER (PARTITION BY part, letter)::BIGINT AS shapley
FROM summed
"""
