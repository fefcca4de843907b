"""Each operator against brute force, and on null, empty, long, tied, repeated and clashing rows."""

from __future__ import annotations

import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tollspan.llm import hmm, langid, licenses, lz, near_copies, neighbours, packing, pieces, simhash, toxicity, urls
from tollspan.llm.common import words_of
from tollspan.session import dealt, durable

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id bigint, text string, lang string, n_words string, _low string, score string, fp string, component string"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    long = prose(1, 20_000)
    near = prose(2, 200).split()
    base = [
        (1, None), (2, ""), (3, "   \n\t"), (4, "Um Wort É"), (5, "Um Wort É"), (6, prose(2, 200)), (7, prose(2, 200)),
        (8, " ".join([*near[:100], "OTHER", *near[101:]])), (9, prose(3, 40)), (9, prose(3, 40)), (None, prose(4, 30)), (11, long),
        (12, "!!! ... 123"), (13, "a\u2581b \u2581  c\x00d"), (14, "日本語 😀 text"),
    ]
    return base


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame([(i, t, "en", "x", "y", "z", "f", "c") for i, t in texts], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


# ---- 1 ----------------------------------------------------------------------------------


def phrase_set(text):
    seen, start = set(), 0
    last = ""
    for end in range(1, len(text) + 1):
        last = text[start:end]
        if last not in seen:
            seen.add(last)
            start, last = end, ""
    return seen


def test_lz_fingerprints(docs, nothing, texts):
    found = lz.fingerprints(docs).collect()
    rows = sorted([(i, t or "") for i, t in texts], key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    assert len(found) == len(rows)
    prints = {t: lz.signature(lz.smallest(s := sorted(phrase_set(t)), len(s))) for _, t in rows}
    want = Counter()
    for k, (i, t) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        edited = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        p, q = prints[t], lz.signature(lz.smallest(s := sorted(phrase_set(edited)), len(s)))
        want[i, len(t), edited, p, q, lz.likeness(p, q), lz.likeness(p, prints[after])] += 1
    assert Counter(tuple(r) for r in found) == want
    assert lz.fingerprints(nothing).collect() == []


def test_lz_likeness_follows_the_phrases():
    a, b = prose(5, 800), prose(5, 400) + " " + prose(6, 400)
    x, y = phrase_set(a), phrase_set(b)
    true = len(x & y) / len(x | y)
    got = lz.likeness(lz.Parsed(a).fingerprint, lz.Parsed(b).fingerprint)
    assert abs(got - true) < 0.15
    assert lz.likeness(lz.Parsed(a).fingerprint, lz.Parsed(a).fingerprint) == 1.0


def test_lz_long_unrelated_texts_are_unlike():
    rng = np.random.default_rng(8)
    low = []
    for a in (97, 1072):
        seen: set[str] = set()
        lz.parse("".join(map(chr, rng.integers(a, a + 20, 1_000_000).tolist())), seen)
        low.append(lz.smallest(seen, len(seen)))
    assert lz.likeness(*map(lz.signature, low)) < 0.05
    assert lz.likeness(lz.Parsed("").fingerprint, lz.Parsed("").fingerprint) == 1.0


# ---- 2 ----------------------------------------------------------------------------------


def test_neighbours_equal_brute_force(spark):
    rng = np.random.default_rng(0)
    rows = [(i, (rng.normal(size=24) + (i % 4) * 2).tolist()) for i in range(400)]
    rows += [(400, None), (401, [0.0] * 24), (402, [math.nan] + [1.0] * 23), (403, [None] + [1.0] * 23), (None, [1.0] * 24),
             (404, rows[7][1]), (404, rows[7][1]), (405, [1.0, 2.0]), (450, [2.0, 4.0]), (406, [])]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id bigint, embedding array<double>, score string, rank int")
    got = {}
    for r in neighbours.nearest(df, df.filter("vec_id % 50 = 0"), top=5).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    ok = {i: np.array(v) for i, v in rows[:400]} | {404: np.array(rows[7][1]), 405: np.array([1.0, 2]), 450: np.array([2.0, 4])}
    hits = total = 0
    for q in [i for i in ok if i % 50 == 0]:
        scored = sorted((-float(ok[q] @ v / np.linalg.norm(ok[q]) / np.linalg.norm(v)), i) for i, v in ok.items() if i != q and len(v) == len(ok[q]))
        want = [i for _, i in scored[:5]]
        mine = [i for _, i, _ in sorted(got[q])]
        assert [r for r, _, _ in sorted(got[q])] == list(range(1, len(mine) + 1))
        assert len(mine) == len(want)
        hits, total = hits + len(set(mine) & set(want)), total + len(want)
        for _, i, s in got[q]:
            assert s == pytest.approx(float(ok[q] @ ok[i] / np.linalg.norm(ok[q]) / np.linalg.norm(ok[i])), abs=1e-12)
    assert hits / total >= 0.95
    assert neighbours.nearest(df.limit(0), df.limit(0)).collect() == []


def test_estimates_stay_within_their_bounds():
    rng = np.random.default_rng(3)
    units = neighbours._units(rng.normal(size=(2000, 64)))
    codes = neighbours.encode(units, units.mean(0))
    estimate, error = neighbours.bounds(units[0], units.mean(0), *codes)
    assert (np.abs(estimate - units @ units[0])[1:] <= error[1:]).mean() > 0.97


# ---- 3 ----------------------------------------------------------------------------------


def test_language_of_held_out_texts(spark, docs, nothing):
    rng = random.Random(5)
    lexicon = {c: [f"{p}{rng.choice('aeiou')}{q}" for p in ps for q in qs] for c, ps, qs in (
        ("en", ("th", "wh", "sh"), ("ck", "ng", "ly")), ("de", ("sch", "pf", "zw"), ("cht", "ng", "tz")),
        ("es", ("ll", "ñ", "qu"), ("do", "ción", "ra")), ("fr", ("ch", "é", "qu"), ("eux", "ois", "ment")))}
    rows = [(i, " ".join(rng.choice(lexicon[c]) for _ in range(30)), c) for i in range(200) for c in [("en", "de", "es", "fr")[i % 4]]]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = langid.fit(df.filter("doc_id % 5 > 0"))
    held = df.filter("doc_id % 5 = 0").select("lang", langid.language(model, F.col("text")).alias("p")).collect()
    assert sum(r["lang"] == r["p"]["lang"] for r in held) >= 0.95 * len(held)
    odd = {r["doc_id"]: r["p"] for r in docs.select("doc_id", langid.language(model, F.col("text")).alias("p")).collect()}
    for i in (1, 2, 3, 12):
        assert tuple(odd[i]) == ("und", 0.0)
    assert odd[11]["lang"] in model.langs and 0 <= odd[11]["score"] <= 1
    empty = langid.fit(nothing)
    assert {r["p"]["lang"] for r in docs.select(langid.language(empty, F.col("text")).alias("p")).collect()} == {"und"}
    one = langid.fit(df.filter("lang = 'en'"))
    assert one.predict("what")[0] == "en"


# ---- 4 ----------------------------------------------------------------------------------

URLS = ["http://Www.Example.COM/en/1", "https://a.example.com/en/x?y#z", "http://com", "http://com/", "x.net/es/", None, "",
        "ftp://b.net/es/1#q", "http://b.net/fr?x=/es/", "http://c.net?/es/", "http://d.org/é", "http://b.net/en/", "http://notnet/es/",
        "http://b.net/es/2", "a://b://c/d"] * 3


def test_urls_equal_plain_rules_and_membership(spark):
    df = spark.createDataFrame([(i, u, "h", "v") for i, u in enumerate(URLS)], "page_id bigint, url string, host string, _shard string")

    def parts(u):
        if u is None or "://" not in u:
            return "", ""
        rest = u.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        return host.translate(LOWER), re.match(r"[^?#]*", rest[len(host) :])[0]

    def rule(host, path):
        fit = [(len(a + p), a + p, v) for v, a, p in urls.RULES if (host == a or host.endswith("." + a)) and path.startswith(p)]
        return max(fit)[1:] if fit else (None, None)

    seen = Counter(parts(u)[0] for u in URLS)
    blocked = Counter(parts(u)[0] for u in URLS if rule(*parts(u))[1] == "block")
    listed = {h for h in seen if urls.BLOCKED_IN * blocked[h] >= seen[h]}
    want = []
    for i, u in enumerate(URLS):
        host, path = parts(u)
        r, v = rule(host, path)
        want.append((i, host, path, r, v or ("block" if host in listed else "allow")))
    for most in (urls.MOST_BYTES, 8):
        got = urls.judge_urls(df, most_bytes=most).select("page_id", "host", "path", "rule", "verdict").collect()
        assert sorted(tuple(r) for r in got) == want
    assert urls.judge_urls(df.limit(0)).collect() == []


def test_cascade_is_exact_over_its_universe(spark):
    keys = spark.range(3000).select(F.concat(F.lit("k"), "id").alias("key"), (F.col("id") % 7 == 0).alias("listed"))
    for most in (1 << 20, 64):
        cascade = urls.build_cascade(keys, most)
        marked = cascade.mark(keys.unionByName(spark.createDataFrame([(None, False)], "key string, listed boolean")), F.col("key"), "got")
        assert marked.filter("got != listed").count() == 0
        assert len(cascade.bits) > 1
    nobody = urls.build_cascade(keys.withColumn("listed", F.lit(False)))
    assert nobody.mark(keys, F.col("key"), "got").filter("got").count() == 0


# ---- 5 ----------------------------------------------------------------------------------

LICENSED = [
    "Released under the MIT License. UNDER THE MIT-LICENSE under the mit license", "Apache License, Version 2.0; cc by nc sa 4.0",
    "SPDX-License-Identifier: GPL-3.0-or-later", "licensed under CC BY-NC 4.0.", "mit dem Wort", None, "", "über the mit license",
    "see opensource.org/licenses/MIT", "under the terms of the GNU Lesser General Public License v2.1 license",
]


def brute_finds(text):
    norm = " " + " ".join(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))) + " "
    found = []
    for r in licenses.rules():
        for m in re.finditer(r["regex"], norm):
            first = norm[: m.start()].count(" ") - 1
            found.append((first, first + m[0].count(" "), r["label"], r["priority"], r["base"]))
    kept = []
    for f in found:
        inside = any(g is not f and g[0] <= f[0] and g[1] >= f[1] and (g[3] > f[3] or g[3] == f[3] and ((g[0], g[1]) != (f[0], f[1])))
                     for g in found)
        if f[4] or not inside:
            kept.append(f)
    return kept


def test_licenses_equal_brute_force(spark, docs):
    more = [prose(7, 300) + " " + a + " " + prose(8, 20) + " " + b for a, b in itertools.product(LICENSED, LICENSED) if a and b]
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(LICENSED + more)], "doc_id bigint, text string, n_words string, _hit string")
    for r in licenses.scan_licenses(df).collect():
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (r["text"] or "").translate(LOWER))
        assert r["n_words"] == len(w)
        want = brute_finds(r["text"])
        # equal spans of equal priority: which label stays is the order's affair
        assert {(f[0], f[1]) for f in want} == {(f["first"], f["last"]) for f in r["licenses"]}
        assert sorted(f[:3] for f in want if f[4]) == sorted((f["first"], f["last"], f["label"]) for f in r["licenses"] if f["base"])
    assert 200 < len(licenses.rules()) and licenses.scan_licenses(docs).count() == docs.count()
    assert licenses.scan_licenses(df.limit(0)).collect() == []


def test_every_rule_has_its_traces():
    for r in licenses.rules()[len(licenses.BASE) :]:
        assert r["keywords"] and r["form"]
        re.compile(r["regex"])


# ---- 6 ----------------------------------------------------------------------------------


def test_simhash_components_equal_brute_force(spark, docs, nothing, texts):
    rng = random.Random(1)
    rows = list(texts)
    for i in range(60):
        t = prose(100 + i % 12, 60).split()
        if i >= 12 and i % 3:
            t[rng.randrange(60)] = "new"
        rows.append((100 + i, " ".join(t)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = simhash.near_duplicate_classes(df, shingle=3, radius=2).collect()
    prints = [r["fp"] & (2**64 - 1) for r in got]
    group = list(range(len(got)))
    for _ in range(len(got)):
        for i, j in itertools.combinations(range(len(got)), 2):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                group[i] = group[j] = min(group[i], group[j])
    for i, r in enumerate(got):
        ids = [got[j]["doc_id"] for j in range(len(got)) if group[j] == group[i] and got[j]["doc_id"] is not None]
        assert r["component_id"] == (min(ids) if ids else None)
    assert len(got) == len(rows)
    assert simhash.near_duplicate_classes(nothing).collect() == []


def test_fingerprint_is_the_majority_of_xxh64(spark):
    text = "The QUICK brown fox the quick brown É fox"
    w = words(text)
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)]
    h = [r[0] & (2**64 - 1) for r in spark.createDataFrame([(s,) for s in shingles], "s string").select(F.xxhash64("s")).collect()]
    want = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    assert simhash.simhash(simhash.shingle_hashes(text, 3)) & (2**64 - 1) == want
    assert simhash.simhash(simhash.shingle_hashes(None, 3)) == 0


def test_grid_meets_all_pairs_within_two_bits(spark):
    rng = random.Random(4)
    base = [rng.getrandbits(64) for _ in range(20)]
    values = {b ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for b in base for _ in range(4)} | set(base)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    df = spark.createDataFrame([(v,) for v in signed], "fp bigint")
    for radius in (0, 1, 2):
        links = {(r["a"], r["b"]) for r in simhash.near_links(df, radius).collect()}
        part = {v: v for v in signed}
        for _ in range(len(signed)):
            for a, b in links:
                part[a] = part[b] = min(part[a], part[b])
        for a, b in itertools.combinations(signed, 2):
            if ((a ^ b) & (2**64 - 1)).bit_count() <= radius:
                assert part[a] == part[b]
        assert all(((a ^ b) & (2**64 - 1)).bit_count() <= max(radius, 1) for a, b in links if radius < 2)


def test_near_copies_keep_one_of_each_group(spark, docs, nothing):
    kept = near_copies.drop_near_copies(docs)
    assert kept.columns == docs.columns
    ids = sorted(((r["doc_id"] is None), r["doc_id"] or 0) for r in kept.select("doc_id").collect())
    assert ids == sorted([(False, i) for i in (1, 4, 6, 9, 11, 12, 13, 14)] + [(True, 0)])
    assert near_copies.drop_near_copies(nothing).collect() == []


def test_near_copies_reach_the_similarity(spark):
    rng = random.Random(2)
    rows, sets = [], []
    for g in range(40):
        base = prose(500 + g, 60 + 20 * g).split()
        for k in range(3):
            t = list(base)
            for _ in range(k * len(t) // 60):
                t[rng.randrange(len(t))] = f"z{rng.random()}"
            rows.append((len(rows), " ".join(t)))
            sets.append({tuple(t[i : i + 5]) for i in range(len(t) - 4)})
    kept = {r["doc_id"] for r in near_copies.drop_near_copies(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    links = [(i, j) for i, j in itertools.combinations(range(len(rows)), 2)
             if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    first = list(range(len(rows)))
    for _ in range(4):
        for i, j in links:
            first[i] = first[j] = min(first[i], first[j])
    assert kept == set(first)


def kept_by_brute_force(texts, similarity=0.8):
    """First number of every group of texts whose five-word shingle sets reach the similarity."""
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in map(str.split, texts)]
    first = list(range(len(sets)))

    def root(i):
        while first[i] != i:
            i = first[i]
        return i

    for i, j in itertools.combinations(range(len(sets)), 2):
        if root(i) != root(j) and len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j]):
            first[max(root(i), root(j))] = min(root(i), root(j))
    return {root(i) for i in first}


def test_near_copies_of_short_texts(spark):
    rows = []
    for k in range(5, 16):
        for g in range(8):
            base = prose(9000 + 100 * k + g, k)
            rows += [base, base + " end", "start " + base]
    kept = near_copies.drop_near_copies(spark.createDataFrame(list(enumerate(rows)), "doc_id bigint, text string"))
    assert {r["doc_id"] for r in kept.collect()} == kept_by_brute_force(rows)


def test_near_copy_keys_miss_few_pairs_of_any_length():
    rng = np.random.default_rng(4)
    missed = pairs = 0
    for n in (1, 5, 9, 12, 18, 24, 30, 37, 60, 153, 306, 612):
        for turn in range(300):
            similarity = (0.8, 0.82, 0.85)[turn % 3]
            m = int(rng.integers(n, int(n / similarity) + 1)) if turn % 2 else n
            both = math.ceil((n + m) * similarity / (1 + similarity) - 1e-9)
            if both > n:
                continue
            pool = rng.integers(0, 1 << 63, n + m - both, dtype=np.uint64) * np.uint64(2)
            a, b = np.unique(pool[:n]), np.unique(np.r_[pool[:both], pool[n:]])
            missed += not set(near_copies.part_keys(a, 0.8)) & set(near_copies.part_keys(b, 0.8))
            pairs += 1
    assert missed <= pairs / 500


def test_near_copies_of_one_family(spark, monkeypatch):
    monkeypatch.setattr(near_copies, "BLOCK", 16, raising=False)
    rng = random.Random(6)
    rows = []
    for base in (prose(40, 620).split(), prose(41, 620).split()):
        for _ in range(100):
            t = list(base)
            for _ in range(8):
                t[rng.randrange(len(t))] = f"z{rng.random()}"
            rows.append(" ".join(t))
    kept = near_copies.drop_near_copies(spark.createDataFrame(list(enumerate(rows)), "doc_id bigint, text string"))
    assert {r["doc_id"] for r in kept.collect()} == kept_by_brute_force(rows)


# ---- 7 ----------------------------------------------------------------------------------


def test_pieces_best_cut_and_round_trip(spark, docs, texts):
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    model = pieces.Pieces(path)
    vocabulary = {w: v for w, v in model.words.items()}
    for _, t in texts[:10]:
        s = ("▁" + (t or "").replace(" ", "▁"))[:250] if t else ""
        best = [0.0] + [-1e18] * len(s)
        for e in range(1, len(s) + 1):
            best[e] = best[e - 1] + model.lowest
            for b in range(max(0, e - 20), e):
                if s[b:e] in vocabulary:
                    best[e] = max(best[e], best[b] + vocabulary[s[b:e]][1])
        assert model.encode((t or "")[:249] if t else "")[1] == pytest.approx(best[-1])
    back = docs.withColumn("e", pieces.encode(F.col("text"), path)).withColumn("b", pieces.decode(F.col("e.ids"), path))
    assert all((r["text"] or "") == r["b"] for r in back.collect())


def test_pieces_follow_output_links():
    byte_ids = list(range(100, 356))
    model = pieces.Pieces(pieces=[("▁", -5.0, 1), ("a", -1.0, 2), ("ab", -1.5, 3), ("b", -1.0, 4), ("bab", -2.0, 5)], byte_ids=byte_ids)
    ids, score = model.encode("abab")
    assert np.frombuffer(ids, "<u4").tolist() == [1, 2, 5] and score == -8.0
    assert model.decode(model.encode("aé ▁b")[0]) == "aé ▁b"


# ---- 8 ----------------------------------------------------------------------------------


def test_packing_is_whole_and_tight(docs, nothing, texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    want = Counter()
    for i, t in texts:
        want[i, tuple([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2])] += 1
    found = packing.pack_documents(docs, tokenizer_path=path, capacity=256).collect()
    by_doc, by_window = {}, {}
    for r in found:
        assert r["length"] == len(r["ids"]) // 4 > 0
        by_window.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        by_doc.setdefault((r["doc_id"], r["doc_tokens"]), []).append((r["start"], tuple(np.frombuffer(r["ids"], "<u4").tolist())))
    for parts in by_window.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 256
    for (i, n), parts in by_doc.items():
        joined = Counter()
        for start, ids in parts:
            joined.update({start + k: 1 for k in range(len(ids))})
        copies = sum(c for (j, ids), c in want.items() if j == i and len(ids) == n)
        assert joined == Counter({k: copies for k in range(n)})
    assert sum(len(ids) * c for (_, ids), c in want.items()) == sum(r["length"] for r in found)
    assert packing.pack_documents(nothing, tokenizer_path=path).collect() == []


def test_differencing_balances_windows():
    rng = np.random.default_rng(0)
    sizes = rng.integers(1, 512, 900)
    window, sums = packing.difference(sizes, 60)
    assert np.bincount(window, weights=sizes, minlength=60).astype(int).tolist() == sums.tolist()
    assert sums.max() - sums.min() <= 8
    for lengths in ([1], [4096], [4097], [5000] * 3, rng.integers(1, 9000, 300).tolist()):
        filled = Counter()
        for _, _, n, w in packing.plan(lengths):
            filled[w] += n
        padding = sum(4096 - n for n in filled.values() if n & (n - 1))
        assert max(filled.values()) <= 4096 and padding <= 0.02 * sum(lengths)


def test_chunked_ids_equal_the_tokenizer():
    import public_tokenizers

    known = packing._Chunks(public_tokenizers.path("word_bpe_49k.json"))
    for t in ("it's a test.", "İi ı <|endoftext|> x\u0301 \u0301y", "a\tb\r\nc\x1cd", "Σας ΣΑΣ ǅ ß", "c,. .. ,", "", "don't 5.5", "\xa0x"):
        assert np.frombuffer(known.ids([t])[0], "<u4").tolist() == known.tokenizer.encode(t, add_special_tokens=False).ids


# ---- 9 ----------------------------------------------------------------------------------


def test_toxicity_of_held_out_texts(spark, docs, nothing):
    rng = random.Random(3)
    rows, labels = [], []
    for i in range(600):
        t = prose(2000 + i, 120).split()
        bad = i % 4 == 0
        for _ in range(4 if bad else 0):
            t[rng.randrange(len(t))] = rng.choice(["zorkface", "blaggard", "smudgewit"])
        rows.append((i, " ".join(t)))
        labels.append((i, int(bad)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    marks = spark.createDataFrame([*labels, (3, 0), (None, 1), (5, None)], "doc_id bigint, toxic int")
    model = toxicity.fit(df, marks.filter("doc_id % 5 != 0"))
    held = df.filter("doc_id % 5 = 0").withColumn("s", toxicity.toxicity(model, F.col("text"))).collect()
    right = sum((r["s"] >= 0.5) == (r["doc_id"] % 4 == 0) for r in held)
    assert right >= 0.95 * len(held)
    odd = docs.withColumn("s", toxicity.toxicity(model, F.col("text"))).collect()
    assert all(0 <= r["s"] <= 1 for r in odd)
    assert {r["s"] < 0.5 for r in odd if not words(r["text"])} == {True}
    assert toxicity.fit(df, marks.limit(0)) == 0.0 and toxicity.fit(nothing, marks.filter("toxic = 0")) == 0.0


# ---- 10 ---------------------------------------------------------------------------------


def test_hmm_scores_equal_brute_force(spark, docs, nothing, texts):
    learn = docs.filter("doc_id IS NULL OR doc_id != 9")
    vocab = hmm.vocabulary(learn, frequent=50)
    counts = Counter()
    for i, t in texts:
        if i != 9:
            counts.update(words(t))
            counts[""] += 1
    assert vocab.tokens == sum(counts.values()) and vocab.distinct == len(counts)
    encoded = hmm.encode(docs, vocab)
    p = hmm.train(encoded.filter("doc_id IS NULL OR doc_id != 9"), vocab, states=3, rounds=2)
    index = vocab.index
    rare_n = sum(c for w, c in counts.items() if w.encode() not in index)
    rare_v = len(counts) - len(index)
    want = Counter()
    for i, t in texts:
        tokens = [*words(t), ""]
        base = sum(math.log10((counts[w] + 1) / (vocab.tokens + vocab.distinct + 1)) for w in tokens)
        alpha, total = None, 0.0
        for w in tokens:
            e = p.emit[:, index.get(w.encode(), len(index))]
            if w.encode() not in index:
                total += math.log10((counts[w] + 1) / (rare_n + rare_v + 1))
            alpha = (p.start if alpha is None else alpha @ p.move) * e
            total += math.log10(alpha.sum())
            alpha = alpha / alpha.sum()
        want[i, len(tokens), sum(counts[w] > 0 for w in tokens), round(base, 5), round(total, 5)] += 1
    got = hmm.score(encoded, vocab, p).collect()
    assert Counter((r["doc_id"], r["n_tokens"], r["n_known"], round(r["base_score"], 5), round(r["score"], 5)) for r in got) == want
    none = hmm.vocabulary(nothing)
    alone = hmm.encode(docs, none)
    assert hmm.score(alone, none, hmm.train(alone.limit(0), none)).filter("score > 0 OR n_known > 0").count() == 0


def test_hmm_unseen_words_without_rare_ones(spark):
    learn = spark.createDataFrame([(1, "a b a c"), (2, "b a"), (3, None)], "doc_id bigint, text string")
    held = spark.createDataFrame([(4, "a z b"), (5, "y"), (6, "")], "doc_id bigint, text string")
    vocab = hmm.vocabulary(learn, frequent=50)
    p = hmm.train(hmm.encode(learn, vocab), vocab, states=3, rounds=2)
    assert (p.emit > 0).all() and np.allclose(p.emit.sum(1), 1)
    got = {r["doc_id"]: r["score"] for r in hmm.score(hmm.encode(held, vocab), vocab, p).collect()}
    for i, text in ((4, "a z b"), (5, "y"), (6, "")):
        alpha, want = p.start, 0.0
        for k, w in enumerate([*words(text), ""]):
            alpha = (alpha if k == 0 else alpha @ p.move) * p.emit[:, vocab.index.get(w.encode(), len(vocab.words))]
            want += math.log10(alpha.sum())
            alpha = alpha / alpha.sum()
        assert got[i] == pytest.approx(want)


def test_hmm_texts_of_unlike_length_share_the_last_blocks():
    rng = np.random.default_rng(2)
    made = [rng.integers(0, 9, n).astype(hmm.SYMBOL) for n in (9000, 3, 700, 2500, 1, 40)]
    blocks = list(hmm._blocks(iter([pd.DataFrame({"r": range(6), "s": [d.tobytes() for d in made]}), pd.DataFrame({"r": [], "s": []})])))
    assert [rows for rows, _ in blocks] == [[0, 3, 2, 5, 1, 4]]
    assert all((d == made[r]).all() for r, d in zip(*blocks[0], strict=True))
    assert list(hmm._blocks(iter([]))) == []
    p = hmm.Parameters.first(np.arange(1.0, 10), 3, 1)
    assert hmm.forward(blocks[0][1], p) == pytest.approx([hmm.forward([d], p)[0] for d in blocks[0][1]])


def test_hmm_words_as_columns_are_those_of_each_text(texts):
    odd = [t for _, t in texts] + ["\x1c a\x85b\xa0C", " ", None, "\n\t", "É é\x0bÀ x", "a\x00 a\x00"]
    sliced = pa.array(["left out", *odd], pa.string()).slice(1)
    for part in (sliced, sliced.slice(3, 2), sliced.slice(0, 0), pa.array([" ", None], pa.string())):
        [(found, sizes)] = [hmm._words(p) for p in hmm._parts(part)] or [(pa.array([]), np.array([]))]
        want = [words_of(t) for t in part.to_pylist()]
        assert found.to_pylist() == [w for some in want for w in some] and sizes.tolist() == list(map(len, want))


def test_baum_welch_counts_equal_brute_force():
    rng = np.random.default_rng(1)
    p = hmm.Parameters.first(np.array([5.0, 3, 2, 1]), 3, 1)
    sequences = [rng.integers(0, 4, n).astype(np.int32) for n in (1, 2, 7, 30, 3, 3, 5)]
    start, move, emit = np.zeros(3), np.zeros((3, 3)), np.zeros((3, 4))
    scores = hmm.forward(sequences, p, (start, move, emit))
    a, b, c = np.zeros(3), np.zeros((3, 3)), np.zeros((3, 4))
    for d, got in zip(sequences, scores, strict=True):
        n = len(d)
        alpha, beta = np.zeros((n, 3)), np.ones((n, 3))
        alpha[0] = p.start * p.emit[:, d[0]]
        for t in range(1, n):
            alpha[t] = alpha[t - 1] @ p.move * p.emit[:, d[t]]
        for t in range(n - 2, -1, -1):
            beta[t] = p.move @ (p.emit[:, d[t + 1]] * beta[t + 1])
        whole = alpha[-1].sum()
        assert got == pytest.approx(math.log10(whole))
        a += alpha[0] * beta[0] / whole
        for t in range(n):
            c[:, d[t]] += alpha[t] * beta[t] / whole
        for t in range(n - 1):
            b += np.outer(alpha[t], p.emit[:, d[t + 1]] * beta[t + 1]) * p.move / whole
    assert np.allclose(start, a) and np.allclose(move, b) and np.allclose(emit, c)


def test_folds_follow_crc32(spark):
    from tollspan.llm.common import remainder

    got = spark.createDataFrame([(i,) for i in (0, 12, -3, None)], "doc_id bigint").select("doc_id", remainder("doc_id", 7).alias("r")).collect()
    assert all(r["r"] == zlib.crc32(b"" if r["doc_id"] is None else str(r["doc_id"]).encode()) % 7 for r in got)


def test_near_copy_keys_are_dealt_once(spark, monkeypatch):
    plans = []

    class Seen(Exception):
        pass

    def kept(df):
        plan = df._jdf.queryExecution().executedPlan().toString()
        plans.append(plan)
        if "central" in df.columns and "key" in df.columns:
            raise Seen
        return durable(df)

    monkeypatch.setattr(near_copies, "durable", kept)
    rows = [(i, f"one two three four five six seven {i % 3}") for i in range(9)]
    with pytest.raises(Seen):
        near_copies.near_copy_classes(spark.createDataFrame(rows, "doc_id bigint, text string"))
    by_key = [line for line in plans[-1].splitlines() if "Exchange hashpartitioning(key#" in line]
    assert by_key and all("REPARTITION_BY_COL" in line for line in by_key)


def test_near_copies_shuffle_sets_and_texts_once(spark, monkeypatch):
    """Sets lie in buckets and only pairs go to them; texts move once, for the join and the choice of a row together."""
    plans = []

    def exchanges(df):
        return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")

    def kept(df):
        if "array_intersect" in df._jdf.queryExecution().executedPlan().toString():
            plans.append(exchanges(df))
        return durable(df)

    monkeypatch.setattr(near_copies, "durable", kept)
    text = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen"
    rows = [(2, text, "b"), (2, text, "a"), (None, text, "c"), (None, "alone", "y"), (None, "alone", "x"), (7, text + " more", "d"), (9, "x y z", None)]
    rows += [(20 + i, f"{text} {i % 2} w{i} v{i} u{i}", None) for i in range(6)]
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = near_copies.drop_near_copies(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"))
        assert plans and all(n == 2 for n in plans)
        assert exchanges(found) == 2
        got = {(r["doc_id"], r["text"], r["lang"]) for r in found.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert {r for r in got if r[0] is None or r[0] < 10} == {(2, text, "a"), (None, "alone", "x"), (9, "x y z", None)}


def test_near_copies_leave_no_shuffled_files(spark, monkeypatch):
    setting, seen = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", []
    before = spark.conf.get(setting, None)

    def kept(df):
        seen.append(spark.conf.get(setting, None))
        return durable(df)

    monkeypatch.setattr(near_copies, "durable", kept)
    df = spark.createDataFrame([(i, f"a b c d e f g h {i % 2}") for i in range(4)], "doc_id bigint, text string")
    assert {r["doc_id"] for r in near_copies.drop_near_copies(df).collect()} == {0, 1}
    assert seen and set(seen) == {"true"} and spark.conf.get(setting, None) == before


def test_dealt_rows_lie_in_one_file_a_bucket(spark):
    df = dealt(spark.range(5000).select((F.col("id") % 700).alias("k")).groupBy("k").count(), "k")
    assert len(df.inputFiles()) <= int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert df.count() == 700 and df.agg(F.sum("count")).first()[0] == 5000
    assert "Exchange" not in df.groupBy("k").agg(F.max("count"))._jdf.queryExecution().executedPlan().toString()
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("dealt_")]


def test_packing_lists_strings_as_they_are():
    for found in (["", "é", "a\x00", "😀 b"], []):
        column = pa.array(["left out", *found], pa.large_string()).slice(1)
        assert packing._strings(column) == column.to_pylist() == found
