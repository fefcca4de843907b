"""Filter audit, ranked search and rule ensemble beside brute force, on small tables with the awkward rows."""

from __future__ import annotations

import math
import re
from collections import Counter
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tollspan.llm import audit, ranked, rules

SF = "/root/testdata/sf0.001"


# ---- 11 ---------------------------------------------------------------------------------


def _bits(text: str | None) -> int:
    text = text or ""
    words = re.findall("[^\x20\x09-\x0d]+", text)
    fails = (
        len(words) < 100,
        100 * len(set(words)) < 80 * len(words),
        100 * len(re.findall("[A-Z]", text)) > 10 * len(text),
        bool(re.search(r"[#$%&*|]", text)),
    )
    return sum(1 << i for i, f in enumerate(fails) if f)


def _audit_by_hand(rows, labels):
    known: dict = {}
    for doc_id, quality, toxic in labels:
        if doc_id is not None:
            old = known.get(doc_id, (False, False))
            known[doc_id] = (old[0] or quality == 1, old[1] or toxic == 1)
    docs = []
    for doc_id, text, lang in rows:
        copy = doc_id is not None and any(i is not None and i < doc_id and (t or "") == (text or "") for i, t, _ in rows)
        docs.append((lang or "", _bits(text) | (16 if copy else 0), *known.get(doc_id, (False, False))))
    out = {}
    for part in {d[0] for d in docs}:
        mine = [d[1:] for d in docs if d[0] == part]
        whole = Counter()
        lines = []
        for order in permutations("ABCDE"):
            left = mine
            for step, letter in enumerate(order, 1):
                bit = 1 << "ABCDE".index(letter)
                gone = [d for d in left if d[0] & bit]
                left = [d for d in left if not d[0] & bit]
                fails = [d for d in mine if d[0] & bit]
                whole[letter] += len(gone)
                lines.append((order, step, letter, len(left), len(gone), len(fails) - len(gone), sum(d[0] == bit for d in mine),
                              sum(d[1] for d in gone), sum(d[2] for d in gone)))
        for order, step, letter, *rest in lines:
            out[part, "".join(order), step] = (*rest, whole[letter])
    return out


@pytest.fixture(scope="module")
def audited():
    word = [f"w{i}" for i in range(300)]
    long = " ".join(word[:150])
    rows = [
        (1, long, "en"), (2, long, "en"), (3, long, None), (2, long, "en"), (4, None, "en"), (5, "", "de"), (6, "  \n ", "de"),
        (7, "A B C " * 40, "de"), (8, " ".join(word[:120]) + " 50%", "en"), (9, long + " |", None), (None, long, "en"), (None, None, None),
        (10, "É À ß\x0b x y " * 30, "fr"), (11, " ".join(word) * 50, "fr"), (12, " ".join(word) * 50, "fr"),
    ]
    rows += [(100 + i, "same text again", "en") for i in range(20)]
    labels = [(1, 1, 0), (1, 0, 1), (2, 1, None), (3, None, 1), (8, 1, 1), (None, 1, 1), (105, 1, 0), (999, 1, 1)]
    return rows, labels


@pytest.mark.parametrize("hot", [2, 256])
def test_audit_equals_brute_force(spark, audited, hot, monkeypatch):
    monkeypatch.setattr(audit, "HOT_ROWS", hot)
    rows, labels = audited
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").withColumns({"h": F.lit(1), "BITS": F.lit("x"), "salt": F.lit(2)})
    got = audit.audit(docs.repartition(3), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"))
    assert {(r["part"], r["filter_order"], r["step"]): tuple(r)[3:] for r in got.collect()} == _audit_by_hand(rows, labels)


def test_audit_of_nothing(spark, audited):
    docs = spark.createDataFrame([], "doc_id bigint, text string, lang string")
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert audit.audit(docs, labels).count() == 0
    rows, _ = audited
    got = audit.audit(spark.createDataFrame(rows, docs.schema), labels)
    assert {r[0] for r in got.select(F.col("good_lost") + F.col("toxic_lost")).collect()} == {0}


# ---- 12 ---------------------------------------------------------------------------------


def _terms(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", low)


def _ranked_by_hand(docs, items, k):
    parsed = [(i, Counter(_terms(t)), len(_terms(t))) for i, t in docs]
    n_docs, tokens = sum(n > 0 for _, _, n in parsed), sum(n for _, _, n in parsed)
    df = Counter(t for _, c, _ in parsed for t in c)
    out = set()
    for item, text in items:
        asked = Counter(_terms(text))
        found = []
        for doc, c, n in parsed:
            score = 0
            for t, times in asked.items():
                if c[t]:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    score += times * w * ((1_000_000_000 * c[t]) // (1000 * c[t] + 12 * (75 + (25 * n * n_docs) // tokens)))
            if score > 0:
                found.append((-score, (doc is not None, doc), doc))
        out |= {(item, r, d, -s) for r, (s, _, d) in enumerate(sorted(found)[:k], 1)}
    return out


@pytest.fixture(scope="module")
def shelf():
    rng = np.random.default_rng(8)
    words = [f"t{i}" for i in range(80)] + ["Été", "ÇA", "x1", "the"]
    share = 1 / np.arange(1, len(words) + 1)
    docs = [(i, " ".join(rng.choice(words, rng.integers(1, 60), p=share / share.sum()))) for i in range(300)]
    docs += [(1000 + i, docs[3][1]) for i in range(40)]  # ties
    docs += [(2000, None), (2001, ""), (2002, "?? !! --"), (2003, "solo"), (2004, "the " * 5000), (None, docs[5][1])]
    items = [(j, " ".join(rng.choice(words, rng.integers(1, 25)))) for j in range(30)]
    items += [(50, None), (51, ""), (52, "nowhere"), (53, "solo THE The-the_the"), (54, docs[3][1]), (55, "?!")]
    return docs, items


@pytest.mark.parametrize(("block", "queries", "k"), [(8192, 1024, 5), (32, 7, 5), (64, 1024, 40)])
def test_ranked_equals_brute_force(spark, shelf, block, queries, k, monkeypatch):
    monkeypatch.setattr(ranked, "BLOCK_DOCS", block)
    monkeypatch.setattr(ranked, "QUERY_BLOCK", queries)
    docs, items = shelf
    table = spark.createDataFrame(docs, "doc_id bigint, text string").withColumns({"n": F.lit(1), "TERMS": F.lit("t")}).repartition(3)
    got = ranked.ranked(table, spark.createDataFrame(items, "item_id int, text string"), k=k)
    assert {tuple(r) for r in got.collect()} == _ranked_by_hand(docs, items, k)


def test_ranked_with_text_ids_and_nothing(spark, shelf):
    docs, items = shelf
    named = [(f"d{i:05d}" if i is not None else None, t) for i, t in docs]
    table = spark.createDataFrame(named, "doc_id string, text string")
    asked = spark.createDataFrame([(f"q{j}", t) for j, t in items[:4]], "item_id string, text string")
    assert {tuple(r) for r in ranked.ranked(table, asked, k=3).collect()} == _ranked_by_hand(named, [(f"q{j}", t) for j, t in items[:4]], 3)
    assert ranked.ranked(table.limit(0), asked).count() == 0 and ranked.ranked(table, asked.limit(0)).count() == 0


def test_pair_bounds_hold_and_pass_over_more(shelf):
    docs, items = shelf
    queries = ranked.Queries()
    for item, text in items:
        if _terms(text):
            queries.add(item, text)
    parsed = [[w for w in ranked.terms_of(t)] for _, t in docs]
    holders = Counter(queries.words[w] for ws in parsed for w in set(ws) if w in queries.words)
    queries.weigh(sum(map(bool, parsed)), sum(map(len, parsed)), holders)
    pdf = {"doc_id": list(range(len(docs))), "n": [len(ws) for ws in parsed], "terms": [], "counts": []}
    for ws in parsed:
        terms, counts = np.unique([queries.words[w] for w in ws if w in queries.words], return_counts=True)
        pdf["terms"].append(terms.astype(np.int32))
        pdf["counts"].append(counts.astype(np.int32))
    block, _ = ranked._block_of(ranked.pd.DataFrame(pdf), queries)
    pairs, joint = ranked.pair_maxima(block, queries)
    assert len(pairs) > 10
    tighter = 0
    for p, most in zip(pairs.tolist(), joint.tolist(), strict=True):
        one, two = queries.pairs[p]
        dense = np.zeros((2, block.n), np.int64)
        for row, term in zip(dense, (one, two), strict=True):
            d, i = block.postings(int(term))
            row[d] = i
        both = (dense > 0).all(axis=0)
        assert most == dense[:, both].sum(axis=0).max()
        tighter += most < block.best(int(one)) + block.best(int(two))
    assert tighter > len(pairs) // 2
    # whatever the score to beat, nothing that reaches it is lost
    for q in range(len(queries.items)):
        full = ranked.search_block(block, dict(zip(pairs.tolist(), joint.tolist(), strict=True)), queries, q, 1, 10_000)
        for least in np.unique(full[1])[::3]:
            part = ranked.search_block(block, dict(zip(pairs.tolist(), joint.tolist(), strict=True)), queries, q, int(least), 10_000)
            keep = full[1] >= least
            assert (part[0] == full[0][keep]).all() and (part[1] == full[1][keep]).all()


# ---- 13 ---------------------------------------------------------------------------------


def test_rules_follow_tree_paths_and_lasso_is_optimal():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 4))
    y = ((x[:, 0] > 0.3) & (x[:, 2] <= 0.5)).astype(float)
    weight = np.ones(600)
    made = rules.tree_rules(x, y, weight, trees=6)
    assert made and all(1 <= len(r) <= 3 for r in made)
    z = np.array([rules.holds(r, x) for r in made], float).T
    beta = rules.lasso(z, y, weight, 0.01, rounds=20_000)
    slope = z.T @ (y - 1 / (1 + np.exp(-(z @ beta[:-1] + beta[-1])))) / 600
    on = np.abs(beta[:-1]) > 1e-6
    assert np.allclose(slope[on], 0.01 * np.sign(beta[:-1][on]), atol=1e-4) and (np.abs(slope[~on]) <= 0.01 + 1e-4).all()
    model = rules.fit_rules(x, y, y.mean())
    assert ((model.scores(x) >= 0.5) == y).mean() > 0.97 and len(model.rules) < 60


def test_rule_columns_equal_numpy_and_held_out_quality(spark):
    from tollspan.llm.common import remainder, table

    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    model = rules.fit(docs, labels.filter(remainder("doc_id", 5) != 0))
    featured, of = rules._with_features(docs, "text")
    rows = featured.select("doc_id", model.column(of).alias("score"), *[c.alias(n) for n, c in of.items()]).toPandas()
    assert np.allclose(rows["score"], model.scores(rows[list(rules.FEATURES)].to_numpy(float)))
    big = "/root/testdata/sf0.1"
    got = rules.op13_rule_quality(spark, big).filter("held_out").join(table(spark, big, "labels"), "doc_id").select("predicted", "quality").toPandas()
    assert len(got) > 500 and (got["predicted"] == got["quality"]).mean() > 0.98


def test_statistics_equal_brute_force(spark):
    texts = [None, "", "  \n\n ", "Hello World!\nHello World!\n#1 50% é", "ABC 123 abc. abc; [x] <y>", "a" * 5000, "  x\x0by z w"]
    table = spark.createDataFrame(list(enumerate(texts)), "i int, text string").withColumns({"_count_words": F.lit(5), "_FEATURE_stops": F.lit("s")})
    featured, of = rules._with_features(table, "text")
    for r in featured.select("text", *[c.alias(n) for n, c in of.items()]).collect():
        t = r["text"] or ""
        words, lines = re.findall("[^\x20\x09-\x0d]+", t), [x for x in t.split("\n") if x]
        n = max(1, len(t))
        want = [math.log1p(len(words)), len(set(words)) / max(1, len(words)), len(t) / max(1, len(words)), len(words) / max(1, len(lines)),
                len(set(lines)) / max(1, len(lines))]
        want += [len(re.findall(p, t)) / n for p in ("[A-Z]", "[0-9]", r"[#$%&*|<>{}\[\]\\^~_=+@/]", "[!?]", "[.,;:]", "[^\x00-\x7f]")]
        assert np.allclose([r[f] for f in rules.FEATURES], want), t


def test_quality_without_a_class_and_odd_rows(spark):
    docs = spark.createDataFrame([(1, "a"), (1, "b"), (None, None), (3, "")], "doc_id bigint, text string").withColumn("score", F.lit("old"))
    one = spark.createDataFrame([(1, 1), (3, 1), (None, 0), (7, None)], "doc_id bigint, quality int")
    assert rules.fit(docs, one) == 1.0 and rules.fit(docs, one.limit(0)) == 0.0
    model = rules.RuleEnsemble([((0, True, 0.5),)], np.array([2.0]), -1.0)
    out = rules.with_quality(docs, model)
    assert out.columns == ["doc_id", "text", "score"] and out.count() == 4
    assert {r["text"]: round(r["score"], 6) for r in out.collect()}["a"] == round(1 / (1 + math.exp(-1.0)), 6)
    assert rules.with_quality(docs.limit(0), model).count() == 0
