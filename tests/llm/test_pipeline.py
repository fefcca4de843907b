"""The pipeline's stages on a small table, each on what the one before kept, and the whole run."""

from __future__ import annotations

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from tollspan.llm import langid, near_copies, packing, toxicity
from tollspan.llm.common import remainder, table

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, SF, "documents").persist()


def test_toxicity_stage_follows_the_model(spark, docs):
    labels = table(spark, SF, "labels")
    model = toxicity.fit(docs, labels.filter(remainder("doc_id", 5) != 0))
    odd = docs.limit(3).withColumns({"doc_id": F.lit(10**9) + F.col("doc_id"), "text": F.lit(None).cast("string")})
    kept = pipeline.toxicity_stage(spark, docs.unionByName(odd), SF)
    assert kept.columns == docs.columns
    got = {r["doc_id"] for r in kept.collect()}
    score = {r["doc_id"]: r["text"] for r in docs.collect()}
    want = {i for i, t in score.items() if model.scores([t])[0] < 0.5}
    assert {i for i in got if i < 10**9} == want and sum(i >= 10**9 for i in got) == 3
    assert pipeline.toxicity_stage(spark, docs.limit(0), SF).count() == 0


def test_language_stage_drops_other_languages_and_keeps_its_own(spark, docs):
    strange = [
        "Minä olen suomalainen ja asun Helsingissä, missä on paljon kauniita puistoja ja järviä ympärillä.",
        "Привет, как дела? Это русский текст, который не должен быть принят.",
        "Jestem z Polski i mieszkam w Warszawie, gdzie jest wiele pięknych parków i muzeów.",
        "12345 !!! ---", "", None,
    ]
    extra = spark.createDataFrame([(10**9 + i, t, None, "x", 1) for i, t in enumerate(strange)], docs.schema)
    kept = pipeline.language_stage(spark, docs.unionByName(extra), SF)
    got = {r["doc_id"] for r in kept.select("doc_id").collect()}
    assert not any(i >= 10**9 for i in got)
    with_letters = docs.filter(F.col("text").rlike("[a-zA-Z]")).count()
    assert len(got) >= 0.97 * with_letters and kept.columns == docs.columns
    assert langid.fit(docs).least > 0.3


def _shingles(text):
    words = (text or "").encode().lower().split()
    return {b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def _kept_by_hand(rows):
    sets = {i: _shingles(t) for i, t in rows}
    label = {i: i for i in sets}

    def find(i):
        while label[i] != i:
            label[i] = label[label[i]]
            i = label[i]
        return i

    ids = sorted(sets)
    for at, a in enumerate(ids):
        for b in ids[at + 1 :]:
            x, y = sets[a], sets[b]
            if min(len(x), len(y)) >= 0.8 * max(len(x), len(y)) and len(x & y) >= 0.8 * len(x | y):
                label[max(find(a), find(b))] = min(find(a), find(b))
    return {find(i) for i in ids}


def test_near_copy_stage_equals_brute_force(spark, docs):
    kept = pipeline.near_copy_stage(spark, docs, SF)
    assert {r["doc_id"] for r in kept.collect()} == _kept_by_hand([(r["doc_id"], r["text"]) for r in docs.collect()])


def test_texts_that_share_a_passage_stay_and_are_not_compared(spark):
    rng = np.random.default_rng(12)

    def prose(n):
        return [f"w{v}" for v in rng.integers(0, 10**9, n)]

    passage = prose(150)
    rows = [(i, " ".join([*prose(60), *passage, *prose(60)])) for i in range(80)]
    rows += [(100 + i, " ".join([*t.split()[:-3], "other", "end", str(i)])) for i, (_, t) in enumerate(rows[:10])]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    assert {r["doc_id"] for r in near_copies.drop_near_copies(df).collect()} == set(range(80))
    classes = near_copies.frequency_classes(df)
    keys: dict = {}
    for i, t in rows:
        one = np.unique(near_copies.shingle_hashes(t, 5))
        for k in near_copies.part_keys(one, 0.8, classes):
            keys.setdefault(k, set()).add(i)
    # a key holds a text and its own near copy, never the texts that share the passage
    assert max(len(k) for k in keys.values()) == 2


def test_parity_bits_bound_the_difference():
    rng = np.random.default_rng(3)
    for n, apart in ((30, 4), (200, 30), (3000, 900)):
        pool = np.unique(rng.integers(0, 1 << 63, n + apart, dtype=np.uint64) * np.uint64(2))
        a, b = pool[:n], pool[apart // 2 : n + apart // 2]
        differ = int(np.bitwise_count(near_copies.parity_bits(a) ^ near_copies.parity_bits(b)).sum())
        only_one = len(np.setxor1d(a, b))
        assert differ <= only_one and (n > 1000 or differ > 0.8 * only_one)


def test_a_star_of_copies_equals_brute_force(spark, monkeypatch):
    """Copies of one text, each changed a little, that are partly too far apart; some are near to none."""
    monkeypatch.setattr(near_copies, "BLOCK", 32)
    rng = np.random.default_rng(21)
    base = [f"w{v}" for v in rng.integers(0, 10**9, 150)]
    rows = []
    for i in range(160):
        words = list(base)
        for at in rng.integers(0, 150, 1 + i % 9):
            words[at] = f"x{rng.integers(0, 10**9)}"
        rows.append((i, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    want = _kept_by_hand(rows)
    assert 10 < len(want) < 150
    assert {r["doc_id"] for r in near_copies.drop_near_copies(df).collect()} == want


def test_counters_add_up(spark):
    rows = [(i, "a b c d e f") for i in range(30)] + [(100 + i, f"x{i} y z q r") for i in range(10)]
    classes = near_copies.frequency_classes(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5))
    often = near_copies._counter(near_copies.shingle_hashes("a b c d e f", 5))
    seldom = near_copies._counter(near_copies.shingle_hashes("x3 y z q r", 5))
    assert classes[often].min() > 15 and classes[seldom].max() == 0
    assert near_copies.frequency_classes(spark.createDataFrame([], "text string")).max() == 0


def test_run_applies_all_stages(spark):
    out = pipeline.run(spark, SF).persist()
    kept = table(spark, SF, "documents")
    for _, stage in pipeline.STAGES[:-1]:
        kept = stage(spark, kept, SF).persist()
    ids = {r["doc_id"]: r["text"] for r in kept.collect()}
    pieces: dict = {}
    for r in out.collect():
        pieces.setdefault(r["doc_id"], []).append(r)
    assert set(pieces) == set(ids)
    chunks = packing._chunks(__import__("public_tokenizers").path("word_bpe_49k.json"))
    for doc_id, text in list(ids.items())[:40]:
        whole = chunks.ids([text or ""])[0] + np.array([2], "<u4").tobytes()
        for p in pieces[doc_id]:
            assert p["doc_tokens"] == len(whole) // 4
            assert p["ids_crc32"] == zlib.crc32(whole[4 * p["start"] : 4 * (p["start"] + p["length"])])
        assert sum(p["length"] for p in pieces[doc_id]) == len(whole) // 4
