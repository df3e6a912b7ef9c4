"""The classifier's fit on every labelled row, in shards."""

import random
import zlib
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import quality


def tables(spark, texts, marks):
    docs = [(i, t, "en", "a", len(t or "")) for i, t in texts]
    return (
        spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long"),
        spark.createDataFrame([(i, q, 0) for i, q in marks], "doc_id long, quality int, toxic int"),
    )


def learned_from(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5 != 0


def test_the_stage_learns_from_labelled_rows_beyond_the_sample(spark, tmp_path):
    """Texts of one kind are labelled bad only where the sample of the operator's query does not reach."""
    rng = random.Random(4)
    order = [r["id"] for r in spark.range(9000).orderBy(F.xxhash64(F.col("id").cast("string")), "id").collect()]
    inside = set([i for i in order if learned_from(i)][: quality.SAMPLE])
    assert sum(map(learned_from, order)) > 1.3 * quality.SAMPLE
    good, bad, late = (["good", "words", "of", "prose"], ["spam", "buy", "click"], ["zeta", "eta", "theta", "iota"])
    texts, marks = [], []
    for n, i in enumerate(order):
        kind = good if n % 8 else bad
        if learned_from(i) and i not in inside and n % 2:
            kind = late
        texts.append((i, " ".join(rng.choices(kind, k=6))))
        marks.append((i, int(kind is good)))
    unlabelled = [(10_000 + n, " ".join(rng.choices(kind, k=6))) for n, kind in enumerate([good, late] * 20)]
    docs, labels = tables(spark, texts + unlabelled, marks)
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    kept = {r["doc_id"] for r in corpus_pipeline.good_quality(spark, docs, str(tmp_path)).collect()}
    assert {i for i, _ in unlabelled if i in kept} == {i for i, _ in unlabelled[::2]}


def odd_rows(spark, n):
    rng = random.Random(9)
    words = [[f"{kind}{k}" for k in range(60)] for kind in "ab"]
    texts = [(i, " ".join(rng.choices(words[i % 3 == 0] if rng.random() < 0.9 else words[0], k=rng.randint(0, 12)))) for i in range(n)]
    marks = [(i, int(i % 3 != 0)) for i in range(n)]
    # Null texts and ids, repeated rows and labels, labels that do not count or have no document.
    return tables(spark, [*texts, *texts[:9], (n, None), (None, "a1 b2")], [*marks, *marks[:9], (2, 0), (n, 1), (n, None), (n + 1, 1), (None, 1), (5, 7)])


def test_one_shard_gives_the_model_of_one_fit(spark):
    docs, labels = odd_rows(spark, 200)
    one, whole = quality.train(docs, labels), quality.train(docs, labels, sample=None)
    assert np.allclose(one.weights, whole.weights, rtol=1e-6, atol=1e-12) and np.array_equal(one.squares, whole.squares)
    assert np.allclose([one.bias, one.slope, one.offset], [whole.bias, whole.slope, whole.offset], rtol=1e-7)
    for q in (0, 1):
        some = labels.where(F.col("quality") == q)
        assert quality.train(docs, some, sample=None).offset == quality.train(docs, some).offset
    assert quality.train(docs, labels.limit(0), sample=None).offset == 0


def test_shards_by_a_plain_version(spark):
    docs, labels = odd_rows(spark, 300)
    model = quality.train(docs, labels, sample=None, shard_rows=70)
    text, marks = {}, {}
    for r in docs.where("doc_id is not null").collect():
        text[r["doc_id"]] = min(text.get(r["doc_id"], r["text"] or ""), r["text"] or "")
    for r in labels.where("doc_id is not null and quality in (0, 1)").collect():
        if learned_from(r["doc_id"]):
            marks[r["doc_id"]] = max(marks.get(r["doc_id"], 0), r["quality"])
    shards = -(-len(marks) // 70)
    dealt = spark.range(302).select("id", F.pmod(F.xxhash64(F.lit(quality.SEED), F.col("id").cast("string")), F.lit(shards)).alias("s"))
    members = defaultdict(list)
    for r in dealt.orderBy("id").collect():
        if r["id"] in marks and r["id"] in text:
            members[r["s"]].append(r["id"])
    assert len(members) == shards > 3
    part = {i: k % 5 for ids in members.values() for k, i in enumerate(ids)}
    rows = {i: quality.indicators(text[i]) for i in part}

    def fitted(without):
        kept = [i for i in part if part[i] != without]
        y = np.array([marks[i] for i in kept])
        ratios = quality.log_count_ratios([rows[i] for i in kept], y)
        w, bias = np.zeros(quality.BUCKETS), 0.0
        for ids in members.values():
            here = [i for i in ids if part[i] != without]
            a, b = quality.hinge_weights([rows[i] for i in here], np.array([marks[i] for i in here]), ratios, np.bincount(y, minlength=2))
            w, bias = w + a * len(here) / len(kept), bias + b * len(here) / len(kept)
        return quality.Model((w * ratios).astype(np.float32), (ratios**2).astype(np.float32), bias, 1.0, 0.0)

    whole, parts = fitted(None), [fitted(p) for p in range(5)]
    slope, offset = quality.logistic_curve(np.array([parts[part[i]].margin(rows[i]) for i in part]), np.array([marks[i] == 1 for i in part]))
    assert np.allclose(model.weights, whole.weights, rtol=1e-5, atol=1e-9) and np.array_equal(model.squares, whole.squares)
    assert np.allclose([model.bias, model.slope, model.offset], [whole.bias, slope, offset], rtol=1e-6)
    again = quality.train(docs.repartition(5), labels.repartition(3), sample=None, shard_rows=70)
    assert np.array_equal(model.weights, again.weights) and model.bias == again.bias
