"""Near-duplicate families, shared passages and chains of links."""

import itertools
import random
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import components, resemblance, simhash


def plain_kept(docs):
    """Smallest id of each component under exact Jaccard similarity of 5-word shingles of 0.8."""
    sets = {}
    for i, text in docs.items():
        words = text.lower().split()
        sets[i] = {" ".join(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()
    root = {i: i for i in docs}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    holders = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            holders[x].append(i)
    shared = defaultdict(int)
    for found in holders.values():
        for k, i in enumerate(found):
            for j in found[k + 1 :]:
                shared[i, j] += 1
    for (i, j), common in shared.items():
        if common / (len(sets[i]) + len(sets[j]) - common) >= 0.8:
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    return sorted({find(i) for i in docs})


def test_families_and_shared_passages(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(4000)]
    base, passage = rng.choices(words, k=220), rng.choices(words, k=90)
    docs = {}
    # A family whose members differ from its base in a few places, some so much that only others link them.
    for i in range(240):
        text = list(base)
        for k in rng.sample(range(220), rng.choice([0, 1, 3, 6, 9])):
            text[k] = rng.choice(words)
        docs[len(docs)] = " ".join(text)
    # Texts that share a long passage and are hardly like each other, and texts that are all but that passage.
    for i in range(150):
        docs[len(docs)] = " ".join(rng.choices(words, k=rng.randint(60, 140)) + passage + rng.choices(words, k=20))
    for i in range(130):
        docs[len(docs)] = " ".join(passage + rng.choices(words, k=rng.randint(8, 25)))
    for i in range(120):
        docs[len(docs)] = " ".join(rng.choices(words, k=rng.randint(1, 60)))
    rows = spark.createDataFrame([(i, t, len(t)) for i, t in docs.items()], "doc_id long, text string, n_chars long")
    kept = sorted(r["doc_id"] for r in resemblance.keep_one_of_similar(rows.repartition(7)).collect())
    want = plain_kept(docs)
    assert kept == want and 250 < len(want) < len(docs) - 150


def test_the_stage_links_by_simhash_and_by_similarity(spark):
    """Chains of both kinds: fingerprints within 2 bits, some of texts that are not similar, and similar sets."""
    rng = random.Random(11)
    words = [f"w{i}" for i in range(3000)]
    docs = {}
    for i in range(30):
        base = rng.choices(words, k=rng.randint(60, 140))
        near = [rng.choice(words) if rng.random() < 0.02 else w for w in base]
        # Three words repeated decide the fingerprint, what follows them decides the set of shingles.
        unit, tail = rng.sample(words, 3), rng.choices(words, k=80)
        for text in (base, near, tail + unit, unit * 200, unit * 200 + tail):
            docs[len(docs)] = " ".join(text)
    docs |= {len(docs): None, len(docs) + 1: " "}
    plain = {i: t or "" for i, t in docs.items()}
    prints = {i: simhash.text_fingerprint(t) for i, t in plain.items()}
    sets = {}
    for i, t in plain.items():
        w = t.split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    by_bits, similar = set(), set()
    for i, j in itertools.combinations(docs, 2):
        if (prints[i] ^ prints[j]).bit_count() <= 2:
            by_bits.add((i, j))
        if sets[i] == sets[j] or 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
            similar.add((i, j))
    assert by_bits - similar and similar - by_bits
    root = {i: i for i in docs}
    for _ in docs:
        for i, j in by_bits | similar:
            root[i] = root[j] = min(root[i], root[j])
    rows = spark.createDataFrame([(i, t, len(t or "")) for i, t in docs.items()], "doc_id long, text string, n_chars long")
    kept = sorted(r["doc_id"] for r in corpus_pipeline.one_of_each_group(spark, rows.unionAll(rows.limit(5)).repartition(3), "").collect())
    assert kept == sorted(set(root.values()))


def test_sketches_lose_no_similar_pair():
    rng = np.random.default_rng(2)
    for n in (1, 2, 7, 31, 32, 33, 100, 129, 1000):
        sets = []
        for _ in range(40):
            s = np.unique(rng.integers(-(2**62), 2**62, n))
            # Both sets of a pair, near the border of similarity 0.8.
            keep = max(1, len(s) - int(rng.integers(0, n // 8 + 1)))
            t = np.unique(np.concatenate((s[:keep], rng.integers(-(2**62), 2**62, int(rng.integers(0, n // 8 + 1))))))
            sets += [s, t]
        sketches = resemblance.Sketches(np.array([len(s) for s in sets]), [resemblance.parity_sketch(s) for s in sets])
        passed = 0
        for i, s in enumerate(sets):
            like = set(sketches.like(i, np.arange(len(sets)) != i).tolist())
            passed += len(like)
            similar = {j for j, t in enumerate(sets) if j != i and len(np.intersect1d(s, t)) >= 0.8 * len(np.union1d(s, t))}
            assert similar <= like
        assert passed < 40 * len(sets) or n < 10


def test_a_long_chain_takes_few_rounds(spark, monkeypatch):
    labels, stored = [], components.stored

    def noted(df, label):
        labels.append(label)
        return stored(df, label)

    monkeypatch.setattr(components, "stored", noted)
    n = 4000
    links = spark.range(n - 1).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    rows = components.connected_components(links.union(links.select(F.col("a") + n, F.col("b") + n))).collect()
    roots = {r["node"]: r["root"] for r in rows}
    assert len(roots) == 2 * n and {roots[i] == roots[0] for i in range(n)} == {True} == {roots[i] == roots[n] for i in range(n, 2 * n)}
    assert roots[0] < n <= roots[n] and labels.count("pointers") <= 15
