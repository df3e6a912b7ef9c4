"""Every operator over rows with nulls, repeats, empty and long texts, clashing columns, and empty tables."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import balltree, html_text, lattice, mixing, ownership, packing, quality, simhash, tokens, vptree
from tidemark.llm.queries import PIECES, WORDS, tokenizer_path

DOCS = (
    "doc_id long, text string, lang string, source string, n_chars long, "
    "uid long, fp long, score double, shard long, quota long, word string, row string, spans string, block long"
)
LONG = "lorem ipsum dolor " * 40_000


@pytest.fixture(scope="module")
def odd(spark):
    rows = [
        (1, "alpha beta gamma delta", "en", "a"),
        (1, "alpha beta gamma delta", "en", "a"),
        (1, "another text of the same id", "en", "b"),
        (None, "no id here", None, None),
        (None, None, None, None),
        (2, None, "en", "a"),
        (3, "", "en", None),
        (4, " \t\n", "de", ""),
        (5, LONG, "de", "b"),
        (6, LONG, "de", "a"),
        (7, "password = 'abcdefgh1234'", "en", "a"),
        (8, "ünïcode 日本語 👍🏽 \x00 end", "en", "c"),
    ]
    return spark.createDataFrame([(*r, None if r[1] is None else len(r[1]), *[None] * 9) for r in rows], DOCS)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 0, 0), (None, 1, 0), (3, None, None), (1, 0, 1)], "doc_id long, quality int, toxic int")


def per_document(labels):
    return {
        "quality": lambda d: quality.score_documents(d, quality.train(d, labels)),
        "lattice": lambda d: lattice.score_documents(d, tokenizer_path(PIECES)),
        "secrets": ownership.scan_secrets,
        "mixing": mixing.mix_sources,
        "copies": simhash.near_duplicates,
        "tokens": lambda d: tokens.count_tokens(d, tokenizer_path(PIECES)),
    }


@pytest.mark.parametrize("name", ["quality", "lattice", "secrets", "mixing", "copies", "tokens"])
def test_one_row_per_document(spark, odd, labels, name):
    run = per_document(labels)[name]
    ids = sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in run(odd).select("doc_id").collect())
    assert ids == sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in odd.select("doc_id").collect())
    assert run(odd.limit(0)).count() == 0


def test_results_of_empty_texts(odd, labels):
    counted = {r["doc_id"]: r for r in tokens.count_tokens(odd, tokenizer_path(PIECES)).collect()}
    assert (counted[2]["n_bytes"], counted[2]["n_tokens"], counted[2]["over_limit"]) == (0, 0, False)
    assert counted[5]["over_limit"]
    prints = {r["doc_id"]: r for r in simhash.near_duplicates(odd).collect()}
    assert {prints[i]["fingerprint"] for i in (2, 3, 4)} == {"0" * 16}
    assert {prints[i]["component_id"] for i in (2, 3, 4)} == {2}
    assert prints[5]["component_id"] == prints[6]["component_id"] == 5
    found = {r["doc_id"]: r for r in ownership.scan_secrets(odd).collect()}
    assert found[7]["n_assign"] == 1 and found[7]["spans"] == "assign:0:24" and found[3]["spans"] == ""
    scored = [r for r in lattice.score_documents(odd, tokenizer_path(PIECES)).collect() if r["doc_id"] == 3]
    assert scored[0]["n_tokens"] == 1 and scored[0]["score"] < 0


def test_packing_covers_odd_rows(odd):
    pieces = packing.pack_documents(odd, tokenizer_path(WORDS)).collect()
    assert sum(r["length"] for r in pieces) == sum(len(tokens_of(r["text"])) + 1 for r in odd.select("text").collect())
    assert packing.pack_documents(odd.limit(0), tokenizer_path(WORDS)).count() == 0


def tokens_of(text):
    from tokenizers import Tokenizer

    global _WORDS
    if "_WORDS" not in globals():
        _WORDS = Tokenizer.from_file(tokenizer_path(WORDS))
    return _WORDS.encode(text or "", add_special_tokens=False).ids


def test_pages(spark):
    schema = "page_id long, url string, html string, text string, host string, shard long"
    rows = [(1, None, None), (None, "u", ""), (2, "http://h/a", "<p>x"), (2, "http://h/a", "<p>x"), (3, "not a url", "<article>" + "a b " * 50_000)]
    pages = spark.createDataFrame([(*r, None, None, None) for r in rows], schema)
    got = sorted((r["page_id"] or 0, r["text"][:3], r["n_chars"]) for r in html_text.extract_pages(pages).collect())
    assert got == [(0, "", 0), (1, "", 0), (2, "x", 1), (2, "x", 1), (3, "a b", 199_999)]
    assert html_text.extract_pages(pages.limit(0)).count() == 0


@pytest.mark.parametrize("run", [balltree.exact_top_k, vptree.nearest])
def test_vectors(spark, run):
    rows = [
        (0, [1.0, 0.0]),
        (0, [1.0, 0.0]),
        (20, [0.5, 0.5]),
        (3, [0.5, 0.5]),
        (4, None),
        (5, [float("nan"), 1.0]),
        (6, [float("inf"), 1.0]),
        (7, [None, 1.0]),
        (None, [1.0, 1.0]),
        (8, [1.0]),
        (9, [0.0, 0.0]),
    ]
    table = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<float>, label int, shard int")
    got = [(r["query_id"], r["rank"], r["vec_id"]) for r in run(table).orderBy("query_id", "rank").collect()]
    zero = [] if run is vptree.nearest else [9]
    places = [(0, v) for v in [8, 3, 20] + zero] + [(20, v) for v in [0, 3, 8] + zero]
    want, last, n = [], None, 0
    for q, v in places:
        n = n + 1 if q == last else 1
        last = q
        want.append((q, n, v))
    assert got == want
    assert run(table.limit(0)).count() == 0
    assert run(table.where("vec_id = 0")).count() == 0


def test_stages_keep_columns(spark, odd, labels, tmp_path):
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    odd.write.parquet(f"{tmp_path}/documents.parquet")
    odd.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    labels.limit(0).write.parquet(f"{tmp_path}/none/labels.parquet")
    for folder in (str(tmp_path), f"{tmp_path}/none"):
        docs = spark.read.parquet(f"{folder}/documents.parquet")
        for name, stage in corpus_pipeline.STAGES[:-1]:
            after = stage(spark, docs, folder)
            assert after.columns == docs.columns, name
            after.write.parquet(f"{folder}/{name}")
            docs = spark.read.parquet(f"{folder}/{name}")
        assert corpus_pipeline.STAGES[-1][1](spark, docs, folder).count() >= 0
    assert docs.count() == 0


def test_masking(spark, odd):
    wide = "token: commonlyquoted99"
    rows = [(i, f"{wide} here", "en", f"s{i}") for i in range(5)] + [(9, f"a secret = only-here-123456 {wide}", "en", "s1"), (10, None, "en", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long"))
    got = {r["doc_id"]: r for r in ownership.mask_secrets(docs).collect()}
    assert got[9]["text"] == f"a [secret] {wide}" and got[9]["n_chars"] == len(got[9]["text"])
    assert got[0]["text"] == f"{wide} here" and got[10]["text"] is None
