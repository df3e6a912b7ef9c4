"""Copied and owner-specific credentials; blocks that only a host's repetition can judge; counts against the library."""

from __future__ import annotations

import random
from collections import defaultdict

import public_tokenizers
import pytest
import sentencepiece

from tidemark.llm import html_text, ownership, tokens

VALUE = "Zx8Qp2Lm9Rt4Vb7Nc1Ws5Yd"


@pytest.mark.parametrize(
    "seen, live",
    [
        ([("ann", f"r{i}") for i in range(9)], True),  # one owner, many repositories: reused
        ([(f"o{i}", "shared") for i in range(9)], True),  # many owners of one repository
        ([(f"o{i}", f"r{i}") for i in range(9)], False),  # copied everywhere
        ([(None, None), ("", "r"), ("a", "s")], False),  # a null owner is one of its own
        ([(None, "r"), (None, "s"), (None, "t"), ("a", "u")], True),
        ([("a", "r"), ("b", "s")] * 20, True),  # repeats add nothing
    ],
)
def test_owners_and_repositories_both_decide(spark, seen, live):
    rows = [(i, f"use {VALUE} now", o, r) for i, (o, r) in enumerate(seen)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, user string, place string")
    got = ownership.scan_secrets(docs, owner="user", repo=("place",)).collect()
    assert len(got) == len(seen)
    assert {(r["spans"], r["n_live"], r["n_copied"]) for r in got} == {("live:4:27", 1, 0) if live else ("", 0, 1)}


def test_copied_values_by_plain_count(spark):
    rng = random.Random(3)
    values = ["".join(rng.sample("ABCDEFGHabcdefgh23456789", 22)) + "aB7c9" for _ in range(12)]
    rows = [(i, " and ".join(rng.sample(values, rng.randrange(0, 4))), f"o{rng.randrange(5)}", f"r{rng.randrange(4)}") for i in range(60)]
    owners, repos = defaultdict(set), defaultdict(set)
    for _, text, o, r in rows:
        for v in text.split(" and "):
            owners[v].add(o)
            repos[v].add(r)
    docs = spark.createDataFrame(rows, "doc_id long, text string, user string, place string")
    got = {r["doc_id"]: (r["n_live"], r["n_copied"]) for r in ownership.scan_secrets(docs, "user", ("place",), 3, 3).collect()}
    for i, text, _, _ in rows:
        found = text.split(" and ") if text else []
        copied = sum(len(owners[v]) > 3 and len(repos[v]) > 3 for v in found)
        assert got[i] == (len(found) - copied, copied)


def test_blocks_around_articles_are_judged_and_not_dropped(spark):
    rng = random.Random(8)
    rows, want = [], {}
    for i in range(12):
        head, lead, teaser, more = (" ".join(f"{k}{rng.randrange(10**6)}" for _ in range(9)) for k in "hltm")
        menu = "<div>All about our great host and its many services</div>"
        rows.append((i, f"https://a.example/{i}", f"<main>{menu}<h1>{head}</h1><p>{lead}</p><article><p>{teaser}</p></article><p>{more}</p></main><div>outside of main</div>"))
        want[i] = "\n".join([head, lead, teaser, more])
        rows.append((100 + i, f"https://b.example/{i}", f"{menu}<h1>{head}</h1><article><p>{teaser}</p></article>"))
        want[100 + i] = f"{head}\n{teaser}"
    table = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r["page_id"]: r["text"] for r in html_text.extract_pages(table).collect()} == want


def test_runs_are_counted_over_the_whole_host(spark):
    """A notice on 5 of 300 pages in many shards is found, one on 2 pages is not; shards change nothing."""
    rng = random.Random(9)
    rows, want = [], {}
    for i in range(300):
        own = " ".join(f"w{rng.randrange(10**6)}" for _ in range(12))
        often = "<p>Our office stays closed on all public holidays</p>" if i % 60 == 0 else ""
        seldom = "<p>This one was printed on two pages only</p>" if i in (7, 8) else ""
        rows.append((i, f"http://host.example/{i}", f"{often}<p>{own}</p>{seldom}"))
        want[i] = own + ("\nThis one was printed on two pages only" if seldom else "")
    table = spark.createDataFrame(rows, "page_id long, url string, html string")
    for limits in ({}, {"shard_pages": 20}, {"shard_chars": 5000}):
        assert {r["page_id"]: r["text"] for r in html_text.extract_pages(table, **limits).collect()} == want


def test_runs_of_a_shard_by_plain_count():
    rng = random.Random(5)
    streams = [[rng.choice("ab") for _ in range(rng.randrange(0, 14))] for _ in range(9)]
    for run in (1, 2, 3, 6):
        pages = defaultdict(set)
        for p, s in enumerate(streams):
            for i in range(len(s) - run + 1):
                pages[html_text.run_key(s[i : i + run])].add(p)
        got = list(html_text.run_pages(streams, run))
        assert len(got) == len(dict(got)) and dict(got) == {k: len(v) for k, v in pages.items()}
    assert list(html_text.run_pages([], 6)) == [] and list(html_text.run_pages([[]], 6)) == []


def test_a_block_of_megabytes(spark):
    text = "word " * 600_000
    table = spark.createDataFrame([(1, "http://x.example/", f"<p>{text}</p>")], "page_id long, url string, html string")
    assert html_text.extract_pages(table).first()["n_chars"] == len(text) - 1


def test_token_counts_equal_the_library(spark):
    path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=str(path))
    rng = random.Random(11)
    alphabet = [" ", "  ", "\t", "\n", "　", "▁", "a", "the ", "New", "ing", "é", "é", "ﬁ", "½", "中文", "かな", "🙂", "​", "\x00", "\x07", "<s>", "</s>", "<unk>", "<0x41>", "123", "...", "'s"]
    some = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(0, 25))) for _ in range(1500)]
    given = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    rows = list(enumerate([*some, *given, None, "", "x" * 5000]))
    got = {r["doc_id"]: r["n_tokens"] for r in tokens.count_tokens(spark.createDataFrame(rows, "doc_id long, text string"), str(path)).collect()}
    assert got == {i: len(model.encode(t or "")) for i, t in rows}
