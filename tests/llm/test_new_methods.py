"""Resampling, token-id files and token alignment against plain versions on whole small tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import alignment, idfiles, importance
from tidemark.llm.queries import BYTES, PIECES, QUERIES, WORDS, tokenizer_path

SMALL = "/root/testdata/sf0.001"
ODD = [
    (1, "alpha beta gamma delta " * 8),
    (1, "alpha beta gamma delta " * 8),
    (1, "another text of the same id, " * 9),
    (None, "no id here, but words enough " * 6),
    (None, None),
    (2, None),
    (3, ""),
    (4, " \t\n"),
    (5, "lorem ipsum dolor " * 40_000),
    (8, "ünïcode 日本語テキスト 👍🏽 \x00 end\x85 of 　it all  two\n\n lines\r\n"),
    (9, "a ▁ mark ▁in▁text <s> </s> <0x41> <|endoftext|><|startoftext|> x"),
    (10, "   three blanks before"),
    (11, "it's they'll I'D we've 12,345.67 é ﬁ ﻿ x\ty"),
    (12, "z" * 5_000 + " " + "日" * 3_000),
]


@pytest.fixture(scope="module")
def odd(spark):
    schema = "doc_id long, text string, uid long, score long, pair int, word string, place long, shard long, at long, part long"
    return spark.createDataFrame([(*r, *[None] * 8) for r in ODD], schema)


@pytest.fixture(scope="module")
def small(spark):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]


def sorted_rows(rows):
    return sorted(map(tuple, rows), key=lambda r: tuple((x is None, x or 0) for x in r))


# -- resampling ---------------------------------------------------------------------------------


def plain_resample(docs, target):
    def features(text):
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
        return words, [" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]

    def bucket(feature):
        return zlib.crc32(feature.encode()) % 10000

    source, wanted = (Counter(bucket(f) for t in texts for f in features(t)[1]) for texts in ([t for _, t in docs], target))
    s_all, t_all = source.total(), wanted.total()
    gain = [math.floor(1000 * math.log((wanted[b] + 1.0) * (s_all + 10000) / ((source[b] + 1.0) * (t_all + 10000)))) for b in range(10000)]
    rows = []
    for doc_id, text in docs:
        words, found = features(text)
        weight = sum(gain[bucket(f)] for f in found)
        h = int(hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        rows.append([doc_id, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words) >= 20])
    pool = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1], r[2]))
    ranks = {id(r): n for n, r in enumerate(pool[: 5 * len(pool) // 100], 1)}
    return [(*r[:4], ranks.get(id(r))) for r in rows]


def test_resampling_equals_the_plain_version(spark, small):
    target = [r["text"] for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    got = QUERIES["op11_target_resampling"](spark, SMALL)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"] and {t for _, t in got.dtypes} == {"bigint"}
    rows = got.collect()
    assert sorted_rows(rows) == sorted_rows(plain_resample(small, target)) and sum(r["rank"] is not None for r in rows) > 5


def test_resampling_of_odd_rows(spark, odd, monkeypatch):
    target = spark.createDataFrame([("gamma delta alpha",), (None,), ("日本語テキスト",)], "text string")
    many = odd
    for _ in range(3):
        many = many.union(many)
    want = plain_resample([tuple(r) for r in many.select("doc_id", "text").collect()], ["gamma delta alpha", None, "日本語テキスト"])
    assert sorted_rows(importance.resample(many, target).collect()) == sorted_rows(want)
    assert importance.resample(odd.limit(0), target).count() == 0
    assert importance.resample(odd, target.limit(0)).count() == len(ODD)


def test_the_head_changes_no_bucket(small):
    texts = [t for _, t in small[:40]] + [t for _, t in ODD]
    words = [w for w, _ in Counter(w for t in texts for w in importance.words_of(t)).most_common(300)]
    pairs = np.arange(0, 256 * min(len(words), 256), 3)
    heads = [importance.Head([], np.zeros(0, int)), importance.Head(words, np.zeros(0, int)), importance.Head(words, pairs[pairs % 256 < len(words)])]
    results = [importance.Features(h).of(texts) for h in heads]
    for _, buckets, owners in results:
        for n in (0, 1, 2):
            assert (buckets[n] == results[0][1][n]).all() and (owners[n] == results[0][2][n]).all()
    want = [zlib.crc32(b" ".join(w[i : i + 3])) % 10000 for w in map(importance.words_of, texts) for i in range(len(w) - 2)]
    assert results[2][1][2].tolist() == want


def test_places_are_consecutive_over_ranges(spark, monkeypatch):
    monkeypatch.setattr(importance, "ROWS_PER_RANGE", 50)
    rows = spark.range(1000).select((F.col("id") * 7919 % 250).alias("v"), "id")
    got = importance.numbered(rows, [F.col("v").desc(), F.col("id")], 1000).orderBy("place").collect()
    assert [r["place"] for r in got] == list(range(1, 1001))
    assert [(-r["v"], r["id"]) for r in got] == sorted((-r["v"], r["id"]) for r in got)


# -- token-id files -----------------------------------------------------------------------------


def plain_ids(docs):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_path(WORDS))
    return [(d, [*library.encode(t or "", add_special_tokens=False).ids, 1]) for d, t in docs]


def plain_digests(docs):
    start, rows = 0, []
    for d, ids in sorted(plain_ids(docs), key=lambda r: (r[0] is None, r[0] or 0)):
        rows.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return rows


def test_token_files_equal_the_library(spark, small):
    got = QUERIES["op12_token_files"](spark, SMALL)
    assert got.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and {t for _, t in got.dtypes} == {"bigint"}
    assert sorted_rows(got.collect()) == plain_digests(small)


def test_token_files_of_odd_rows(spark, odd):
    rows = sorted(idfiles.token_files(odd, tokenizer_path(WORDS)).collect(), key=lambda r: r["start"])
    want = plain_digests(ODD)
    # Rows of one id may lie in another order than in the plain version.
    assert sorted_rows((r[0], *r[2:]) for r in rows) == sorted_rows((r[0], *r[2:]) for r in want)
    assert [r["doc_id"] for r in rows] == [r[0] for r in want]
    assert [r["start"] for r in rows] == [sum(x["n_tokens"] for x in rows[:i]) for i in range(len(rows))]
    assert idfiles.token_files(odd.limit(0), tokenizer_path(WORDS)).count() == 0


def test_one_document_is_read_alone(spark, small, tmp_path):
    docs = spark.createDataFrame(small, "doc_id long, text string")
    shards = idfiles.write_ids(docs, tokenizer_path(WORDS), str(tmp_path / "ids"), shard_bytes=40_000)
    assert len(shards) > 3 and sum(n for n, _ in shards) == len(small)
    names = sorted(p.name for p in (tmp_path / "ids").iterdir())
    assert [n for n in names if n.startswith("shard")] == [idfiles.shard_name(i) for i in range(len(shards))]
    assert [n for n in names if n.startswith(".")] == []
    kept = next(p for p in (tmp_path / "ids").iterdir() if p.name.startswith("dictionary"))
    assert kept.name == f"dictionary-{hashlib.sha256(kept.read_bytes()).hexdigest()}.bin"
    want = dict(plain_ids(small))
    opened = [idfiles.Shard(str(tmp_path / "ids"), i) for i in range(len(shards))]
    for d in random.Random(4).sample(sorted(want), 40):
        found = [ids.tolist() for s in opened for ids in s.document(d)]
        assert found == [want[d]]
    assert [ids for s in opened for ids in s.document(-5)] == []
    plain = sum(4 * len(ids) for ids in want.values())
    assert sum(p.stat().st_size for p in (tmp_path / "ids").iterdir()) < plain / 2


def test_a_foreign_dictionary_is_refused(spark, small, tmp_path):
    docs = spark.createDataFrame(small[:20], "doc_id long, text string")
    idfiles.write_ids(docs, tokenizer_path(WORDS), str(tmp_path / "ids"))
    kept = next(p for p in (tmp_path / "ids").iterdir() if p.name.startswith("dictionary"))
    kept.write_bytes(kept.read_bytes()[:-1] + b"?")
    with pytest.raises(ValueError, match="hash"):
        idfiles.Shard(str(tmp_path / "ids"), 0)


# -- alignment ----------------------------------------------------------------------------------


def plain_tokens(text):
    """Ids and bytes of both tokenizers over the whole text, by the libraries."""
    import sentencepiece
    from tokenizers import Tokenizer

    if "libraries" not in CACHE:
        a = Tokenizer.from_file(tokenizer_path(BYTES))
        a.encode_special_tokens = True
        CACHE["libraries"] = a, sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(PIECES)), alignment._byte_letters()
    a, b, letters = CACHE["libraries"]
    if not text:
        return [], []
    ids_a = a.encode(" " + text, add_special_tokens=False).ids
    ids_b = b.encode(text)
    tokens_a = [(i, bytes(letters[c] for c in a.id_to_token(i))) for i in ids_a]
    tokens_b = [(i, bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()) for i in ids_b]
    want = (" " + text).encode()
    if any(b"".join(t for _, t in tokens) != want for tokens in (tokens_a, tokens_b)):
        return [], []
    return tokens_a, tokens_b


CACHE = {}


def plain_alignment(docs):
    found = []
    for doc_id, text in docs:
        a, b = plain_tokens(text)
        ends = []
        for tokens in (a, b):
            at, out = 0, []
            for _, t in tokens:
                out.append((at, at + len(t)))
                at += len(t)
            ends.append(out)
        shared = sorted({e for _, e in ends[0]} & {e for _, e in ends[1]})
        links, j = [], 0
        for (i, _), (lo, hi) in zip(a, ends[0]):
            while j and ends[1][j - 1][1] > lo:
                j -= 1
            while j < len(b) and ends[1][j][0] < hi:
                if ends[1][j][1] > lo:
                    links.append((i, b[j][0]))
                j += 1
        parts, x, y = [], 0, 0
        for end in shared:
            xa, yb = x, y
            while x < len(a) and ends[0][x][1] <= end:
                x += 1
            while y < len(b) and ends[1][y][1] <= end:
                y += 1
            parts.append(",".join(str(i) for i, _ in a[xa:x]) + "|" + ",".join(str(i) for i, _ in b[yb:y]))
        found.append((doc_id, len(a), len(b), len(shared), links, hashlib.sha256(";".join(parts).encode()).hexdigest() if a else ""))
    counts = Counter(p for r in found for p in set(r[4]))
    best = defaultdict(int)
    for (i, _), n in counts.items():
        best[i] = max(best[i], n)
    return [(d, na, nb, g, len(ls), sum(counts[p] == best[p[0]] for p in ls), sum(counts[p] for p in ls), sha) for d, na, nb, g, ls, sha in found]


def test_alignment_equals_the_plain_version(spark, small):
    got = QUERIES["op13_token_alignment"](spark, SMALL)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    rows = sorted_rows(got.collect())
    assert rows == sorted_rows(plain_alignment(small)) and sum(r[1] for r in rows) > 100_000


@pytest.mark.parametrize("head", [0, 7, 1 << 20])
def test_alignment_of_odd_rows(spark, odd, head):
    files = tokenizer_path(BYTES), tokenizer_path(PIECES)
    rows = sorted_rows(alignment.cross_align(odd, *files, head_pairs=head).collect())
    assert rows == sorted_rows(plain_alignment(ODD))
    assert alignment.cross_align(odd.limit(0), *files).count() == 0


def test_units_give_the_libraries_ids():
    files = tokenizer_path(BYTES), tokenizer_path(PIECES)
    units, rng = alignment.Units(alignment.ByteLevel(files[0]), alignment.Pieces(files[1])), random.Random(9)
    letters = ["a", "B", "é", "日", "1", "½", ".", "'", "s", " ", " ", "\n", "\t", "\r", "\xa0", "\u2003", "\x1c", "\x85", "\u3000", "👍", "é", "▁", "\x00", "the ", "<s>", "ing"]
    plain_tokens("a")
    a, b, _ = CACHE["libraries"]
    for text in ["".join(rng.choices(letters, k=rng.randint(1, 25))) for _ in range(4000)]:
        at = units.places(units.split(text))
        assert units.a.of(at)[0].tolist() == a.encode(" " + text, add_special_tokens=False).ids, repr(text)
        # A mark in the text may join a blank before it; such a text never equals its tokens.
        assert units.b.of(at)[0].tolist() == b.encode(text) or "▁" in text, repr(text)
        tokens = plain_tokens(text)[0]
        assert bool(tokens) == (min(units.size[i] for i in at) >= 0), repr(text)


def test_a_window_is_aligned_alike_before_and_after_it_is_known(small, monkeypatch):
    files = tokenizer_path(BYTES), tokenizer_path(PIECES)
    texts = [t for _, t in small]
    import pyarrow as pa

    ids = pa.array(range(len(texts)))
    whole = alignment.Aligner(*files)
    once, again = whole.batch(ids, texts), whole.batch(ids, texts)
    monkeypatch.setattr(alignment, "REMEMBERED", 10)
    forgetful = alignment.Aligner(*files)
    parts = [forgetful.batch(ids[i : i + 7], texts[i : i + 7]) for i in range(0, len(texts), 7)]
    assert once.equals(again) and once.to_pylist() == [r for p in parts for r in p.to_pylist()]


def test_units_of_plain_texts_need_no_pattern(monkeypatch):
    """Texts with single blanks only are split at once, into the units that the pattern gives."""
    units, pattern = alignment.Units(None, None), alignment._UNIT
    odd = ["a", "a b", " a b", "a b ", "a  b", "a\nb c", "a\t b", "é b c", "a　 b", " ", "\n", "\x1cb a", "a \nb", "x y z"]
    assert [units.split(t) for t in odd] == [pattern.split(" " + t) for t in odd]
    monkeypatch.setattr(alignment, "_UNIT", None)
    assert units.split("one two three") == [" one", " two", " three"]
