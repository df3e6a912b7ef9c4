"""Secret scan with corpus-wide ownership frequency.

Candidates are assignments, access keys and long hex strings, and besides them any long token
that looks random. The hashes of their values are counted over the whole corpus by distinct owners
and repositories. A value with many owners and in many repositories is a copied example. Any other is owner-specific
and live-looking: one that few owners use, in however many repositories, or one that many owners of a single
repository share. Owner-specific random-looking tokens that no base span covers are added as spans.
"""

from __future__ import annotations

import hashlib
import math
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import stored, texts

# The base patterns and the order of their kinds.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex", "live")
ASSIGN_LENGTH = 8

TOKEN = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
LEAST_BITS = 3.5
OWNERS = 2
REPOS = 2
SALTS = 16

SPAN = "array<struct<start: int, kind: int, stop: int, value: string>>"


def entropy(token: str) -> float:
    """Bits per character."""
    n = len(token)
    return -sum(c / n * math.log2(c / n) for c in (token.count(ch) for ch in set(token)))


def looks_random(token: str) -> bool:
    kinds = (any(c.islower() for c in token), any(c.isupper() for c in token), any(c.isdigit() for c in token))
    return all(kinds) and sum(c.isdigit() for c in token) >= 2 and entropy(token) >= LEAST_BITS


def _hashed(value: str) -> str:
    return hashlib.sha256(value.encode("utf-8", "replace")).hexdigest()[:32]


def candidates(text: str) -> list[tuple[int, int, int, str]]:
    """(start, kind, end, hash of the value), base kinds and free random-looking tokens (kind 3)."""
    found = [(m.start(), 0, m.end(), _hashed(m[2])) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LENGTH]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end(), _hashed(m[0])) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end(), _hashed(m[0])) for m in HEX.finditer(text)]
    base = sorted(found)
    for m in TOKEN.finditer(text):
        if looks_random(m[0]) and all(m.end() <= s or m.start() >= e for s, _, e, _ in base):
            found.append((m.start(), 3, m.end(), _hashed(m[0])))
    return sorted(found)


def candidate_spans(text: Column) -> Column:
    """Candidates of each whole text; an empty array for null and empty texts."""

    @F.pandas_udf(SPAN)
    def scan(column: pd.Series) -> pd.Series:
        names = ("start", "kind", "stop", "value")
        return pd.Series([[dict(zip(names, c)) for c in candidates(t)] for t in texts(column)])

    return scan(text)


def _copied(found: DataFrame, owners: int, repos: int) -> DataFrame:
    """Values of rows (owner, repo, spans) with more than ``owners`` owners and more than ``repos`` repositories."""
    seen = found.select("owner", "repo", F.explode("spans.value").alias("value")).distinct()
    counted = seen.groupBy("value").agg(
        F.count_distinct(F.to_json(F.struct("owner"))).alias("owners"), F.count_distinct("repo").alias("repos")
    )
    return counted.where((F.col("owners") > owners) & (F.col("repos") > repos)).select("value")


def _judged(found: DataFrame, owners: int, repos: int) -> DataFrame:
    """uid and its spans with ``live``: whether the value is not one that many owners and repositories copy.

    Only the copied values are joined, and salted, since the spans of one example key may be most rows.
    """
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    copied = _copied(found, owners, repos).select("value", salts, F.lit(False).alias("own"))
    spans = found.select("uid", F.pmod(F.xxhash64("uid"), F.lit(SALTS)).cast("int").alias("salt"), F.inline("spans"))
    live = F.struct("start", "kind", "stop", F.coalesce("own", F.lit(True)).alias("live"))
    return spans.join(copied, ["value", "salt"], "left").groupBy("uid").agg(F.array_sort(F.collect_list(live)).alias("judged"))


def _texts_of(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["stop"])), ",")


def scan_secrets(docs: DataFrame, owner: str = "source", repo: tuple[str, ...] = ("source", "lang"), owners: int = OWNERS, repos: int = REPOS) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_copied for every row.

    n_live and n_copied count all spans by ownership. Null and empty texts have no spans: counts 0,
    the hash of the empty text and an empty ``spans``. Null owners and repositories are one owner
    and one repository, apart from empty ones. Repeated rows keep one result each, and since they share an owner they do
    not make a value look copied. An empty table gives an empty result.
    """
    rows = docs.select(
        F.monotonically_increasing_id().alias("uid"),
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col(f"`{owner}`").cast("string").alias("owner"),
        F.to_json(F.struct(*[F.col(f"`{c}`").cast("string").alias(f"r{i}") for i, c in enumerate(repo)])).alias("repo"),
        candidate_spans(F.col("text")).alias("spans"),
    )
    rows = stored(rows, "candidates")
    some = rows.where(F.size("spans") > 0)
    judged = some.select("uid", "doc_id").join(_judged(some, owners, repos), "uid")
    none = rows.where(F.size("spans") == 0).select("uid", "doc_id", F.expr("cast(array() as array<struct<start: int, kind: int, stop: int, live: boolean>>)").alias("judged"))
    both = judged.unionByName(none)

    def number(test) -> Column:
        return F.size(F.filter("judged", test)).cast("long")

    def of_kind(i: int) -> Column:
        return number(lambda s: s["kind"] == i)

    def shown(s: Column) -> Column:
        return (s["kind"] < 3) | s["live"]

    return both.select(
        "doc_id",
        *[of_kind(i).alias(f"n_{k}") for i, k in enumerate(KINDS[:3])],
        F.sha2(_texts_of(F.filter("judged", lambda s: s["kind"] < 3)), 256).alias("base_sha256"),
        _texts_of(F.filter("judged", shown)).alias("spans"),
        number(lambda s: s["live"]).alias("n_live"),
        number(lambda s: ~s["live"]).alias("n_copied"),
    )


MASK = "[secret]"


def mask_secrets(docs: DataFrame, owner: str = "source", repo: tuple[str, ...] = ("source", "lang"), owners: int = OWNERS, repos: int = REPOS) -> DataFrame:
    """The same rows with every owner-specific span of the text replaced by a mark.

    Widely copied examples stay. All columns stay; n_chars, where there is one, follows a changed
    text. Texts without candidates, null and empty ones are passed on as they are.
    """
    names = docs.columns
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"))
    scanned = packed.withColumn("spans", candidate_spans(F.col("row.text")))
    clean = packed.where(F.size(candidate_spans(F.col("row.text"))) == 0).select("row.*")
    some = stored(
        scanned.where(F.size("spans") > 0).select(
            F.monotonically_increasing_id().alias("uid"),
            "row",
            "spans",
            F.col("row")[owner].cast("string").alias("owner"),
            F.to_json(F.struct(*[F.col("row")[c].cast("string").alias(f"r{i}") for i, c in enumerate(repo)])).alias("repo"),
        ),
        "secret-rows",
    )
    judged = _judged(some.select("uid", "owner", "repo", "spans"), owners, repos)
    live = F.filter("judged", lambda s: s["live"])

    @F.pandas_udf("string")
    def masked(text: pd.Series, starts: pd.Series, stops: pd.Series) -> pd.Series:
        return pd.Series([cover(t, a, b) for t, a, b in zip(texts(text), starts, stops)])

    joined = some.select("uid", "row").join(judged, "uid").withColumn("live", live)
    text = F.when(F.size("live") > 0, masked(F.col("row.text"), F.col("live.start"), F.col("live.stop"))).otherwise(F.col("row.text"))
    joined = joined.withColumn("masked", text)
    columns = []
    for c in names:
        value = F.col("row")[c]
        if c == "text":
            value = F.col("masked")
        elif c == "n_chars":
            value = F.when(F.size("live") > 0, F.length("masked").cast(docs.schema[c].dataType)).otherwise(value)
        columns.append(value.alias(c))
    return clean.unionByName(joined.select(*columns))


def cover(text: str, starts: list[int], stops: list[int]) -> str:
    """Text with the union of the spans replaced, one mark for each connected stretch."""
    out, at = [], 0
    for a, b in sorted(zip(starts, stops)):
        if b <= at:
            continue
        if a > at or not out:
            out += [text[at:a], MASK]
        at = b
    return "".join(out) + text[at:]
