"""Main text of web pages: block markup, and a suffix array per host for what markup leaves open.

A page is cut into blocks. Markup settles most of them: blocks in navigation, headers, footers,
sidebars, notices, adverts, forms and comments are boilerplate, blocks of an article (or of the
main element of a page without articles) are its text. Both stay as they are judged: removing repeated
passages from articles would take copies of articles from all pages that carry them.

Blocks that are nearly all links count as menus outside articles. What markup leaves open, blocks around
articles among it, is judged by repetition within their host. The token streams of a
shard of the host's pages (boilerplate blocks and open blocks) are concatenated, and a suffix array
sorted to ``RUN`` tokens finds every run of that length with the number of distinct pages it stands on.
The shards' numbers are added per host, so a run counts from ``LEAST_PAGES`` pages on, on hosts
of any size. An open block mostly covered by such runs is boilerplate. Unique runs stay.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import stored, texts

RUN = 6
LEAST_PAGES = 3
COVERED = 0.8
LINKED = 0.8
SHARD_PAGES = 1000
SHARD_CHARS = 4_000_000

# Fixed values of the markup language.
BLOCKS = frozenset(
    "p div section article main header footer nav aside h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table caption thead tbody tfoot tr td th "
    "blockquote pre figure figcaption hr form fieldset address details summary center hgroup dialog menu body html".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
OPAQUE = frozenset("script style noscript template textarea select svg iframe object canvas audio video head title option".split())
CHROME = frozenset("nav footer aside form dialog menu button".split())
ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog form menu menubar toolbar".split())

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>",
    re.DOTALL,
)
_ATTRIBUTE = re.compile(r"(class|id|role|hidden|aria-hidden|style|itemprop)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.IGNORECASE)
_NAMES = re.compile(
    r"(?:^|[-_])(?:ads?|advert\w*|adsense|adsby\w*|adslot|adbox|banner\w*|sponsor\w*|promo\w*|nav|navbar|navigation|menu\w*|sidebar\w*|"
    r"aside|footer|foot|masthead|siteheader|topbar|breadcrumbs?|cookie\w*|consent|gdpr|notices?|alerts?|popup|modal|overlay|newsletter|"
    r"subscri\w*|signup|login|share|shares|sharing|sharebar|social|socials|related\w*|recommend\w*|comments?|commentlist|disqus\w*|respond|"
    r"repl(?:y|ies)|pagination|pager|toolbar|copyright|legal|skip\w*)(?:$|[-_])|^(?:widget|widget-area|site-header|page-header)$"
)
_COMMENTS = re.compile(r"comment|disqus|respond|repl(?:y|ies)\b")
_STATE = re.compile(r"^(?:has|with|no|is|without)[-_]")

OPEN, MAIN, ARTICLE, BOILERPLATE = 0, 1, 2, 3


def _judge(tag: str, attributes: str, state: int) -> int:
    """State of the blocks inside an element, from its name, attributes and surroundings."""
    if state == BOILERPLATE:
        return state
    found: dict[str, str] = {}
    if attributes and not attributes.isspace():
        found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(attributes)}
    names = f"{found.get('class', '')} {found.get('id', '')}".lower().split()
    if tag == "article":
        return BOILERPLATE if any(_COMMENTS.search(n) for n in names) else ARTICLE
    if tag in CHROME or (tag == "header" and state == OPEN):
        return BOILERPLATE
    role = found.get("role", "").lower()
    if role in ROLES or found.get("aria-hidden", "").lower() == "true" or "hidden" in found:
        return BOILERPLATE
    if "style" in found and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", found["style"], re.IGNORECASE):
        return BOILERPLATE
    if tag not in ("body", "html", "main") and any(_NAMES.search(n) and not _STATE.match(n) for n in names):
        return BOILERPLATE
    if tag == "main" or role in ("main", "article") or "articlebody" in found.get("itemprop", "").lower():
        return max(state, ARTICLE if role == "article" or "itemprop" in found else MAIN)
    return state


def page_blocks(source: str) -> list[tuple[int, str]]:
    """(state, text) of each non-empty block in page order; white space inside a block is one space."""
    out: list[tuple[int, str]] = []
    stack: list[tuple[str, int]] = [("", OPEN)]
    parts: list[str] = []
    at, in_link, linked = 0, False, 0

    def flush() -> None:
        nonlocal linked
        raw = "".join(parts)
        text = " ".join(html.unescape(raw).split())
        if text:
            state = stack[-1][1]
            # Outside an article a block of links is a menu.
            out.append((BOILERPLATE if state == OPEN and linked >= LINKED * len(raw.strip()) else state, text))
        parts.clear()
        linked = 0

    while True:
        m = _TAG.search(source, at)
        if not m:
            break
        if m.start() > at:
            parts.append(source[at : m.start()])
            linked += (m.start() - at) * in_link
        at = m.end()
        name = m[2] or m[5]
        if not name:
            if m[0].startswith("<![CDATA["):
                parts.append(html.escape(m[0][9:].removesuffix("]]>")))
            continue
        tag, closing, attributes = name.lower(), (m[1] or m[4]) == "/", m[3] or m[6] or ""
        if tag == "a":
            in_link = not closing
        if closing:
            if tag in BLOCKS:
                flush()
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == tag:
                    del stack[i:]
                    break
                if stack[i][0] in ("article", "main", "body") and tag not in ("main", "body", "html"):
                    break
            continue
        if tag in OPAQUE:
            if tag == "head":
                flush()
                end = re.compile(r"</head\s*>|<body\b|<(?:article|main|nav|header|div|p|h1)\b", re.IGNORECASE).search(_without_raw(source), at)
                at = end.start() if end else at
            elif not attributes.rstrip().endswith("/"):
                end = re.compile(rf"</{re.escape(tag)}\s*>", re.IGNORECASE).search(source, at)
                at = end.end() if end else len(source)
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            else:
                parts.append(" " if tag == "br" else "")
            continue
        if tag in BLOCKS:
            flush()
        if tag == "main":
            # A main element is no part of chrome that was left open before it.
            stack[1:] = [e for e in stack[1:] if e[1] != BOILERPLATE]
        if not attributes.rstrip().endswith("/") or tag in BLOCKS:
            stack.append((tag, _judge(tag, attributes, stack[-1][1])))
    parts.append(source[at:])
    flush()
    return out


_RAW = re.compile(r"<(script|style|template|noscript)\b.*?</\1\s*>|<!--.*?-->", re.IGNORECASE | re.DOTALL)


def _without_raw(source: str) -> str:
    """The page with raw-text elements blanked at equal length, for finding the head's end."""
    return _RAW.sub(lambda m: " " * len(m[0]), source)


KEPT, JUDGED, DROPPED = 0, 1, 2


def decided(blocks: list[tuple[int, str]]) -> list[tuple[int, str]]:
    """(decision, text) of each block: what markup keeps, what it drops, what the host's runs must judge.

    Articles stay. On a page with articles the blocks around them (of its main element, or of the page
    if it has none) are judged, a headline or lead stands there as well as a list of teasers. Without
    articles the main element stays, and without one all open blocks are judged.
    """
    states = {s for s, _ in blocks if s != BOILERPLATE}
    best = max(states, default=OPEN)
    around = MAIN if MAIN in states else OPEN
    fate = {BOILERPLATE: DROPPED, ARTICLE: KEPT, OPEN: DROPPED, MAIN: DROPPED}
    fate[around] = KEPT if best == MAIN else JUDGED
    return [(fate[s], t) for s, t in blocks]


def settled(blocks: list[tuple[int, str]]) -> tuple[str | None, list[str], list[str]]:
    """What markup keeps (None if it only leaves blocks to judge), the blocks to judge, the dropped ones."""
    parts: tuple[list[str], list[str], list[str]] = ([], [], [])
    for decision, text in decided(blocks):
        parts[decision].append(text)
    kept, judged, dropped = parts
    return ("\n".join(kept) if kept or not judged else None), judged, dropped


def _ranked(streams: list[list[str]], run: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each token of the concatenated streams, the rank of the run that begins there; the distinct pages
    of each rank; each page's end.

    The suffixes are ranked by their first 1, 2, 4, ... tokens, the last step overlapping, until equal
    rank means ``run`` equal tokens. Page ends are unique tokens.
    """
    ids: dict[str, int] = {}
    flat = [ids.setdefault(t, len(ids)) for s in streams for t in [*s, None]]  # type: ignore[arg-type]
    lengths = np.array([len(s) + 1 for s in streams], np.int64)
    n = len(flat)
    rank = np.array(flat, np.int64)
    ends = np.cumsum(lengths) - 1
    rank[ends] = len(ids) + np.arange(len(streams))
    page = np.repeat(np.arange(len(streams)), lengths)
    length = 1
    while length < run and n:
        step = min(length, run - length)
        after = np.full(n, -1, np.int64)
        after[: n - step] = rank[step:]
        _, rank = np.unique(rank * (len(ids) + n + len(streams) + 2) + after + 1, return_inverse=True)
        length += step
    order = np.lexsort((page, rank))
    r, p = rank[order], page[order]
    new_page = np.concatenate(([True], (r[1:] != r[:-1]) | (p[1:] != p[:-1]))) if n else np.zeros(0, bool)
    pages = np.bincount(r, weights=new_page, minlength=1).astype(np.int64) if n else np.zeros(1, np.int64)
    return rank, pages, ends


def _covered(begins: np.ndarray, n: int, run: int) -> np.ndarray:
    """Which of ``n`` tokens lie in a run that begins at one of ``begins``."""
    marks = np.zeros(n + run + 1, np.int64)
    np.add.at(marks, begins, 1)
    np.add.at(marks, begins + run, -1)
    return np.cumsum(marks)[:n] > 0


def repeated_runs(streams: list[list[str]], run: int, least_pages: int) -> list[np.ndarray]:
    """For each page, which tokens lie in a run of ``run`` tokens found on ``least_pages`` distinct pages."""
    rank, pages, ends = _ranked(streams, run)
    covered = _covered(np.flatnonzero(pages[rank] >= least_pages), len(rank), run)
    return [covered[e - len(s) : e] for e, s in zip(ends, streams)]


def run_key(tokens: list[str]) -> int:
    """A run's name across shards."""
    return xxhash.xxh64_intdigest(" ".join(tokens)) - (1 << 63)


def run_pages(streams: list[list[str]], run: int) -> Iterator[tuple[int, int]]:
    """(name, distinct pages) of every run inside a page, once each, in no order that matters."""
    rank, pages, ends = _ranked(streams, run)
    flat = [t for s in streams for t in [*s, ""]]
    first = np.unique(rank, return_index=True)[1]
    inside = first + run <= ends[np.searchsorted(ends, first)] if len(first) else first.astype(bool)
    for at in first[inside]:
        yield run_key(flat[at : at + run]), int(pages[rank[at]])


def _shard_runs(key: tuple, table: pa.Table) -> pa.Table:
    """Runs of a shard with their pages; a host of one shard needs only those that repeat enough."""
    streams = [[w for b in blocks for w in b.split()] for blocks in table.column("others").to_pylist()]
    alone = key[0].as_py()["shards"] == 1
    found = [(k, n) for k, n in run_pages(streams, RUN) if n >= LEAST_PAGES or not alone]
    host = key[0].as_py()["host"]
    return pa.table(
        {
            "host": pa.array([host] * len(found), pa.string()),
            "run": pa.array([k for k, _ in found], pa.int64()),
            "pages": pa.array([n for _, n in found], pa.int64()),
        }
    )


def without_repeated(blocks: list[str], others: list[str], place: list[int], begins: list[int]) -> str:
    """The page's text without those judged blocks that repeated runs cover to ``COVERED`` or more.

    ``place`` gives each of ``others`` its position in ``blocks``, -1 if markup dropped it.
    """
    sizes = [len(b.split()) for b in others]
    covered = _covered(np.array(begins, np.int64), sum(sizes), RUN)
    gone, at = set(), 0
    for size, to in zip(sizes, place):
        if to >= 0 and covered[at : at + size].mean() >= COVERED:
            gone.add(to)
        at += size
    return "\n".join(b for i, b in enumerate(blocks) if i not in gone)


# ``blocks`` are the kept and judged blocks of a page, ``others`` the judged and dropped ones, both in page order.
PARSED = "blocks array<string>, others array<string>, place array<int>"


def _parsed(source: str) -> tuple[list[str], list[str], list[int]]:
    blocks: list[str] = []
    others: list[str] = []
    place: list[int] = []
    for decision, text in decided(page_blocks(source)):
        if decision != KEPT:
            others.append(text)
            place.append(len(blocks) if decision == JUDGED else -1)
        if decision != DROPPED:
            blocks.append(text)
    return blocks, others, place


def extract_pages(pages: DataFrame, shard_pages: int = SHARD_PAGES, shard_chars: int = SHARD_CHARS) -> DataFrame:
    """page_id, url, text, n_chars for every page.

    Null and empty html have the empty text. Null urls form one host. Repeated rows and ids keep a row each; an empty table gives an empty
    result. Other columns are not read. Very long pages are handled whole. Shards change no result: their runs are counted over the whole host.
    """

    @F.pandas_udf(PARSED)
    def parsed(column: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_parsed(t) for t in texts(column)], columns=["blocks", "others", "place"])

    @F.pandas_udf("array<long>")
    def run_keys(others: pd.Series) -> pd.Series:
        words = [[w for b in page for w in b.split()] for page in others]
        return pd.Series([[run_key(w[i : i + RUN]) for i in range(len(w) - RUN + 1)] for w in words])

    @F.pandas_udf("string")
    def judged(blocks: pd.Series, others: pd.Series, place: pd.Series, begins: pd.Series) -> pd.Series:
        return pd.Series([without_repeated(list(b), list(o), list(p), list(at)) for b, o, p, at in zip(blocks, others, place, begins)])

    host = F.lower(F.coalesce(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1), F.lit("")))
    cut = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), parsed("html").alias("p"))
    rows = stored(cut.select(F.monotonically_increasing_id().alias("uid"), "page_id", "url", host.alias("host"), "p.*"), "pages")
    size = F.aggregate("others", F.lit(0).cast("long"), lambda n, b: n + F.length(b))
    sizes = rows.groupBy("host").agg(F.count(F.lit(1)).alias("pages"), F.sum(size).alias("chars"))
    number = F.ceil(F.greatest(F.col("pages") / shard_pages, F.col("chars") / shard_chars)).cast("long")
    shards = sizes.select(F.col("host").alias("h"), number.alias("shards"))
    streams = rows.where(F.size("others") > 0).join(shards, F.col("host") == F.col("h"))
    # One column names the shard: rows that a join has dealt by host would else stay together.
    shard = F.struct("host", F.pmod(F.xxhash64("uid"), F.col("shards")).alias("number"), "shards").alias("shard")
    counted = streams.select("others", shard).groupBy("shard").applyInArrow(_shard_runs, "host string, run long, pages long")
    repeated = counted.groupBy("host", "run").agg(F.sum("pages").alias("pages")).where(F.col("pages") >= LEAST_PAGES).select("host", "run")

    free = F.exists("place", lambda p: p >= 0)
    begun = rows.where(free).select("uid", "host", F.posexplode(run_keys("others")).alias("at", "run"))
    begins = begun.join(repeated, ["host", "run"]).groupBy("uid").agg(F.collect_list("at").alias("begins"))
    none = F.expr("cast(array() as array<int>)")
    opened = rows.where(free).join(begins, "uid", "left").withColumn("begins", F.coalesce("begins", none))
    opened = opened.select("page_id", "url", judged("blocks", "others", "place", "begins").alias("text"))
    done = rows.where(~free).select("page_id", "url", F.array_join("blocks", "\n").alias("text"))
    return done.unionByName(opened).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
