"""Bounded-space packing of token sequences into windows.

Every partition keeps at most ``open_windows`` windows open. A document's tokens are cut into full
windows first; the remainder goes to the open window it fills best. When none can hold it, the
fullest window is emitted: as it is when it lacks at most ``slack`` tokens, otherwise topped up with
the beginning of the remainder. The windows still open at the end of a partition are merged in a
second step, a bounded number of partitions to a task, by the same rules; what is left there is
cut into sequences whose lengths are powers of two, which need no padding.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import stored

WINDOW = 2048
OPEN_WINDOWS = 32
SLACK = 8
PARTITIONS_PER_MERGE = 64
END_ID = 1
REMEMBERED = 200_000
WORDS_AT_ONCE = 512
_MARKS = re.compile(rb"(?<=[a-z0-9])([.,!?;:*%&#$|]+)(?=[\x20\x09-\x0D]|\Z)")
ID_BYTES = 4

PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
ROW = f"{PIECE}, part int, slot int, ids binary"
SCHEMA = pa.schema(
    [(c.split()[0], pa.int64()) for c in PIECE.split(", ")] + [("part", pa.int32()), ("slot", pa.int32()), ("ids", pa.binary())]
)


class WordEncoder:
    """Token ids of whole texts as little-endian 32-bit bytes.

    The tokenizer composes and lower-cases characters, drops white space and splits letters from
    other characters before it merges. So a text's ids are those of its words in order, where
    words may be cut at ASCII white space and before marks that follow a letter or digit and
    end a word. Words are encoded by the library once and remembered; new words of letters only
    go to it many at a time, one blank apart, and their ids are told apart by their word-end tokens.
    A text that may hold a special string is left to the library as a whole.
    """

    def __init__(self, tokenizer_file: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(tokenizer_file)
        self.library.no_truncation()
        self.library.no_padding()
        vocabulary = self.library.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.known: dict[bytes, bytes] = {}

    def encode(self, batch: list[str]) -> list[bytes]:
        """Ids of each text; the library sees each new word of the batch once."""
        special = [t for t in batch if "<|" in t]
        split = [() if "<|" in t else _MARKS.sub(rb" \1", t.encode().lower()).split() for t in batch]
        if len(self.known) > REMEMBERED:
            # Words of this batch stay; the frequent ones are among them.
            here = {w for words in split for w in words}
            self.known = {w: ids for w, ids in self.known.items() if w in here}
        known = self.known
        self.learn(list({w for words in split for w in words if w not in known}))
        whole = iter(self._each(special))
        return [next(whole) if "<|" in t else b"".join(map(known.__getitem__, w)) for t, w in zip(batch, split)]

    def learn(self, new: list[bytes]) -> None:
        """Ids of new words, in chunks that do not depend on how many there are."""
        decoded = [w.decode() for w in new]
        letters = [w for w in decoded if w.isalpha()]
        rest = [w for w in decoded if not w.isalpha()]
        chunks = [letters[i : i + WORDS_AT_ONCE] for i in range(0, len(letters), WORDS_AT_ONCE)]
        for words, packed in zip(chunks, self._each([" ".join(words) for words in chunks])):
            ids = np.frombuffer(packed, "<u4")
            cuts = ((np.flatnonzero(self.ends[ids]) + 1) * ID_BYTES).tolist()
            if len(cuts) == len(words):
                self.known.update((w.encode(), packed[a:b]) for w, a, b in zip(words, [0, *cuts], cuts))
            else:
                # A letter that composition or lower-casing splits; these words go one by one.
                rest += words
        self.known.update(zip((w.encode() for w in rest), self._each(rest)))

    def _each(self, texts: list[str]) -> list[bytes]:
        return [_packed(e.ids) for e in self.library.encode_batch_fast(texts, add_special_tokens=False)] if texts else []


def _packed(ids: list[int]) -> bytes:
    return np.asarray(ids, dtype="<u4").tobytes()


@lru_cache(maxsize=2)
def _encoder(tokenizer_file: str) -> WordEncoder:
    return WordEncoder(tokenizer_file)


class _Window:
    """A sequence being filled: pieces (doc_id, start, doc_tokens, ids) and its length in tokens."""

    __slots__ = ("pieces", "length")

    def __init__(self) -> None:
        self.pieces: list[tuple] = []
        self.length = 0

    def add(self, doc_id: int | None, start: int, doc_tokens: int, ids: bytes) -> None:
        self.pieces.append((doc_id, start, doc_tokens, ids))
        self.length += len(ids) // ID_BYTES


class Packer:
    """Best-fit packing with a fixed number of open windows."""

    def __init__(self, window: int, open_windows: int, slack: int):
        self.window, self.limit, self.slack = window, open_windows, slack
        self.open: list[_Window] = []

    def add(self, doc_id: int | None, start: int, doc_tokens: int, ids: bytes) -> Iterator[_Window]:
        """Place ids; yields the windows that this closes."""
        size = self.window * ID_BYTES
        while len(ids) >= size:
            full = _Window()
            full.add(doc_id, start, doc_tokens, ids[:size])
            yield full
            ids, start = ids[size:], start + self.window
        while ids:
            need = len(ids) // ID_BYTES
            fits = [w for w in self.open if w.length + need <= self.window]
            if fits:
                best = max(fits, key=lambda w: w.length)
            elif len(self.open) < self.limit:
                best = _Window()
                self.open.append(best)
            else:
                best = max(self.open, key=lambda w: w.length)
                gap = self.window - best.length
                if gap > self.slack:
                    best.add(doc_id, start, doc_tokens, ids[: gap * ID_BYTES])
                    ids, start = ids[gap * ID_BYTES :], start + gap
                self.open.remove(best)
                yield best
                continue
            best.add(doc_id, start, doc_tokens, ids)
            ids = b""
            if best.length == self.window:
                self.open.remove(best)
                yield best


def power_of_two_lengths(n: int) -> list[int]:
    """The powers of two that add up to n, largest first."""
    return [1 << b for b in range(n.bit_length() - 1, -1, -1) if n >> b & 1]


def _rows(sequence_id: int, window: _Window) -> list[tuple]:
    at, out = 0, []
    for doc_id, start, doc_tokens, ids in window.pieces:
        n = len(ids) // ID_BYTES
        out.append((doc_id, start, n, zlib.crc32(ids), doc_tokens, sequence_id, at, None, None, None))
        at += n
    return out


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[] for _ in schema]
    return pa.record_batch([pa.array(list(c), f.type) for c, f in zip(columns, schema)], schema=schema)


def _pack_partition(tokenizer_file: str, window: int, open_windows: int, slack: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, encoder, part = SCHEMA, _encoder(tokenizer_file), TaskContext.get().partitionId()
        packer, made, end = Packer(window, open_windows, slack), 0, _packed([END_ID])
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, ids in zip(batch.column(0).to_pylist(), encoder.encode([t or "" for t in batch.column(1).to_pylist()])):
                ids += end
                for closed in packer.add(doc_id, 0, len(ids) // ID_BYTES, ids):
                    rows += _rows((part << 32) + made, closed)
                    made += 1
            yield _batch(rows, schema)
        for slot, w in enumerate(packer.open):
            yield _batch([(d, s, len(ids) // ID_BYTES, None, n, None, None, part, slot, ids) for d, s, n, ids in w.pieces], schema)

    return run


def _merge(window: int, open_windows: int, slack: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        """Best fit over the leftover windows of a group of partitions, fullest first."""
        schema, group, made, rows = SCHEMA, key[0].as_py(), 0, []
        left: dict[tuple, list] = {}
        order = table.sort_by([("part", "ascending"), ("slot", "ascending")])
        for r in order.select(["part", "slot", "doc_id", "start", "doc_tokens", "ids"]).to_pylist():
            left.setdefault((r["part"], r["slot"]), []).append((r["doc_id"], r["start"], r["doc_tokens"], r["ids"]))
        packer = Packer(window, open_windows, slack)
        total = {k: sum(len(p[3]) for p in v) for k, v in left.items()}
        base = (1 << 61) + (group << 32)
        for k in sorted(left, key=lambda k: (-total[k], k)):
            for piece in left[k]:
                for closed in packer.add(*piece):
                    rows += _rows(base + made, closed)
                    made += 1
        # The rest, end to end: whole windows, then lengths that need no padding.
        rest = [p for w in sorted(packer.open, key=lambda w: -w.length) for p in w.pieces]
        lengths = power_of_two_lengths(sum(len(p[3]) for p in rest) // ID_BYTES)
        lengths = [n for big in lengths for n in ([window] * (big // window) if big > window else [big])]
        at = 0
        for n in lengths:
            w = _Window()
            while w.length < n:
                doc_id, start, doc_tokens, ids = rest[at]
                take = min(n - w.length, len(ids) // ID_BYTES)
                w.add(doc_id, start, doc_tokens, ids[: take * ID_BYTES])
                if take * ID_BYTES == len(ids):
                    at += 1
                else:
                    rest[at] = (doc_id, start + take, doc_tokens, ids[take * ID_BYTES :])
            rows += _rows(base + made, w)
            made += 1
        return pa.Table.from_batches([_batch(rows, schema)])

    return run


def pack_documents(
    docs: DataFrame,
    tokenizer_file: str,
    window: int = WINDOW,
    open_windows: int = OPEN_WINDOWS,
    slack: int = SLACK,
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document's tokens are its ids and one end id, so a null or empty text still has one piece of
    length 1. Null and repeated ids are packed row by row like any other. Pieces of one sequence
    lie gapless from offset 0. An empty table gives no piece. ``window`` is a power of two.
    """
    if window & (window - 1):
        raise ValueError("window must be a power of two")
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    packed = stored(source.mapInArrow(_pack_partition(tokenizer_file, window, open_windows, slack), ROW), "packed")
    columns = [c.split()[0] for c in PIECE.split(", ")]
    done = packed.filter(F.col("sequence_id").isNotNull()).select(*columns)
    left = packed.filter(F.col("sequence_id").isNull())
    merged = left.groupBy(F.floor(F.col("part") / PARTITIONS_PER_MERGE).alias("merge_group")).applyInArrow(_merge(window, open_windows, slack), ROW)
    return done.unionByName(merged.select(*columns))
