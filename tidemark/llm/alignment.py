"""Alignment of two tokenizations of the same bytes.

After both tokenizers have run over a whole document, places where a space-marked token begins in both
streams at the same byte (so that both end there: verified on the byte offsets) cut it into windows of token ids.
A window's alignment depends on its ids alone, so it is computed once per pair of id tuples and remembered.
Inside a window, places where tokens of both end together close a group; overlapping tokens are links.

How many documents hold a linked id pair is counted over the whole corpus. The most frequent pairs are broadcast
(``HEAD_PAIRS``, 13 bytes each); pairs beyond them, none of which is frequent, are joined by a shuffle.
"""

from __future__ import annotations

import hashlib
import os
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import stored

HEAD_PAIRS = 1 << 20
REMEMBERED = 400_000
UNITS_AT_ONCE = 2_000
REMEMBERED_LINKS = 4_000_000
MARK = "▁"
# A blank or line feed between characters that are no white space: both tokenizers start anew there. The byte-level one
# splits texts by a pattern in which no match goes on from such a character to white space, and a blank or
# line feed before such a character begins a match; the other has no piece across these places (``Pieces`` proves it).
_UNIT = re.compile(r"(?<=\S)(?=[ \n]\S)")
_PLAIN = re.compile(r"[ \n]\S+")

ALIGNED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<int>, times array<int>"


class ByteLevel:
    """The byte-level tokenizer: ids of units of text, bytes of its tokens."""

    def __init__(self, tokenizer_file: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(tokenizer_file)
        self.library.encode_special_tokens = True
        self.library.no_truncation()
        self.library.no_padding()
        vocabulary = self.library.get_vocab()
        byte_of = _byte_letters()
        self.token = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            # A special token is written plainly; it never occurs in a text's ids.
            self.token[i] = bytes(byte_of[c] for c in token) if all(c in byte_of for c in token) else token.encode()
        self.size = np.array([len(t) for t in self.token], np.int64)

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)] if texts else []


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies: printable ones themselves, others from U+0100."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(0x100 + n): b for n, b in enumerate(others)}


class Pieces:
    """The piece tokenizer, which puts one blank before a text."""

    def __init__(self, model_file: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self.token = []
        for i in range(self.library.get_piece_size()):
            piece = self.library.id_to_piece(i)
            if self.library.is_byte(i):
                self.token.append(bytes([int(piece[3:5], 16)]))
                continue
            self.token.append(piece.replace(MARK, " ").encode())
            plain = not (self.library.is_control(i) or self.library.is_unknown(i))
            if plain and (MARK in piece.lstrip(MARK) or "\n" in piece):
                raise ValueError("a piece crosses the borders of units; texts of this model cannot be split")
        self.size = np.array([len(t) for t in self.token], np.int64)
        if self.library.encode("") or len(self.library.encode("\n")) != 2:
            raise ValueError("the model does not put one mark before a text")

    def encode(self, texts: list[str]) -> list[list[int]]:
        """Ids of texts that begin with a blank or a line feed."""
        ids = self.library.encode([t[1:] if t[0] == " " else t for t in texts], num_threads=1) if texts else []
        # A text that begins with a line feed got a mark that it does not have.
        return [x if t[0] == " " else x[1:] for t, x in zip(texts, ids)]


class Side:
    """Ids of all known units of one tokenizer, end to end."""

    def __init__(self, tokenizer):
        self.tokenizer = tokenizer
        self.ids, self.first = array("H"), array("q", [0])

    def add(self, ids: np.ndarray, ends: np.ndarray) -> None:
        """Ids of more units; ``ends`` says where each unit's end in them."""
        self.first.frombytes((len(self.ids) + ends).astype(np.int64).tobytes())
        self.ids.frombytes(ids.tobytes())

    def cut(self, joined: str, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of joined units and where each unit's end, none where tokens are not the text or cross the bytes' ``ends``."""
        ids = self.tokenizer.encode([joined])[0]
        if b"".join(map(self.tokenizer.token.__getitem__, ids)) != joined.encode():
            return None
        ids = np.array(ids, np.uint16)
        at = np.cumsum(self.tokenizer.size[ids])
        last = np.searchsorted(at, ends)
        return (ids, last + 1) if np.array_equal(at[last], ends) else None

    def of(self, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of these units end to end, and how many each has."""
        first = np.frombuffer(self.first, np.int64)
        length = first[units + 1] - first[units]
        return np.frombuffer(self.ids, np.uint16)[_runs(first[units], length)], length

    def bytes_of(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.tokenizer.token.__getitem__, ids.tolist()))


def _runs(first: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The numbers first, first + 1, ... of each run, end to end."""
    return np.arange(int(length.sum())) + np.repeat(first - np.cumsum(length) + length, length)


class Units:
    """Ids of both tokenizers for units of text; every unit is encoded once while it is remembered."""

    def __init__(self, a: ByteLevel, b: Pieces):
        self.a, self.b = Side(a), Side(b)
        self.at: dict[str, int] = {}
        # Bytes of each unit, or -1 where its tokens are not its text on both sides.
        self.size = array("q")
        # Where the alignment of a window of exactly this unit is kept, or -1.
        self.window = array("q")

    def split(self, text: str) -> list[str]:
        words = text.split()
        if " ".join(words) == text:
            return [" " + w for w in words]
        return _UNIT.split(" " + text)

    def places(self, units: list[str]) -> np.ndarray:
        new = [u for u in dict.fromkeys(units) if u not in self.at]
        if new:
            self._learn(new)
        return np.fromiter(map(self.at.__getitem__, units), np.int64, len(units))

    def _learn(self, new: list[str]) -> None:
        """Ids of new units. Units without inner white space go to the libraries joined, many at a time, and their ids
        are told apart by their bytes; where the bytes do not fit, and for other units, each goes on its own."""
        plain, rest = [], []
        for unit in new:
            (plain if _PLAIN.fullmatch(unit) else rest).append(unit)
        for begin in range(0, len(plain), UNITS_AT_ONCE):
            units = plain[begin : begin + UNITS_AT_ONCE]
            sizes = [len(u.encode()) for u in units]
            cut = [side.cut("".join(units), np.cumsum(sizes)) for side in (self.a, self.b)]
            if None in cut:
                rest += units
            else:
                self._add(units, cut, sizes)
        for unit, *ids in zip(rest, self.a.tokenizer.encode(rest), self.b.tokenizer.encode(rest)):
            ids = [np.array(x, np.uint16) for x in ids]
            same = all(side.bytes_of(x) == unit.encode() for side, x in zip((self.a, self.b), ids))
            self._add([unit], [(x, np.array([len(x)])) for x in ids], [len(unit.encode()) if same else -1])

    def _add(self, units: list[str], cut: list[tuple[np.ndarray, np.ndarray]], sizes: list[int]) -> None:
        self.at.update(zip(units, range(len(self.at), len(self.at) + len(units))))
        for side, (ids, ends) in zip((self.a, self.b), cut):
            side.add(ids, ends)
        self.size.extend(sizes)
        self.window.extend([-1] * len(units))


# What follows an id in a text of groups: another of its group, the other side, the next group, nothing.
_AFTER = (",", "|", ";", "")


@lru_cache(maxsize=1)
def _written_ids() -> list[str]:
    """The text of id i before ``_AFTER[k]`` at 4 * i + k."""
    return [f"{i}{after}" for i in range(1 << 16) for after in _AFTER]


class Windows:
    """Alignments of windows by their id tuples: groups, links, the groups' text."""

    def __init__(self, size_a: np.ndarray, size_b: np.ndarray):
        self.size_a, self.size_b, self.base = size_a, size_b, len(size_b)
        self.at: dict[tuple[bytes, bytes], int] = {}
        self.groups, self.texts = array("q"), []
        self.links, self.first = array("i"), array("q", [0])

    def full(self) -> bool:
        return len(self.at) > REMEMBERED or len(self.links) > REMEMBERED_LINKS

    def places(self, keys: list[tuple[bytes, bytes]]) -> np.ndarray:
        """Where the alignments of these windows are kept; new ones are computed."""
        found = list(map(self.at.get, keys))
        if None in found:
            new = list(dict.fromkeys([k for k, at in zip(keys, found) if at is None]))
            self.at.update(zip(new, range(len(self.texts), len(self.texts) + len(new))))
            self._align([a for a, _ in new], [b for _, b in new])
            found = [self.at[k] if at is None else at for k, at in zip(keys, found)]
        return np.array(found, np.int64)

    def _align(self, a: list[bytes], b: list[bytes]) -> None:
        """Align new windows, laid end to end; a window has the same bytes on both sides."""
        ids_a, ids_b = np.frombuffer(b"".join(a), "<u2"), np.frombuffer(b"".join(b), "<u2")
        ends_a, ends_b = np.cumsum(self.size_a[ids_a]), np.cumsum(self.size_b[ids_b])
        last = ends_a[np.cumsum([len(x) // 2 for x in a]) - 1]
        # Between two neighbouring ends of either side, one token of each side overlap.
        steps, shared = _merged(ends_a, ends_b)
        pairs = ids_a[np.searchsorted(ends_a, steps)].astype(np.int32) * np.int32(self.base) + ids_b[np.searchsorted(ends_b, steps)]
        before = len(self.links)
        self.links.frombytes(pairs.astype(np.int32).tobytes())
        self.first.frombytes((before + np.searchsorted(steps, last, "right")).astype(np.int64).tobytes())
        self.groups.frombytes(np.diff(np.searchsorted(shared, last, "right"), prepend=0).astype(np.int64).tobytes())
        # Ids in the order of the text: group by group, one side after the other.
        written, sides = [], []
        for side, (ids, ends) in enumerate(((ids_a, ends_a), (ids_b, ends_b))):
            group = np.searchsorted(shared, ends)
            closes = shared[group] == ends
            after = np.where(closes, 1 + side, 0)
            if side:
                after[np.searchsorted(ends, last)] = 3
            written.append(4 * ids.astype(np.int64) + after)
            sides.append(2 * group + side)
        order = np.argsort(np.concatenate(sides), kind="stable")
        names = list(map(_written_ids().__getitem__, np.concatenate(written)[order].tolist()))
        cuts = np.cumsum([(len(x) + len(y)) // 2 for x, y in zip(a, b)]).tolist()
        self.texts += ["".join(names[i:j]) for i, j in zip([0, *cuts], cuts)]


def _merged(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values of two rising arrays, and those that both have."""
    both = np.sort(np.concatenate((x, y)), kind="stable")
    again = np.zeros(len(both), bool)
    again[1:] = both[1:] == both[:-1]
    return both[~again], both[again]


class Aligner:
    """Alignments of batches of texts."""

    def __init__(self, byte_file: str, piece_file: str):
        self.tokenizers = ByteLevel(byte_file), Pieces(piece_file)
        if max(len(t.token) for t in self.tokenizers) > 1 << 16:
            raise ValueError("ids need more than 16 bits")
        self.spaced = [np.array([x[:1] == b" " for x in t.token]) for t in self.tokenizers]
        self._forget()

    def _forget(self) -> None:
        self.units = Units(*self.tokenizers)
        self.windows = Windows(*(t.size for t in self.tokenizers))

    def batch(self, doc_ids: pa.Array, texts: list[str]) -> pa.RecordBatch:
        if len(self.units.at) > REMEMBERED or self.windows.full():
            self._forget()
        split = [self.units.split(t) if t else [] for t in texts]
        count = np.fromiter(map(len, split), np.int64, len(split))
        units = self.units.places(list(chain.from_iterable(split)))
        row = np.repeat(np.arange(len(texts)), count)
        size = np.frombuffer(self.units.size, np.int64)[units]
        for i in np.unique(row[size < 0]).tolist():
            # Some unit is not what its tokens join to, so the text is not either, but for odd luck: compare the whole.
            mine = units[row == i]
            if any(side.bytes_of(side.of(mine)[0]) != (" " + texts[i]).encode() for side in (self.units.a, self.units.b)):
                count[i] = 0
        kept = count[row] > 0
        return self._aligned(doc_ids, units[kept], row[kept])

    def _aligned(self, doc_ids: pa.Array, units: np.ndarray, row: np.ndarray) -> pa.RecordBatch:
        """The result of texts as their units end to end; ``row`` says which text each unit is of."""
        rows = len(doc_ids)
        (ids_a, len_a), (ids_b, len_b) = self.units.a.of(units), self.units.b.of(units)
        n_a, n_b = (np.bincount(row, n, rows).astype(np.int64) for n in (len_a, len_b))
        place, of_row = self._windows(units, row, ids_a, len_a, ids_b, len_b)
        groups = np.frombuffer(self.windows.groups, np.int64)[place]
        first = np.frombuffer(self.windows.first, np.int64)
        length = first[place + 1] - first[place]
        n_groups, n_links = (np.bincount(of_row, n, rows).astype(np.int64) for n in (groups, length))
        cuts = np.searchsorted(of_row, np.arange(rows + 1)).tolist()
        written = list(map(self.windows.texts.__getitem__, place.tolist()))
        digests = [hashlib.sha256(";".join(written[i:j]).encode()).hexdigest() if j > i else "" for i, j in zip(cuts, cuts[1:])]
        # All links of the batch, each with its text; equal ones of a text are counted.
        links = np.frombuffer(self.windows.links, np.int32)[_runs(first[place], length)]
        keyed = np.sort(np.repeat(of_row, length) << 32 | links)
        begins = np.flatnonzero(np.diff(keyed, prepend=-1))
        times = np.diff(begins, append=len(keyed)).astype(np.int32)
        ends = np.searchsorted(keyed[begins] >> 32, np.arange(rows + 1)).astype(np.int32)
        pairs = (keyed[begins] & 0xFFFFFFFF).astype(np.int32)
        lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x)) for x in (pairs, times)]
        numbers = [pa.array(x) for x in (n_a, n_b, n_groups, n_links)]
        return pa.record_batch([doc_ids, *numbers, pa.array(digests, pa.string()), *lists], [c.split()[0] for c in ALIGNED.split(", ")])

    def _windows(self, units, row, ids_a, len_a, ids_b, len_b) -> tuple[np.ndarray, np.ndarray]:
        """The windows of the texts: where their alignments are, and which text each is in."""
        if not len(units):
            return units, units
        begins, marked = [], []
        for ids, tokenizer, spaced in zip((ids_a, ids_b), self.tokenizers, self.spaced):
            size = tokenizer.size[ids]
            begins.append(np.cumsum(size) - size)
            marked.append(begins[-1][spaced[ids]])
        # Both streams have the same bytes per text, so offsets agree over the batch. Anchors are offsets at which a
        # space-marked token begins in both; a text always begins a window.
        begun = begins[0][np.cumsum(len_a) - len_a]
        heads = begun[np.flatnonzero(np.diff(row, prepend=-1))]
        cuts = _merged(_merged(*marked)[1], heads)[0]
        # A window of exactly one unit is looked up by the unit; a window's alignment follows from its ids.
        unit = np.searchsorted(begun, cuts)
        unit[unit == len(begun)] = 0
        after = np.append(begun[1:], -1)
        alone = (begun[unit] == cuts) & (after[unit] == np.append(cuts[1:], -1))
        window = np.frombuffer(self.units.window, np.int64)
        place = np.where(alone, window[units[unit]], -1)
        open_ = np.flatnonzero(place < 0)
        at_a, at_b = (2 * np.append(np.searchsorted(x, cuts), len(x)) for x in begins)
        a, b = ids_a.tobytes(), ids_b.tobytes()
        keys = [(a[i:k], b[j:m]) for i, k, j, m in zip(*(x[open_ + o].tolist() for x in (at_a, at_b) for o in (0, 1)))]
        place[open_] = self.windows.places(keys)
        learned = open_[alone[open_]]
        window[units[unit[learned]]] = place[learned]
        return place, row[np.searchsorted(begun, cuts, "right") - 1]


@lru_cache(maxsize=1)
def _aligner(byte_file: str, piece_file: str) -> Aligner:
    return Aligner(byte_file, piece_file)


def _align_batches(byte_file: str, piece_file: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(byte_file, piece_file)
        for batch in batches:
            yield aligner.batch(batch.column(0), [t or "" for t in batch.column(1).to_pylist()])

    return run


def align_documents(docs: DataFrame, byte_file: str, piece_file: str) -> DataFrame:
    """One row per document with the distinct linked id pairs and how often each is linked.

    A pair is the byte-level id times the number of pieces, plus the piece's id.
    """
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(_align_batches(byte_file, piece_file), ALIGNED)


def pair_counts(aligned: DataFrame, base: int) -> DataFrame:
    """pair, n (documents that hold it linked), best (n is the highest of its byte-level id)."""
    counts = stored(aligned.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("n")), "pair-counts")
    owner = F.floor(F.col("pair") / base).alias("owner")
    highest = counts.groupBy(owner).agg(F.max("n").alias("highest"))
    return counts.withColumn("owner", owner).join(highest, "owner").select("pair", "n", (F.col("n") == F.col("highest")).alias("best"))


SUMS = "n_best long, count_sum long, rare array<struct<pair: int, times: int>>"
KEPT = "uid long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"


def _sum_head(head: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sums over the pairs in the head; the other pairs as a list."""
        pair, count, best = head.value
        for batch in batches:
            lists = batch.column("pairs")
            ends = lists.offsets.to_numpy() - lists.offsets[0].as_py()
            mine = lists.flatten().to_numpy()
            times = batch.column("times").flatten().to_numpy().astype(np.int64)
            row = np.repeat(np.arange(len(lists)), np.diff(ends))
            at = np.minimum(np.searchsorted(pair, mine), max(len(pair) - 1, 0))
            held = pair[at] == mine if len(pair) else np.zeros(len(mine), bool)
            known, at = np.flatnonzero(held), at[held]
            sums = []
            for value in (times[known] * best[at], times[known] * count[at]):
                total = np.zeros(len(lists), np.int64)
                np.add.at(total, row[known], value)
                sums.append(pa.array(total))
            rest = np.flatnonzero(~held)
            cuts = np.searchsorted(row[rest], np.arange(len(lists) + 1)).astype(np.int32)
            members = pa.StructArray.from_arrays([pa.array(mine[rest]), pa.array(times[rest].astype(np.int32))], ["pair", "times"])
            rare = pa.ListArray.from_arrays(pa.array(cuts), members)
            names = [c.split()[0] for c in KEPT.split(", ")]
            yield pa.record_batch([*(batch.column(c) for c in names), *sums, rare], [*names, "n_best", "count_sum", "rare"])

    return run


def cross_align(docs: DataFrame, byte_file: str, piece_file: str, head_pairs: int = HEAD_PAIRS) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 for every row.

    Texts that are null, empty, or not what their token bytes join to, have no tokens: zeros and an empty
    digest. Every row counts as a document of its own, repeated rows and rows without id too. Null ids stay null. An
    empty table gives no rows. Other columns are not read. ``head_pairs`` bounds the broadcast and
    changes no result.
    """
    base = Pieces(piece_file).library.get_piece_size()
    aligned = stored(align_documents(docs, byte_file, piece_file).withColumn("uid", F.monotonically_increasing_id()), "aligned")
    counts = stored(pair_counts(aligned, base), "pairs")
    top = counts.orderBy(F.col("n").desc(), "pair").limit(head_pairs).toArrow()
    order = np.argsort(top["pair"].to_numpy())
    columns = [top[c].to_numpy()[order] for c in ("pair", "n", "best")]
    head = docs.sparkSession.sparkContext.broadcast((columns[0], columns[1], columns[2].astype(bool)))
    kept = [c.split()[0] for c in KEPT.split(", ")]
    summed = stored(aligned.mapInArrow(_sum_head(head), f"{KEPT}, {SUMS}"), "sums")
    rare = summed.select("uid", F.explode("rare").alias("r")).select("uid", "r.pair", "r.times").join(counts, "pair")
    more = rare.groupBy("uid").agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"), F.sum(F.col("times") * F.col("n")).alias("more_count")
    )
    rows = summed.select(*kept, "n_best", "count_sum").join(more, "uid", "left")
    added = [(F.col(c) + F.coalesce(m, F.lit(0))).cast("long").alias(c) for c, m in (("n_best", "more_best"), ("count_sum", "more_count"))]
    return rows.select("doc_id", "n_a", "n_b", "n_groups", "n_links", *added, "groups_sha256")
