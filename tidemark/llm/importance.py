"""Importance resampling towards a target distribution over hashed word n-grams.

A feature's bucket is the crc32 of its bytes modulo ``BUCKETS``. The crc32 of "a b c" follows from the
states of its words: appending n bytes to a checksum is a linear map of its 32 bits. So every word needs one
state. The states of the ``HEAD_WORDS`` most frequent words (counted exactly over all documents) are
broadcast, and with them state and bucket of the ``HEAD_PAIRS`` most frequent pairs of the first ``PAIR_WORDS``
words; both are bounded. Words outside the head take their crc32 directly when a batch meets them. Both routes
give the same checksums, so bucket totals and weights are exact whatever the head holds.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import buckets_for, stored

BUCKETS = 10_000
HEAD_WORDS = 50_000
PAIR_WORDS = 256
HEAD_PAIRS = 16_384
# A longer word is no head word, which bounds the broadcast; it takes the direct route.
HEAD_BYTES = 64
TAIL_REMEMBERED = 100_000
COUNTED_AT_ONCE = 200_000
MIN_WORDS = 20
PERCENT = 5
SEED = 42
ROWS_PER_RANGE = 200_000

# Words are runs of ASCII letters and digits and of all bytes above ASCII; A-Z becomes a-z.
_PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    """The words of one text; none for null."""
    return text.encode().translate(_PLAIN).split() if text else []


# -- checksums ----------------------------------------------------------------------------------

_BYTE = np.array([zlib.crc32(bytes([b])) for b in range(256)], np.uint32)
# crc32 of one byte b is step[b ^ 255] with both inversions; undone here, this is the plain step table.
_STEP = ~_BYTE[np.arange(256) ^ 255] ^ np.uint32(0x00FFFFFF)


def append_blank(crc: np.ndarray) -> np.ndarray:
    """Checksums after one more blank."""
    inner = ~crc
    return ~(_STEP[(inner ^ np.uint32(32)) & np.uint32(255)] ^ inner >> np.uint32(8))


@lru_cache(maxsize=4096)
def shift_table(n: int) -> np.ndarray:
    """What n more bytes make of each byte of a checksum, 4 x 256 values, flat."""
    zeros = bytes(n)
    base = zlib.crc32(zeros)
    bits = [zlib.crc32(zeros, 1 << i) ^ base for i in range(32)]
    table = np.zeros((4, 256), np.uint32)
    for place in range(4):
        for bit in range(8):
            table[place, np.arange(256) >> bit & 1 == 1] ^= np.uint32(bits[8 * place + bit])
    return table.reshape(-1)


def append_words(crc: np.ndarray, slot: np.ndarray, word_crc: np.ndarray, tables: np.ndarray) -> np.ndarray:
    """Checksums after words with these checksums; ``slot`` says which table has a word's length."""
    at = slot * 1024
    out = word_crc.copy()
    for place in range(4):
        out ^= tables[at + (256 * place) + (crc >> np.uint32(8 * place) & np.uint32(255))]
    return out


class Head:
    """The broadcast vocabulary: words by falling frequency, and the frequent pairs of the first of them."""

    def __init__(self, words: list[bytes], pairs: np.ndarray):
        self.words = words
        self.crc = np.array([zlib.crc32(w) for w in words], np.uint32)
        # State and bucket of pair i * PAIR_WORDS + j; bucket -1 where the pair is not a frequent one.
        self.pair_crc = np.zeros(PAIR_WORDS**2, np.uint32)
        self.pair_bucket = np.full(PAIR_WORDS**2, -1, np.int32)
        for code in pairs.tolist():
            crc = zlib.crc32(words[code // PAIR_WORDS] + b" " + words[code % PAIR_WORDS])
            self.pair_crc[code], self.pair_bucket[code] = crc, crc % BUCKETS


class States(dict):
    """Word to its place in ``crc`` and ``size``; words outside the head get one when first met."""

    def __init__(self, head: Head):
        super().__init__(zip(head.words, range(len(head.words))))
        self.head = head
        self.crc = head.crc.tolist()
        self.size = [len(w) for w in head.words]

    def __missing__(self, word: bytes) -> int:
        at = self[word] = len(self.crc)
        self.crc.append(zlib.crc32(word))
        self.size.append(len(word))
        return at


class Features:
    """Buckets of all features of a batch of texts."""

    def __init__(self, head: Head):
        self.head, self.states = head, States(head)

    def of(self, batch: list[str | None]) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
        """Words per text, then for 1, 2 and 3 words the buckets and the texts they are in."""
        if len(self.states.crc) > len(self.head.words) + TAIL_REMEMBERED:
            self.states = States(self.head)
        words = [words_of(t) for t in batch]
        n = np.fromiter(map(len, words), np.int64, len(words))
        place = np.fromiter(map(self.states.__getitem__, chain.from_iterable(words)), np.int64, int(n.sum()))
        text = np.repeat(np.arange(len(words)), n)
        crc = np.array(self.states.crc, np.uint32)[place]
        lengths, slot = np.unique(np.array(self.states.size, np.int64)[place], return_inverse=True)
        tables = np.concatenate([shift_table(int(x)) for x in lengths]) if len(lengths) else np.zeros(0, np.uint32)
        one = crc % np.uint32(BUCKETS)
        second = np.flatnonzero(text[1:] == text[:-1]) + 1
        pair, two = self._pairs(place, crc, slot, tables, second)
        # A third word follows where the next place is a second word again.
        more = np.flatnonzero(second[1:] == second[:-1] + 1)
        third = second[more] + 1
        more = more[text[third] == text[third - 2]] if len(third) else more
        third = second[more] + 1
        three = append_words(append_blank(pair[more]), slot[third], crc[third], tables) % np.uint32(BUCKETS)
        return n, [one, two, three], [text, text[second], text[third]]

    def _pairs(self, place: np.ndarray, crc: np.ndarray, slot: np.ndarray, tables: np.ndarray, second: np.ndarray):
        """Checksums and buckets of the pairs that end at ``second``: looked up if frequent, else computed."""
        a, b = place[second - 1], place[second]
        code = np.where((a < PAIR_WORDS) & (b < PAIR_WORDS), a * PAIR_WORDS + b, 0)
        known = (a < PAIR_WORDS) & (b < PAIR_WORDS) & (self.head.pair_bucket[code] >= 0)
        pair, bucket = self.head.pair_crc[code], self.head.pair_bucket[code].astype(np.uint32)
        rest = np.flatnonzero(~known)
        at = second[rest]
        pair[rest] = append_words(append_blank(crc[at - 1]), slot[at], crc[at], tables)
        bucket[rest] = pair[rest] % np.uint32(BUCKETS)
        return pair, bucket


# -- corpus statistics --------------------------------------------------------------------------


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words and how often; counted here first, let go when there are many."""
    counts: Counter = Counter()

    def rows() -> pa.RecordBatch:
        kept = [(w, n) for w, n in counts.items() if len(w) <= HEAD_BYTES]
        return pa.record_batch([pa.array([w for w, _ in kept], pa.binary()), pa.array([n for _, n in kept], pa.int64())], ["word", "n"])

    for batch in batches:
        for text in batch.column(0).to_pylist():
            counts.update(words_of(text))
        if len(counts) > COUNTED_AT_ONCE:
            yield rows()
            counts.clear()
    yield rows()


def _count_pairs(words: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """How often each pair of the most frequent words occurs; one dense table per task."""
        known = {w: i for i, w in enumerate(words.value[:PAIR_WORDS])}
        totals = np.zeros(PAIR_WORDS**2, np.int64)
        for batch in batches:
            # A word that is none of them, and each border of a text, ends a run.
            found = [known.get(w, -1) for text in batch.column(0).to_pylist() for w in (*words_of(text), b"")]
            at = np.array(found, np.int64)
            both = np.flatnonzero((at[:-1] >= 0) & (at[1:] >= 0))
            totals += np.bincount(at[both] * PAIR_WORDS + at[both + 1], minlength=PAIR_WORDS**2)
        some = np.flatnonzero(totals)
        yield pa.record_batch([pa.array(some), pa.array(totals[some])], ["code", "n"])

    return run


def _count_buckets(head: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """How many features fall into each bucket; one dense table per task."""
        features, totals = Features(head.value), np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for buckets in features.of(batch.column(0).to_pylist())[1]:
                totals += np.bincount(buckets, minlength=BUCKETS)
        some = np.flatnonzero(totals)
        yield pa.record_batch([pa.array(some), pa.array(totals[some])], ["bucket", "n"])

    return run


def _weigh(head: Broadcast, gains: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Words, features and the sum of gains of each document."""
        features, gain = Features(head.value), gains.value.astype(np.float64)
        for batch in batches:
            n, buckets, texts = features.of(batch.column(1).to_pylist())
            # Sums of integers far below 2^53 are exact in doubles.
            weight = sum(np.bincount(t, gain[b], minlength=len(n)) for b, t in zip(buckets, texts))
            count = n + np.maximum(n - 1, 0) + np.maximum(n - 2, 0)
            yield pa.record_batch(
                [batch.column(0), pa.array(n), pa.array(count), pa.array(np.rint(weight).astype(np.int64))],
                ["doc_id", "n_words", "n_features", "weight"],
            )

    return run


def _text(table: DataFrame) -> DataFrame:
    return table.select(F.col("text").cast("string").alias("text"))


def vocabulary(docs: DataFrame) -> Broadcast:
    """The head of the words of all documents, and of the pairs of its first words."""
    spark = docs.sparkSession
    counts = _text(docs).mapInArrow(_count_words, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    words = counts.orderBy(F.col("n").desc(), "word").limit(HEAD_WORDS).toArrow()["word"].to_pylist()
    words = [bytes(w) for w in words]
    first = spark.sparkContext.broadcast(words[:PAIR_WORDS])
    pairs = _text(docs).mapInArrow(_count_pairs(first), "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))
    codes = pairs.orderBy(F.col("n").desc(), "code").limit(HEAD_PAIRS).toArrow()["code"].to_numpy()
    return spark.sparkContext.broadcast(Head(words, codes))


def bucket_totals(table: DataFrame, head: Broadcast) -> np.ndarray:
    """Number of features of all texts in each bucket."""
    rows = _text(table).mapInArrow(_count_buckets(head), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    totals = np.zeros(BUCKETS, np.int64)
    totals[rows["bucket"].to_numpy()] = rows["n"].to_numpy()
    return totals


def bucket_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * log ratio) of the smoothed shares of each bucket in target and source."""
    all_source, all_target = float(source.sum() + BUCKETS), float(target.sum() + BUCKETS)
    return np.array(
        [math.floor(1000 * math.log((t + 1.0) * all_source / ((s + 1.0) * all_target))) for s, t in zip(source.tolist(), target.tolist())],
        np.int64,
    )


# -- drawing ------------------------------------------------------------------------------------


def seeded_noise(doc_id: Column, seed: int = SEED) -> Column:
    """floor of 1000 times standard Gumbel noise, from sha256 of seed and id; a null id is an empty text."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def numbered(rows: DataFrame, order: list[Column], total: int) -> DataFrame:
    """``rows`` and a long ``place`` from 1 in the given order, sorted in ranges and never in one task."""
    parts = buckets_for(total, ROWS_PER_RANGE)
    ranged = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    ranged = stored(ranged.withColumn("at", F.monotonically_increasing_id()), "ranged")
    # The id numbers the rows of each range from 0 below bit 33; a range's first place follows from the counts.
    ranged = ranged.withColumn("part", F.shiftright("at", 33))
    counts = sorted((r["part"], r["n"]) for r in ranged.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect())
    starts, at = [], 1
    for part, n in counts:
        starts.append((part, at))
        at += n
    first = F.broadcast(rows.sparkSession.createDataFrame(starts, "part long, start long"))
    return ranged.join(first, "part").withColumn("place", F.col("start") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))).drop("at", "part", "start")


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score, rank for every document; rank is null where it is not drawn.

    ``target`` needs a ``text``. Null and empty texts have no words, no features, weight 0 and are not drawn.
    Repeated rows are drawn each on its own; rows of one id and score take neighbouring ranks. Null ids
    come after all others of their score. Empty tables give no rows, an empty target leaves the gains to
    the smoothing. Of N documents with at least ``min_words`` words, floor(percent * N / 100) are drawn. Other
    columns are not read.
    """
    spark = docs.sparkSession
    head = vocabulary(docs)
    gains = spark.sparkContext.broadcast(bucket_gains(bucket_totals(docs, head), bucket_totals(target, head)))
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    weighed = source.mapInArrow(_weigh(head, gains), "doc_id long, n_words long, n_features long, weight long")
    rows = stored(weighed.withColumn("score", F.col("weight") + seeded_noise(F.col("doc_id"), seed)), "weights")
    eligible = rows.where(F.col("n_words") >= min_words)
    total = eligible.count()
    drawn = percent * total // 100
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("n_features"), F.col("weight")]
    ranked = numbered(eligible, order, total).withColumn("rank", F.when(F.col("place") <= drawn, F.col("place")))
    columns = ["doc_id", "n_features", "weight", "score", "rank"]
    rest = rows.where(F.col("n_words") < min_words).withColumn("rank", F.lit(None).cast("long"))
    return ranked.select(*columns).unionByName(rest.select(*columns))
