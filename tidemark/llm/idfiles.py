"""Token ids in binary files, each document compressed on its own with one shared dictionary.

A folder holds ``dictionary-<sha256>.bin`` (a zstandard dictionary trained on serialized id arrays) and shards
``shard-<number>.ids`` in ascending order of doc_id. A shard, all numbers little-endian:

    magic (8 bytes), sha256 of the dictionary (32), bytes per id (8)
    one zstandard frame per document: its ids as unsigned integers
    index: doc_id (8 each), id is null (1 each), frame offset (8 each, and one for the end), ids (8 each)
    documents (8), offset of the index (8), crc32 of the index (8), magic (8)

One document is read with the index and its frame only. Shards are written under a task's own name and
moved into place, so a task that runs again leaves the same file.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import ROWS_PER_BATCH, buckets_for
from tidemark.llm.packing import END_ID, ID_BYTES, _encoder, _packed
from tidemark.session import scratch_path

MAGIC = b"TMIDS\x00\x01\n"
HEADER = len(MAGIC) + 32 + 8
TAIL = "<qqq8s"
TAIL_BYTES = struct.calcsize(TAIL)
# Text bytes of a shard; a row counts ROW_BYTES besides its text, which bounds a shard's index.
SHARD_BYTES = 32 << 20
ROW_BYTES = 64
LEVEL = 3
DICTIONARY_BYTES = 112_640
# The dictionary is trained on windows of at most SAMPLE_IDS ids from at most SAMPLES documents, 4 MB in all.
# It decides how small the files are, never what is read from them.
SAMPLES = 2_000
SAMPLE_IDS = 1_024


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI, and the path there."""
    return pafs.FileSystem.from_uri(path)


def put(path: str, data: bytes) -> None:
    """Write a small file as a whole."""
    fs, where = opened(path)
    fs.create_dir(where.rsplit("/", 1)[0], recursive=True)
    with fs.open_output_stream(where) as out:
        out.write(data)


def shard_name(number: int) -> str:
    return f"shard-{number:08d}.ids"


def _dictionary(data: bytes):
    import zstandard

    return zstandard.ZstdCompressionDict(data)


# -- dictionary ---------------------------------------------------------------------------------


def _sample_windows(tokenizer_file: str, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A window of each document's serialized ids, at a place that its hash decides."""
        encoder, end = _encoder(tokenizer_file), _packed([END_ID])
        for batch in batches:
            out = []
            for h, ids in zip(batch.column(0).to_pylist(), encoder.encode([t or "" for t in batch.column(1).to_pylist()])):
                ids = narrowed(ids + end, width)
                last = max(0, len(ids) // width - SAMPLE_IDS)
                at = h % (last + 1) * width
                out.append(ids[at : at + SAMPLE_IDS * width])
            yield pa.record_batch([pa.array(out, pa.binary())], ["window"])

    return run


def train_dictionary(docs: DataFrame, tokenizer_file: str, width: int) -> bytes:
    """A dictionary trained on the ``SAMPLES`` documents with the smallest hashes."""
    import zstandard

    keyed = docs.select(F.xxhash64("doc_id", "text").alias("h"), "text")
    lowest = keyed.select("h").orderBy("h").limit(SAMPLES).agg(F.max("h")).first()[0]
    if lowest is None:
        return bytes(8)
    chosen = keyed.where(F.col("h") <= lowest).mapInArrow(_sample_windows(tokenizer_file, width), "window binary")
    windows = [bytes(w) for w in chosen.limit(SAMPLES).toArrow()["window"].to_pylist()]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, windows).as_bytes()
    except zstandard.ZstdError:
        # Too few windows to train on: their own bytes are the dictionary.
        return b"".join(windows)[:DICTIONARY_BYTES].ljust(8, b"\0")


# -- writing ------------------------------------------------------------------------------------


def narrowed(ids: bytes, width: int) -> bytes:
    """32-bit ids in ``width`` bytes each."""
    return ids if width == ID_BYTES else np.frombuffer(ids, "<u4").astype(f"<u{width}").tobytes()


def _write_shard(folder: str, tokenizer_file: str, dictionary: bytes, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One shard of this task's documents; its number, documents and ids."""
        import zstandard

        number, encoder, end = TaskContext.get().partitionId(), _encoder(tokenizer_file), _packed([END_ID])
        pack = zstandard.ZstdCompressor(level=LEVEL, dict_data=_dictionary(dictionary), write_content_size=True)
        fs, where = opened(folder)
        own = f"{where}/.{shard_name(number)}.{uuid.uuid4().hex}"
        names: list[np.ndarray] = []
        nulls: list[np.ndarray] = []
        sizes, frames = [], []
        with fs.open_output_stream(own) as out:
            out.write(MAGIC + hashlib.sha256(dictionary).digest() + struct.pack("<q", width))
            for batch in batches:
                ids = batch.column(0)
                names.append(ids.fill_null(0).to_numpy(zero_copy_only=False))
                nulls.append(ids.is_null().to_numpy(zero_copy_only=False))
                for tokens in encoder.encode([t or "" for t in batch.column(1).to_pylist()]):
                    tokens = narrowed(tokens + end, width)
                    frame = pack.compress(tokens)
                    out.write(frame)
                    sizes.append(len(tokens) // width)
                    frames.append(len(frame))
            offsets = HEADER + np.concatenate(([0], np.cumsum(frames, dtype=np.int64)))
            none = np.zeros(0, np.int64)
            index = b"".join(
                (
                    np.concatenate([none, *names]).astype("<i8").tobytes(),
                    np.concatenate([none, *nulls]).astype(np.uint8).tobytes(),
                    offsets.astype("<i8").tobytes(),
                    np.array(sizes, "<i8").tobytes(),
                )
            )
            out.write(index + struct.pack(TAIL, len(sizes), int(offsets[-1]), zlib.crc32(index), MAGIC))
        fs.move(own, f"{where}/{shard_name(number)}")
        yield pa.record_batch(
            [pa.array([number], pa.int64()), pa.array([len(sizes)], pa.int64()), pa.array([sum(sizes)], pa.int64())], ["shard", "docs", "ids"]
        )

    return run


def write_ids(docs: DataFrame, tokenizer_file: str, folder: str, shard_bytes: int = SHARD_BYTES) -> list[tuple[int, int]]:
    """Write every document's ids and one end id into ``folder``; (documents, ids) of each shard in order.

    The folder must be reachable by all executors. Shards ascend by doc_id, null ids last, rows of one id by
    their texts. Null texts count as empty: the end id alone. An empty table writes the dictionary and one empty shard.
    """
    from tokenizers import Tokenizer

    width = 2 if max(Tokenizer.from_file(tokenizer_file).get_vocab().values()) < 1 << 16 else ID_BYTES
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    dictionary = train_dictionary(rows, tokenizer_file, width)
    put(f"{folder}/dictionary-{hashlib.sha256(dictionary).hexdigest()}.bin", dictionary)
    size = rows.agg(F.sum(F.octet_length("text") + F.lit(ROW_BYTES).cast("long"))).first()[0] or 0
    order = [F.col("doc_id").asc_nulls_last(), F.xxhash64("text"), F.col("text")]
    ranged = rows.repartitionByRange(buckets_for(size, shard_bytes), *order[:2]).sortWithinPartitions(*order)
    done = ranged.mapInArrow(_write_shard(folder, tokenizer_file, dictionary, width), "shard long, docs long, ids long")
    found = {r["shard"]: (r["docs"], r["ids"]) for r in done.collect()}
    return [found.get(i, (0, 0)) for i in range(max(found, default=-1) + 1)]


# -- reading ------------------------------------------------------------------------------------


@lru_cache(maxsize=4)
def _stored_dictionary(folder: str, digest: str) -> bytes:
    fs, where = opened(folder)
    with fs.open_input_file(f"{where}/dictionary-{digest}.bin") as f:
        data = f.read()
    if hashlib.sha256(data).hexdigest() != digest:
        raise ValueError(f"the dictionary {digest} does not have its hash")
    return data


class Shard:
    """One shard file: its index in memory, frames read on demand."""

    def __init__(self, folder: str, number: int):
        import zstandard

        fs, where = opened(folder)
        self.file = fs.open_input_file(f"{where}/{shard_name(number)}")
        head = self.file.read(HEADER)
        size = self.file.size()
        self.file.seek(size - TAIL_BYTES)
        n, at, crc, magic = struct.unpack(TAIL, self.file.read(TAIL_BYTES))
        if head[: len(MAGIC)] != MAGIC or magic != MAGIC:
            raise ValueError("not a token-id shard")
        self.file.seek(at)
        index = self.file.read(size - TAIL_BYTES - at)
        if zlib.crc32(index) != crc:
            raise ValueError("the index of a shard is damaged")
        self.width = struct.unpack("<q", head[-8:])[0]
        self.doc_ids = np.frombuffer(index, "<i8", n)
        self.nulls = np.frombuffer(index, np.uint8, n, 8 * n).astype(bool)
        self.offsets = np.frombuffer(index, "<i8", n + 1, 9 * n)
        self.sizes = np.frombuffer(index, "<i8", n, 17 * n + 8)
        self.unpack = zstandard.ZstdDecompressor(dict_data=_dictionary(_stored_dictionary(folder, head[len(MAGIC) : -8].hex())))

    def frames(self, first: int, last: int) -> list[np.ndarray]:
        """Ids of the documents at places first to last - 1 of the index; one read."""
        begin = int(self.offsets[first])
        self.file.seek(begin)
        data = self.file.read(int(self.offsets[last]) - begin)
        cuts = (self.offsets[first : last + 1] - begin).tolist()
        out = [np.frombuffer(self.unpack.decompress(data[a:b]), f"<u{self.width}") for a, b in zip(cuts, cuts[1:])]
        if [len(ids) for ids in out] != self.sizes[first:last].tolist():
            raise ValueError("a frame does not hold as many ids as its index says")
        return out

    def document(self, doc_id: int) -> list[np.ndarray]:
        """Ids of every row of one document; reads their frames only."""
        named = len(self.doc_ids) - int(self.nulls.sum())
        first, last = (int(np.searchsorted(self.doc_ids[:named], doc_id, side)) for side in ("left", "right"))
        return self.frames(first, last) if last > first else []

    def close(self) -> None:
        self.file.close()


def _read_shards(folder: str, starts):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number in batch.column(0).to_pylist():
                shard, start = Shard(folder, number), int(starts.value[number])
                for first in range(0, len(shard.sizes), ROWS_PER_BATCH):
                    last = min(first + ROWS_PER_BATCH, len(shard.sizes))
                    sizes = shard.sizes[first:last]
                    begins = start + np.concatenate(([0], np.cumsum(sizes)[:-1]))
                    start += int(sizes.sum())
                    crcs = [zlib.crc32(ids.astype("<u4").tobytes()) for ids in shard.frames(first, last)]
                    names = pa.array(shard.doc_ids[first:last], mask=shard.nulls[first:last])
                    yield pa.record_batch([names, pa.array(begins), pa.array(sizes), pa.array(crcs, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])
                shard.close()

    return run


def read_digests(spark: SparkSession, folder: str, shards: list[tuple[int, int]]) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files; a task per shard.

    ``shards`` is what ``write_ids`` returned; start counts the ids of all documents before.
    """
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    sizes = np.array([ids for _, ids in shards], np.int64)
    starts = spark.sparkContext.broadcast(np.concatenate(([0], np.cumsum(sizes))))
    return spark.range(0, len(shards), 1, max(1, len(shards))).mapInArrow(_read_shards(folder, starts), schema)


def token_files(docs: DataFrame, tokenizer_file: str) -> DataFrame:
    """Write the ids of all documents below the shared folder and read them back: one row per document.

    doc_id, start (ids of all documents before it in ascending doc_id), n_tokens (with the end id) and
    ids_crc32 over the ids as little-endian 32-bit integers. Null and empty texts have the end id only; null ids
    come last; repeated rows and ids keep a row each, rows of one id in a fixed order of their texts. An empty
    table gives no row. Other columns are not read.
    """
    folder = scratch_path(docs.sparkSession, "token-ids")
    return read_digests(docs.sparkSession, folder, write_ids(docs, tokenizer_file, folder))
