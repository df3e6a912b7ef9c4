"""SimHash near-duplicates found through segment popcounts.

A 64-bit fingerprint is cut into 16 segments of 4 bits; the 16 bit counts embed it in a grid.
Flipping one bit moves one count by one, so the Manhattan distance of two embeddings never exceeds
the Hamming distance of the fingerprints. The range join looks for embeddings within distance 2:
two such points always share a grid point within distance 1 of both, so every distinct fingerprint
is listed under its own grid point and that point's neighbours (33 at most), and only rows
of one grid point are compared, exactly, on the fingerprints.

A grid point with very many fingerprints (a large family of near copies) is not compared in
pairs. Its fingerprints are listed instead under themselves and their 64 one-bit neighbours: two
fingerprints within two bits share such a key, and a key has at most 65 fingerprints.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import stored, texts
from tidemark.llm.components import connected_components

SHINGLE = 3
SEED = 42
DENSE = 64
LOWEST = 0x1111111111111111  # the lowest bit of each segment
LINKS = "dense boolean, a long, b long"


def text_fingerprint(text: str) -> int:
    """Unsigned 64-bit SimHash of the word shingles of one text; 0 if it has no words."""
    import xxhash

    # Bytes methods touch ASCII only: lower() is A-Z, split() the six ASCII white-space characters.
    words = text.encode().lower().split()
    if not words:
        return 0
    joined, n = b" ".join(words), len(words)
    if n <= SHINGLE:
        hashes = [xxhash.xxh64_intdigest(joined, SEED)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[s:e], SEED) for s, e in zip(starts[: n - SHINGLE + 1].tolist(), ends[SHINGLE - 1 :].tolist())]
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 4096):
        part = np.array(hashes[i : i + 4096], dtype="<u8")
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(counts * 2 > len(hashes), bitorder="little")
    return int(bits.view("<u8")[0])


def fingerprint(text: Column) -> Column:
    """SimHash of each text as a long with the same 64 bits; null counts as empty."""

    @F.pandas_udf("long")
    def prints(column: pd.Series) -> pd.Series:
        return pd.Series(np.array([text_fingerprint(t) for t in texts(column)], dtype=np.uint64).view(np.int64))

    return prints(text)


def segment_counts(fp: Column) -> Column:
    """The 16 bit counts of the 4-bit segments, one per nibble of a long."""
    first, second, third, fourth = (F.shiftrightunsigned(fp, i).bitwiseAND(F.lit(LOWEST)) for i in range(4))
    return first + second + third + fourth


def grid_points(counts: Column) -> Column:
    """The embedding itself and its neighbours one step away, as an array of longs."""

    def step(i: int, up: bool) -> Column:
        nibble = F.shiftrightunsigned(counts, 4 * i).bitwiseAND(F.lit(15))
        one = F.lit(1 << 4 * i)
        return F.when(nibble < 4, counts + one) if up else F.when(nibble > 0, counts - one)

    return F.array_compact(F.array(counts, *[step(i, up) for i in range(16) for up in (True, False)]))


def _counts(fp: np.ndarray) -> np.ndarray:
    return sum(fp >> np.uint64(i) & np.uint64(LOWEST) for i in range(4))


def _linked(cells: np.ndarray, fps: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Verified pairs inside equal cells of sorted rows, and the fingerprints of dense cells."""
    first = np.flatnonzero(np.concatenate(([True], cells[1:] != cells[:-1])))
    length = np.diff(np.concatenate((first, [len(cells)])))
    size = np.repeat(length, length)
    dense = fps[size > DENSE]
    keep = size <= DENSE
    cells, fps = cells[keep], fps[keep]
    left, right = [], []
    for gap in range(1, DENSE):
        same = np.flatnonzero(cells[gap:] == cells[:-gap])
        if not len(same):
            break
        a, b = fps[same], fps[same + gap]
        near = np.bitwise_count(a ^ b) <= bits
        # Pairs with equal counts meet in all their cells; they are taken in one.
        ca = _counts(a)
        near &= (ca != _counts(b)) | (ca == cells[same])
        left.append(a[near])
        right.append(b[near])
    empty = np.zeros(0, np.uint64)
    return np.concatenate([empty, *left]), np.concatenate([empty, *right]), dense


def _compare(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows arrive sorted by cell; the last cell of a batch waits for the next batch."""
        rest_c, rest_f = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        ended = False
        source = iter(batches)
        while not ended:
            batch = next(source, None)
            if batch is None:
                ended, cells, fps = True, rest_c, rest_f
            else:
                cells = np.concatenate((rest_c, batch.column(0).to_numpy(zero_copy_only=False)))
                fps = np.concatenate((rest_f, batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)))
                cut = int(np.searchsorted(cells, cells[-1])) if len(cells) else 0
                if len(cells) - cut > DENSE:
                    # The open cell is dense already: let go of all but enough rows to keep it so.
                    yield _link_batch(np.zeros(0, np.uint64), np.zeros(0, np.uint64), fps[cut : len(fps) - DENSE - 1])
                    rest_c, rest_f = cells[len(cells) - DENSE - 1 :], fps[len(fps) - DENSE - 1 :]
                else:
                    rest_c, rest_f = cells[cut:], fps[cut:]
                cells, fps = cells[:cut], fps[:cut]
            if len(cells):
                yield _link_batch(*_linked(cells, fps, bits))

    return run


def _link_batch(a: np.ndarray, b: np.ndarray, dense: np.ndarray) -> pa.RecordBatch:
    nobody = pa.nulls(len(dense), pa.int64())
    return pa.record_batch(
        {
            "dense": pa.array(np.concatenate((np.zeros(len(a), bool), np.ones(len(dense), bool)))),
            "a": pa.array(np.concatenate((a, dense)).view(np.int64)),
            "b": pa.concat_arrays([pa.array(b.view(np.int64)), nobody]),
        }
    )


def near_links(prints: DataFrame, bits: int = 2) -> DataFrame:
    """Links (a, b) that connect every two distinct fingerprints within ``bits`` <= 2 bits.

    ``prints`` has one row per distinct long ``fp``. In dense grid points the links of a key go to
    its smallest fingerprint, or to a key that itself need not be a fingerprint: components over
    the fingerprints are exact, single links stand for paths.
    """
    if bits != 2:
        raise ValueError("the grid serves a distance of 2 bits")
    spread = prints.select(F.explode(grid_points(segment_counts(F.col("fp")))).alias("cell"), "fp")
    near = spread.repartition("cell").sortWithinPartitions("cell").mapInArrow(_compare(bits), LINKS)
    found = stored(near.distinct(), "near")
    flips = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.expr("fp").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i)))
    dense = found.where("dense").select(F.col("a").alias("fp")).distinct()
    keyed = dense.select("fp", F.explode(F.concat(F.array("fp"), flips)).alias("key"))
    families = keyed.groupBy("key").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1)
    stars = families.select(F.array_min("fps").alias("a"), F.explode("fps").alias("b")).where("a <> b")
    return found.where("not dense").select("a", "b").union(stars)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint, component_id for every row.

    component_id is the smallest doc_id reachable over links of 2 or fewer differing bits. Null and
    empty texts have the zero fingerprint and link like any other. Repeated rows and repeated ids
    keep their rows; null ids get a component but never name one unless it has no other id. An
    empty table gives an empty result. Other columns are not read.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), fingerprint(F.col("text")).alias("fp"))
    return with_components(stored(rows, "prints"), "doc_id").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def with_components(rows: DataFrame, least: str) -> DataFrame:
    """``rows`` (with a long ``fp``) and component_id, the least value of ``least`` in the component."""
    prints = stored(rows.groupBy("fp").agg(F.min(least).alias("low")), "distinct-prints")
    roots = connected_components(near_links(prints.select("fp")))
    linked = prints.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    lows = linked.groupBy("root").agg(F.min("low").alias("component_id"))
    named = stored(linked.select("fp", "root").join(lows, "root").select("fp", "component_id"), "components")
    return rows.join(named, "fp")


def keep_one_per_group(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of each component the row with its smallest id.

    All columns stay. Equal rows of that id are reduced to one, the one with the smallest text; a
    component without any id keeps one row.
    """
    keyed = with_ids(docs)
    ids = keyed.select("doc_id", fingerprint(F.col("body")).alias("fp"), "digest")
    return keep_heads(keyed, with_components(stored(ids, "prints"), "doc_id"))


def with_ids(docs: DataFrame) -> DataFrame:
    """row (all columns), doc_id, body and the digest of the body."""
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    keyed = packed.select("row", F.col("row.doc_id").cast("long").alias("doc_id"), F.coalesce("row.text", F.lit("")).alias("body"))
    return keyed.withColumn("digest", F.sha2("body", 256))


def keep_heads(keyed: DataFrame, named: DataFrame) -> DataFrame:
    """Of each component_id in ``named`` the row with its smallest (doc_id, digest)."""
    heads = named.groupBy("component_id").agg(
        F.min(F.struct(F.coalesce("doc_id", F.lit(2**63 - 1)).alias("order"), F.col("digest"))).alias("head")
    )
    chosen = heads.select(F.col("head.order").alias("order"), F.col("head.digest").alias("digest"))
    found = keyed.select(F.coalesce("doc_id", F.lit(2**63 - 1)).alias("order"), "digest", "row").join(chosen, ["order", "digest"], "left_semi")
    repeats = found.groupBy("order", "digest")
    return repeats.agg(F.first("row").alias("row")).select("row.*")
