"""Document probabilities from a lattice of subword segmentations.

A document is a sequence of tokens, its words and one end. A token is generated through any path of
a lattice, and the paths are summed:

* whole-token edge: the token as counted in the training documents;
* piece edges: every segmentation of the word into pieces of an existing vocabulary. Its scores,
  merge ranks, are the prior; the weights follow from the best segmentations of all distinct training
  words under that prior, normalised among word beginnings and among continuations, and after every
  piece the word ends with a fixed probability. Characters without a piece fall back to
  bytes. A forward recursion in log space sums all segmentations of a word;
* copy edge: an earlier token of the same document, by its share of them.

With N training tokens, V distinct ones and L the lattice probability of a word, a word of count c
has probability (c + V L) / (N + V): add-one smoothing with the lattice in place of the one. The
copy edge takes ``copy`` of the mass after the first token. The end has 1 % of the unseen mass.

Counting and lattice run once per distinct word of all documents. The most frequent ``head`` words
go to every task (a bounded table); all other words meet their counts in a join.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import remainder, stored

MARK = "▁"
STOP = 1 / 3
BYTE_MASS = 1e-3
PRIOR = 50.0
LONGEST = 16
HEAD = 200_000
COPY = 0.2
END_MASS = 0.01
FLUSH = 200_000

COUNTS = "word string, training long"
SCORED = (
    "uid long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double, "
    "rare array<struct<word: string, copies: array<double>>>"
)

SCORED_SCHEMA = pa.schema(
    [
        ("uid", pa.int64()),
        ("doc_id", pa.int64()),
        ("held_out", pa.bool_()),
        ("n_tokens", pa.int64()),
        ("n_known", pa.int64()),
        ("base", pa.float64()),
        ("score", pa.float64()),
        ("rare", pa.list_(pa.struct([("word", pa.string()), ("copies", pa.list_(pa.float64()))]))),
    ]
)


class Pieces:
    """Natural-log weights of vocabulary pieces, at word beginnings and inside words.

    ``first`` has the pieces that follow the mark, the empty one for the mark alone; ``inner`` all
    others. A word goes on after a piece or ends, by ``more`` and ``stop``.
    """

    def __init__(self, first: dict[str, float], inner: dict[str, float], stop: float):
        self.first, self.inner = _logs(first, 1.0), _logs(inner, 1 - BYTE_MASS)
        self.more, self.stop = math.log1p(-stop), math.log(stop)
        self.byte = math.log(BYTE_MASS / 256)

    def word_log(self, word: str) -> float:
        """Natural log of the summed probability of all segmentations of a word."""
        first, inner, more = self.first.get, self.inner.get, self.more
        # reach[j]: log probability of all piece sequences that spell word[:j] (the mark included).
        reach = [self.first[""]]
        for j in range(1, len(word) + 1):
            terms = []
            for i in range(max(0, j - LONGEST), j):
                p = inner(word[i:j])
                if p is not None:
                    terms.append(reach[i] + more + p)
            p = first(word[:j]) if j <= LONGEST else None
            if p is not None:
                terms.append(p)
            if word[j - 1] not in self.inner:
                terms.append(reach[j - 1] + (more + self.byte) * len(word[j - 1].encode("utf-8", "replace")))
            top = max(terms)
            reach.append(top if len(terms) == 1 else top + math.log(sum([math.exp(t - top) for t in terms])))
        return reach[-1] + self.stop

    def adapted(self, counts: dict[str, int], words: int) -> Pieces:
        """Weights from the pieces (with their mark) of the best segmentations of ``words`` words."""
        if not words:
            return self
        first = {k: PRIOR * math.exp(v) + counts.get(MARK + k, 0) for k, v in self.first.items()}
        inner = {k: PRIOR * math.exp(v) + counts.get(k, 0) for k, v in self.inner.items()}
        going_on = sum(counts.get(k, 0) for k in self.inner)
        return Pieces(first, inner, (words + 1) / (words + going_on + 3))

    def segmenter(self):
        """The library's best-segmentation search over these weights, for words behind a mark."""
        from tokenizers import Tokenizer
        from tokenizers.models import Unigram

        weights = {MARK + k: v for k, v in self.first.items()} | {k: v + self.more for k, v in self.inner.items()}
        return Tokenizer(Unigram([("<unk>", -100.0), *weights.items()], 0, False)), ["", *weights]


def _logs(weights: dict[str, float], mass: float) -> dict[str, float]:
    total = sum(weights.values())
    return {k: math.log(mass * v / total) for k, v in weights.items()}


@lru_cache(maxsize=2)
def vocabulary(model_file: str) -> Pieces:
    """Pieces by their existing scores, merge ranks: a piece weighs 1 / (rank + 10)."""
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=model_file)
    first, inner = {}, {}
    for i in range(library.get_piece_size()):
        piece = library.id_to_piece(i)
        if library.is_byte(i) or library.is_control(i) or library.is_unknown(i):
            continue
        weight = 1 / (10 + min(max(-library.get_score(i), 0.0), 1e5))
        if piece[0] != MARK:
            inner[piece] = weight
        elif MARK not in piece[1:]:
            first[piece[1:]] = weight
    return Pieces(first, inner, STOP)


def _best_pieces(model_file: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pieces in the best segmentations of a partition's words; one row per piece seen."""
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        library, names = vocabulary(model_file).segmenter()
        counts = np.zeros(len(names), np.int64)
        for batch in batches:
            found = library.encode_batch_fast([MARK + w for w in batch.column(0).to_pylist()], add_special_tokens=False)
            ids = np.array([i for e in found for i in e.ids], np.int64)
            counts += np.bincount(ids, minlength=len(names))
        seen = np.flatnonzero(counts[1:]) + 1
        yield pa.record_batch({"piece": pa.array([names[i] for i in seen], pa.string()), "n": pa.array(counts[seen])})

    return run


def adapted_pieces(words: DataFrame, model_file: str) -> Pieces:
    """The vocabulary's weights after one look at all training words, each counted once.

    At most one row per vocabulary piece comes to the driver.
    """
    training = words.where("c > 0").select("word")
    counts = training.mapInArrow(_best_pieces(model_file), "piece string, n long").groupBy("piece").agg(F.sum("n").alias("n")).collect()
    return vocabulary(model_file).adapted({r["piece"]: r["n"] for r in counts}, training.count())


@dataclass(frozen=True)
class Totals:
    """Training tokens N, distinct ones V, and the training documents (the count of the end)."""

    tokens: int
    distinct: int
    documents: int

    def base(self, counts: np.ndarray) -> np.ndarray:
        """log10 of (c + 1) / (N + V + 1)."""
        return np.log10(counts + 1.0) - math.log10(self.tokens + self.distinct + 1)

    def log_probability(self, counts: np.ndarray, lattice_log: np.ndarray) -> np.ndarray:
        """Natural log of the share of whole-token and piece edges; no word is too long for it."""
        unseen = max(self.distinct, 1)
        with np.errstate(divide="ignore"):
            return np.logaddexp(np.log(counts), math.log(unseen) + lattice_log) - math.log(self.tokens + unseen)

    def end(self) -> float:
        """Natural log of the end's probability."""
        return float(self.log_probability(np.array(float(self.documents)), np.array(math.log(END_MASS))))


def words_of(text: str | None) -> list[bytes]:
    """Words with A-Z in lower case. Bytes methods touch ASCII only."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words of a partition with their counts in training documents, 0 for words of the others."""
    other: dict[bytes, int] = {}
    training: dict[bytes, int] = {}

    def flush() -> pa.RecordBatch:
        words = [*training, *(w for w in other if w not in training)]
        batch = pa.record_batch(
            {
                "word": pa.array(words, pa.binary()).cast(pa.string()),
                "training": pa.array([training.get(w, 0) for w in words], pa.int64()),
            }
        )
        other.clear()
        training.clear()
        return batch

    for batch in batches:
        for text, learns in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            into = training if learns else other
            get = into.get
            for w in words_of(text):
                into[w] = get(w, 0) + 1
            if len(other) + len(training) > FLUSH:
                yield flush()
    yield flush()


def word_table(docs: DataFrame, model_file: str) -> DataFrame:
    """word, c (training count), lattice (its probability over all segmentations) and lattice_log, for all words.

    Scores come from lattice_log, the natural log; the probability of a long word is 0 as a double.
    """
    counted = docs.select("text", "learns").mapInArrow(_count, COUNTS)
    words = stored(counted.groupBy("word").agg(F.sum("training").alias("c")), "counts")
    shared = docs.sparkSession.sparkContext.broadcast(adapted_pieces(words, model_file))

    @F.pandas_udf("double")
    def lattice(column: pd.Series) -> pd.Series:
        word_log = shared.value.word_log
        return pd.Series([word_log(w) for w in column], dtype="float64")

    logs = words.select("word", "c", (lattice("word") + math.log1p(-END_MASS)).alias("lattice_log"))
    return logs.select("word", "c", F.exp("lattice_log").alias("lattice"), "lattice_log")


def frequent_words(table: DataFrame, totals: Totals, head: int) -> dict[bytes, tuple[float, float]]:
    """Count and log probability of the words above a count that at most ``head`` words reach.

    The limit comes from the sizes of count classes, eight to a power of two: a few hundred rows.
    """
    classes = table.where("c > 0").withColumn("class", F.floor(F.log2("c") * 8).cast("int"))
    sizes = classes.groupBy("class").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("class").desc()).collect()
    least, held = None, 0
    for r in sizes:
        held += r["n"]
        if held > head:
            break
        least = r["class"]
    if least is None:
        return {}
    found = classes.where(F.col("class") >= least).select("word", "c", "lattice_log").toArrow()
    counts = found["c"].to_numpy().astype(float)
    probability = totals.log_probability(counts, found["lattice_log"].to_numpy())
    return {w.encode(): pair for w, pair in zip(found["word"].to_pylist(), zip(counts.tolist(), probability.tolist()))}


def document_terms(words: list[bytes], known: dict[bytes, tuple[float, float]], totals: Totals, copy: float):
    """Known tokens, base and score of the words in ``known`` and the end; the other words with their copy shares.

    ``known`` has the count and the natural log of the probability of a word.
    """
    n = len(words)
    places: dict[bytes, int] = {}
    ids = np.array([places.setdefault(w, len(places)) for w in words], dtype=np.int64)
    order = np.argsort(ids, kind="stable")
    ordered = ids[order]
    starts = np.searchsorted(ordered, np.arange(len(places)))
    seen = np.empty(n, np.int64)
    seen[order] = np.arange(n) - starts[ordered]
    copies = np.zeros(n)
    copies[1:] = copy * seen[1:] / np.arange(1, n)
    left = np.full(n + 1, 1 - copy)
    left[0] = 1.0
    found = [known.get(w) for w in places]
    count = np.array([f[0] if f else -1.0 for f in found])
    prob = np.array([f[1] if f else 0.0 for f in found])
    at = count[ids] if n else np.zeros(0)
    here = at >= 0
    base = float(totals.base(at[here]).sum()) + float(totals.base(np.array(float(totals.documents))))
    with np.errstate(divide="ignore"):
        logs = np.logaddexp(np.log(left[:n][here]) + prob[ids[here]], np.log(copies[here]))
        score = (float(logs.sum()) + float(np.log(left[n])) + totals.end()) / math.log(10)
    known_tokens = int((at[here] > 0).sum()) + int(totals.documents > 0)
    rare = []
    missing = np.flatnonzero(count < 0)
    if len(missing):
        names = list(places)
        ends = np.append(starts[1:], n)
        for w in missing.tolist():
            where = order[starts[w] : ends[w]]
            # The very first token has no copy edge and its whole mass; a negative share marks it.
            rare.append((names[w], [-1.0 if p == 0 else float(copies[p]) for p in where.tolist()]))
    return known_tokens, base, score, rare


def _score(head, totals: Totals, copy: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = SCORED_SCHEMA
        known, uid = head.value, TaskContext.get().partitionId() << 36
        for batch in batches:
            rows = []
            for doc_id, held, text in zip(*[c.to_pylist() for c in batch.columns]):
                words = words_of(text)
                n_known, base, score, rare = document_terms(words, known, totals, copy)
                rows.append((uid, doc_id, held, len(words) + 1, n_known, base, score, [{"word": w.decode(), "copies": c} for w, c in rare]))
                uid += 1
            columns = zip(*rows) if rows else [[] for _ in schema]
            yield pa.record_batch([pa.array(list(c), f.type) for c, f in zip(columns, schema)], schema=schema)

    return run


def _log_sum(a: Column, b: Column) -> Column:
    """Log of the sum of two numbers given by their natural logs."""
    top = F.greatest(a, b)
    return top + F.log1p(F.exp(F.least(a, b) - top))


def score_documents(docs: DataFrame, model_file: str, folds: int = 7, held: int = 2, head: int = HEAD, copy: float = COPY) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row.

    Null texts are empty: their only token is the end. Null ids are not held out and are learned
    from. Repeated rows count and are scored as often as they stand. An empty table gives an empty
    result. Without training documents N and V are 0 and every word is scored by its lattice alone.
    Other columns are not read.
    """
    spark = docs.sparkSession
    fold = remainder(F.col("doc_id").cast("long"), folds)
    source = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(fold == held, F.lit(False)).alias("held_out"),
        F.col("text").cast("string").alias("text"),
    )
    table = stored(word_table(source.select("text", (~F.col("held_out")).alias("learns")), model_file), "words")
    found = table.agg(F.sum("c").alias("n"), F.sum((F.col("c") > 0).cast("long")).alias("v")).first()
    documents = source.where(~F.col("held_out")).count()
    totals = Totals((found["n"] or 0) + documents, (found["v"] or 0) + (documents > 0), documents)
    shared = spark.sparkContext.broadcast(frequent_words(table, totals, head))
    scored = stored(source.select("doc_id", "held_out", "text").mapInArrow(_score(shared, totals, copy), SCORED), "scored")
    unseen = max(totals.distinct, 1)
    rare = scored.select("uid", F.inline("rare")).join(table, "word")
    piece = F.col("lattice_log") + math.log(unseen)
    p = F.when(F.col("c") > 0, _log_sum(F.log(F.col("c").cast("double")), piece)).otherwise(piece) - math.log(totals.tokens + unseen)
    new = F.col("p") + (math.log1p(-copy) if copy < 1 else -math.inf)
    token = lambda x: F.when(x < 0, F.col("p")).when(x > 0, _log_sum(new, F.log(x))).otherwise(new)
    per_token = F.aggregate("copies", F.lit(0.0), lambda a, x: a + token(x)) / math.log(10)
    times = F.size("copies")
    joined = rare.withColumn("p", p).select(
        "uid",
        (times * (F.col("c") > 0).cast("long")).alias("more_known"),
        (times * (F.log10(F.col("c") + F.lit(1.0)) - math.log10(totals.tokens + totals.distinct + 1))).alias("more_base"),
        per_token.alias("more_score"),
    )
    more = joined.groupBy("uid").agg(F.sum("more_known").alias("more_known"), F.sum("more_base").alias("more_base"), F.sum("more_score").alias("more_score"))
    whole = scored.drop("rare").join(more, "uid", "left")
    return whole.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("more_known", F.lit(0))).cast("long").alias("n_known"),
        F.lit(totals.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more_base", F.lit(0.0))).alias("base_score"),
        (F.col("score") + F.coalesce("more_score", F.lit(0.0))).alias("score"),
    )
