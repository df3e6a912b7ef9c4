"""Mixing sources to target weights by Sainte-Laguë apportionment, in DataFrame operations only.

Targets: sources in code-point order weigh 3, 1, 2, repeating, and share ``share`` times all words;
a source stops at ``cap`` times its own words and its excess is shared by weight among the rest.

Quotas: each source's documents are dealt by a seeded hash into shards of about ``shard_docs``
documents. In a shard the house is its part of all targets in blocks of ``block`` words, and the
sources of that shard get blocks by the highest quotients target / (2 j + 1). Seats that a source
has under any tie are granted by a bound, so only about two candidate seats per source are ranked.

Selection: a source's documents of a shard lie end to end in seeded order; its blocks are taken
from the start of that line, around it at most ``cap`` times. A document's taken words follow
from its place on the line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import WORD, stored

WEIGHTS = (3, 1, 2)
SHARE_PERCENT = 150
CAP = 2
BLOCK = 8
SHARD_DOCS = 256
SEED = 20


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share_percent: int = SHARE_PERCENT, cap: int = CAP) -> DataFrame:
    """source, source_size, docs, target for each source of ``sizes`` (source, source_size, docs).

    Rows are one per source name, so the two windows without partition order a table of names.
    Filled by water level: with sources sorted by cap * size / weight, the first ones are at
    their cap, all others at weight times one level. Sources without words have target 0.
    """
    named = Window.orderBy(F.col("source").asc_nulls_last())
    place = (F.row_number().over(named) - 1) % len(weights)
    weighed = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), place + 1))
    limits = weighed.withColumn("top", F.col("source_size") * cap).withColumn("ratio", F.col("top") / F.col("weight"))
    filled = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before, after, everything = (
        filled.rowsBetween(Window.unboundedPreceding, -1),
        filled.rowsBetween(0, Window.unboundedFollowing),
        filled.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing),
    )
    # The level that holds if exactly the sources before this one are at their caps.
    level = (
        F.sum("source_size").over(everything) * (share_percent / 100) - F.coalesce(F.sum("top").over(before), F.lit(0))
    ) / F.sum("weight").over(after)
    leveled = limits.withColumn("level", level).withColumn("free", F.col("level") <= F.col("ratio"))
    settled = leveled.withColumn("water", F.min(F.when(F.col("free"), F.struct("ratio", "level"))).over(everything)["level"])
    target = F.least(F.col("top").cast("double"), F.coalesce(F.col("water") * F.col("weight"), F.col("top").cast("double")))
    return settled.select("source", "source_size", "docs", target.cast("double").alias("target"))


def block_quotas(cells: DataFrame, block: int = BLOCK) -> DataFrame:
    """Adds ``quota`` to cells (shard, source, wanted, ...): Sainte-Laguë blocks within each shard.

    The house of a shard is its wanted words in whole blocks. A source's final seats lie between
    wanted * (house -/+ n / 2) / total -/+ 1 / 2, n being the sources of the shard; seats up
    to the lower bound are granted, those up to the upper bound compete by quotient.
    """
    shard = Window.partitionBy("shard")
    total, n = F.sum("wanted").over(shard), F.count(F.lit(1)).over(shard)
    sized = cells.withColumn("total", total).withColumn("n", n).withColumn("house", F.round(F.col("total") / block).cast("long"))
    part = F.col("wanted") / F.col("total")
    low = F.greatest(F.lit(0), F.ceil(part * (F.col("house") - F.col("n") / 2) - 0.5) - 1)
    high = F.floor(part * (F.col("house") + F.col("n") / 2) + 0.5) + 1
    bounded = sized.select(
        "shard",
        "source",
        "wanted",
        "house",
        F.when(F.col("total") > 0, low).otherwise(0).cast("long").alias("low"),
        F.when(F.col("total") > 0, high).otherwise(0).cast("long").alias("high"),
    )
    seats = bounded.withColumn("seat", F.explode(F.sequence("low", "high")))
    ranked = seats.withColumn(
        "place",
        F.row_number().over(
            shard.orderBy((F.col("wanted") / (2 * F.col("seat") + 1)).desc(), F.col("source").asc_nulls_last(), "seat")
        ),
    )
    granted = ranked.withColumn("open", F.col("house") - F.sum(F.when(F.col("seat") == F.col("low"), F.col("low")).otherwise(0)).over(shard))
    return granted.groupBy("shard", "source").agg(
        (F.min("low") + F.sum(F.when((F.col("place") <= F.col("open")) & (F.col("wanted") > 0), 1).otherwise(0))).alias("quota")
    )


def mix_sources(
    docs: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    share_percent: int = SHARE_PERCENT,
    cap: int = CAP,
    block: int = BLOCK,
    shard_docs: int = SHARD_DOCS,
    seed: int = SEED,
    payload: list[Column] | None = None,
) -> DataFrame:
    """doc_id, size, source_size, target, taken for every row, and the columns of ``payload``.

    Null and empty texts have size 0 and take 0 words. Null sources are one source, the last.
    Null and repeated ids are rows like any other; rows equal in id, size and payload hash are
    interchangeable, so reruns agree. An empty table gives an empty result.
    """
    extra = [c.alias(f"extra{i}") for i, c in enumerate(payload or [])]
    kept = [f"extra{i}" for i in range(len(extra))]
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        word_count(F.col("text")).alias("size"),
        F.xxhash64(F.lit(seed), F.col("doc_id").cast("string"), F.col("text")).alias("draw"),
        *extra,
    )
    if not kept:
        rows = stored(rows, "sizes")
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("docs"))
    targets = stored(source_targets(sizes, weights, share_percent, cap), "targets")
    many = F.greatest(F.lit(1), F.ceil(F.col("docs") / shard_docs)).cast("long")
    # One row per source name: small against the documents, left to the planner's size check.
    facts = targets.select(F.col("source").alias("s"), "source_size", "target", many.alias("shards"))
    dealt = rows.join(facts, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    dealt = dealt.withColumn("shard", F.pmod(F.xxhash64("draw"), F.col("shards")))
    cells = dealt.groupBy("shard", "source").agg(
        F.sum("size").alias("words"), F.first("source_size").alias("source_size"), F.first("target").alias("target")
    )
    wanted = F.when(F.col("source_size") > 0, F.col("target") * F.col("words") / F.col("source_size")).otherwise(0.0)
    cells = stored(cells.select("shard", "source", "words", wanted.alias("wanted")), "cells")
    quotas = block_quotas(cells, block).select(F.col("shard").alias("qs"), F.col("source").alias("qn"), "quota")
    # One column names the cell: rows that a join has dealt by source would else stay together.
    cell = Window.partitionBy(F.struct("shard", "source"))
    line = cell.orderBy("draw", F.col("doc_id").asc_nulls_last(), "size")
    placed = dealt.withColumn("ends", F.sum("size").over(line.rowsBetween(Window.unboundedPreceding, 0))).withColumn(
        "words", F.sum("size").over(cell)
    )
    drawn = placed.join(quotas, (F.col("shard") == F.col("qs")) & F.col("source").eqNullSafe(F.col("qn")))
    words = F.least(F.col("quota") * block, F.col("words") * cap)
    rounds = F.when(F.col("words") > 0, F.floor(words / F.col("words"))).otherwise(0)
    taken = F.col("size") * rounds + F.least(
        F.col("size"), F.greatest(F.lit(0), words - rounds * F.col("words") - (F.col("ends") - F.col("size")))
    )
    return drawn.select("doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"), *kept)


def first_words(text: Column, n: Column) -> Column:
    """The first ``n`` words of a text with what stands between them."""
    pieces = F.regexp_extract_all(text, F.lit(rf"([^\x20\x09-\x0D]+[\x20\x09-\x0D]*)"), F.lit(1))
    return F.rtrim(F.array_join(F.slice(pieces, F.lit(1), n.cast("int")), ""))


def mixed_documents(docs: DataFrame, **options: object) -> DataFrame:
    """The documents of the mix: one row per full copy taken and one cut row for a part.

    All columns stay; a cut text gets its own n_chars where that column exists. Documents of which
    the mix takes nothing go, those without words among them.
    """
    names = docs.columns
    row = F.struct(*[F.col(f"`{c}`") for c in names])
    mixed = mix_sources(docs, payload=[row], **options)
    copies = F.col("taken") / F.greatest(F.col("size"), F.lit(1))
    full = F.floor(copies).cast("int")
    part = F.col("taken") % F.greatest(F.col("size"), F.lit(1))
    shares = F.concat(F.array_repeat(F.lit(0).cast("long"), full), F.when(part > 0, F.array(part)).otherwise(F.array().cast("array<long>")))
    shown = mixed.where("taken > 0").select("extra0", F.explode(shares).alias("cut"))
    text = F.when(F.col("cut") > 0, first_words(F.col("extra0.text"), F.col("cut"))).otherwise(F.col("extra0.text"))
    out = shown.withColumn("cut_text", text)
    columns = []
    for c in names:
        value = F.col("extra0")[c]
        if c == "text":
            value = F.col("cut_text")
        elif c == "n_chars":
            value = F.when(F.col("cut") > 0, F.length("cut_text").cast(docs.schema[c].dataType)).otherwise(value)
        columns.append(value.alias(c))
    return out.select(*columns)
