"""Ordered work on long series, cut into time chunks.

A plain ``Window.partitionBy(key)`` puts every row of a key into one task. With few
keys, or one key that holds a large share of the rows, that task decides the run
time of the whole job. Everything here partitions by ``(key, chunk)`` instead, where a
chunk is a fixed number of steps of the series:

* bounded frames (lag, lead, rolling) copy the rows near a chunk border into the
  neighbouring chunk as a halo, compute there and drop the copies;
* unbounded frames (fill, running position, island start) run inside the chunk,
  reduce each chunk to one summary row, scan the short summary per key and join
  the carried value back.

Both give exactly the rows a plain window gives.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tidemark.session import written

CHUNK = "_chunk"
INDEX = "_index"
POSITION = "_position"


@dataclass(frozen=True)
class Series:
    """How a table is keyed and ordered.

    ``index`` names an integer column to use as row index. Without it the index is
    the number of whole steps since the epoch, which is right for a gap-free series.

    ``short_keys`` says that every key holds few rows by construction, such as one
    forecast run of 24 hours. Each key is then one chunk and needs no halo and no carry.
    """

    keys: tuple[str, ...] = ("zone",)
    time: str = "datetime"
    step_seconds: int = 3600
    chunk_steps: int = 2048
    index: str | None = None
    short_keys: bool = False

    def index_column(self) -> Column:
        if self.index:
            return F.col(self.index).cast("long")
        return floor_div(F.unix_micros(F.col(self.time).cast("timestamp")), self.step_seconds * 1_000_000)

    def step(self) -> Column:
        return F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(self.step_seconds).cast("decimal(18,6)"))

    def chunk_window(self, descending: bool = False) -> WindowSpec:
        order = F.col(self.time).desc() if descending else F.col(self.time).asc()
        return Window.partitionBy(*self.keys, *([] if self.short_keys else [CHUNK])).orderBy(order)

    def over(self) -> str:
        """The ascending chunk window in SQL, for plans that state many columns as text."""
        keys = ", ".join(f"`{k}`" for k in [*self.keys, *([] if self.short_keys else [CHUNK])])
        return f"PARTITION BY {keys} ORDER BY `{self.time}`"

    def summary_window(self, descending: bool = False) -> WindowSpec:
        order = F.col(CHUNK).desc() if descending else F.col(CHUNK).asc()
        return Window.partitionBy(*self.keys).orderBy(order)


def floor_div(value: Column, size: int) -> Column:
    """Integer division rounding towards minus infinity (times before 1970)."""
    value = value.cast("long")
    return ((value - F.pmod(value, F.lit(size))) / F.lit(size)).cast("long")


def with_chunk(df: DataFrame, series: Series) -> DataFrame:
    """Add the chunk number of each row."""
    return df.withColumn(CHUNK, floor_div(series.index_column(), series.chunk_steps))


def in_chunks(
    df: DataFrame,
    series: Series,
    back: int,
    forward: int,
    transform: Callable[[DataFrame, WindowSpec], DataFrame],
    keep_chunk: bool = False,
) -> DataFrame:
    """Apply ``transform`` to chunks that carry a halo of ``back`` rows before and
    ``forward`` rows after their own.

    ``transform`` gets the rows and the window to use. It adds columns with any number of
    window steps, whose reach together must stay inside the halo. All steps share one
    shuffle and one sort. The series must be gap-free in its index.
    """
    if series.short_keys:
        return transform(df, series.chunk_window())
    reach = back + forward
    size = max(series.chunk_steps, 4 * reach)
    index = F.col(INDEX)
    copies = df.withColumn(INDEX, series.index_column())
    if reach:
        copies = copies.withColumn(
            CHUNK, F.explode(F.sequence(floor_div(index - forward, size), floor_div(index + back, size)))
        )
    else:
        copies = copies.withColumn(CHUNK, floor_div(index, size))
    computed = transform(copies, series.chunk_window())
    kept = computed.filter(F.col(CHUNK) == floor_div(index, size))
    return kept.drop(INDEX) if keep_chunk else kept.drop(INDEX, CHUNK)


def bounded_window(
    df: DataFrame,
    series: Series,
    back: int,
    forward: int,
    build: Callable[[WindowSpec], dict[str, Column]],
) -> DataFrame:
    """Evaluate window columns whose frames reach at most ``back`` rows before and
    ``forward`` rows after the current row.

    ``build`` gets the window to use and returns the new columns by name.
    """
    return in_chunks(df, series, back, forward, lambda rows, w: rows.withColumns(build(w)))


def fill_nulls(
    df: DataFrame,
    series: Series,
    columns: Sequence[str],
    directions: Sequence[str] = ("forward", "backward"),
    default: object | None = None,
    observed: DataFrame | None = None,
) -> DataFrame:
    """Replace nulls by the nearest earlier (forward) or later (backward) value of the
    key, trying ``directions`` in the given order, then ``default``.

    ``observed`` may name a smaller table that holds all the non-null rows.
    """
    columns = list(columns)
    # Rows are chunked by time here, so gaps in the index do no harm.
    base = df if CHUNK in df.columns or series.short_keys else with_chunk(df, series)
    ahead = series.chunk_window().rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # Descending order keeps the frame growing; a frame ending in UNBOUNDED FOLLOWING
    # would be rescanned for every row.
    behind = series.chunk_window(descending=True).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    frames = {"forward": ahead, "backward": behind}

    local = base.select(
        "*", *[F.last(c, True).over(frames[d]).alias(f"_{d}_{c}") for d in directions for c in columns]
    )

    def filled(name: str, carried: bool) -> Column:
        options = [F.col(name)]
        for d in directions:
            options += [F.col(f"_{d}_{name}"), *([F.col(f"_carry_{d}_{name}")] if carried else [])]
        if default is not None:
            options.append(F.lit(default))
        return F.coalesce(*options).cast(df.schema[name].dataType).alias(name)

    def shown(table: DataFrame, carried: bool) -> DataFrame:
        return table.select(*[filled(c, carried) if c in columns else F.col(c) for c in df.columns if c != CHUNK])

    if series.short_keys:
        return shown(local, False)
    time = F.col(series.time)
    source = base if observed is None else with_chunk(observed, series)
    edges = source.groupBy(*series.keys, CHUNK).agg(
        *[
            (F.max_by if d == "forward" else F.min_by)(F.col(c), F.when(F.col(c).isNotNull(), time)).alias(f"_{d}_{c}")
            for d in directions
            for c in columns
        ]
    )
    # A chunk without a summary (none of its rows is in ``observed``) lies between two that
    # have one: it is written out with the values carried over the earlier one.
    carries = {
        f"_carry_{d}_{c}": F.last(f"_{d}_{c}", True).over(
            series.summary_window(d == "backward").rowsBetween(Window.unboundedPreceding, -1)
        )
        for d in directions
        for c in columns
    }
    scanned = edges.withColumns({**carries, "_upto": F.lead(CHUNK).over(series.summary_window()) - 1})
    at, own = F.col("_at"), F.col(CHUNK)
    carried = scanned.withColumn("_at", F.explode(F.sequence(own, F.coalesce(F.col("_upto"), own)))).select(
        *series.keys,
        at.alias(CHUNK),
        *[
            F.when(at == own, F.col(f"_carry_{d}_{c}"))
            .otherwise(F.coalesce(f"_{d}_{c}", f"_carry_{d}_{c}") if d == "forward" else F.col(f"_carry_{d}_{c}"))
            .alias(f"_carry_{d}_{c}")
            for d in directions
            for c in columns
        ],
    )
    return shown(local.join(carried, [*series.keys, CHUNK], "left"), True)


def with_position(df: DataFrame, series: Series, name: str = POSITION, length: str | None = None) -> DataFrame:
    """Add the dense position (0, 1, 2, …) of each row in its key's time order, and
    optionally the number of rows of the key.
    """
    if series.short_keys:
        group = Window.partitionBy(*series.keys)
        extra = [F.count(F.lit(1)).over(group).alias(length)] if length else []
        row = (F.row_number().over(series.chunk_window()) - 1).cast("long")
        return df.select(*df.columns, row.alias(name), *extra)
    base = with_chunk(df, series)
    counts = base.groupBy(*series.keys, CHUNK).agg(F.count(F.lit(1)).alias("_n"))
    before = series.summary_window().rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*series.keys)
    offsets = counts.select(
        *series.keys,
        CHUNK,
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"),
        F.sum("_n").over(whole).alias("_length"),
    )
    numbered = base.withColumn("_row", F.row_number().over(series.chunk_window()))
    extra = [F.col("_length").alias(length)] if length else []
    return numbered.join(offsets, [*series.keys, CHUNK]).select(
        *df.columns, (F.col("_offset") + F.col("_row") - 1).cast("long").alias(name), *extra
    )


def dense(df: DataFrame, series: Series) -> tuple[DataFrame, Series]:
    """Index an irregular series by position, so that bounded frames count rows."""
    return with_position(df, series), replace(series, index=POSITION)


# Above this number Spark no longer limits each key in every task before the shuffle.
GROUP_LIMIT = 1000
SALTS = 64


def top_n(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, rank: str) -> DataFrame:
    """The first ``n`` rows per key with their ``rank``.

    Up to GROUP_LIMIT Spark cuts each key to ``n`` rows in every task. A larger ``n`` is cut in
    SALTS parts of every key first, so that a key brings one task SALTS * n rows at most.
    """
    if n > GROUP_LIMIT:
        salted = df.withColumn("_salt", F.pmod(F.xxhash64(*df.columns), F.lit(SALTS)))
        part = Window.partitionBy(*keys, "_salt").orderBy(*order)
        df = salted.withColumn("_row", F.row_number().over(part)).filter(F.col("_row") <= n).drop("_row", "_salt")
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) <= n)


def latest_rows(df: DataFrame, series: Series, n: int, ties: Sequence[str] = ()) -> DataFrame:
    """The last ``n`` rows per key; a long key does not reach one task whole."""
    return top_n(df, series.keys, [F.col(series.time).desc(), *map(F.col, ties)], n, "_row").drop("_row")


def middle_rows(df: DataFrame, series: Series, n: int) -> DataFrame:
    """``n`` rows per key starting at the middle of the series."""
    middle = floor_div(F.col("_len"), 2)
    return (
        with_position(df, series, "_p", "_len")
        .filter((F.col("_p") >= middle) & (F.col("_p") < middle + n))
        .drop("_p", "_len")
    )


def time_axis(df: DataFrame, series: Series) -> DataFrame:
    """All (keys, time) steps from each key's first to its last time, with their chunk.

    It is generated chunk by chunk, so no single row ever carries the whole axis of a
    long key.
    """
    step_us = series.step_seconds * 1_000_000
    span = df.groupBy(*series.keys).agg(F.min(series.time).alias("_lo"), F.max(series.time).alias("_hi"))
    lo_us, size = F.unix_micros("_lo"), series.chunk_steps
    first, steps = floor_div(lo_us, step_us), floor_div(F.unix_micros("_hi") - lo_us, step_us)
    pieces = span.select(*series.keys, "_lo", first.alias("_first"), steps.alias("_steps")).select(
        *series.keys,
        "_lo",
        "_first",
        "_steps",
        F.explode(
            F.sequence(floor_div(F.col("_first"), size), floor_div(F.col("_first") + F.col("_steps"), size))
        ).alias(CHUNK),
    )
    start = F.greatest(F.lit(0).cast("long"), F.col(CHUNK) * size - F.col("_first"))
    stop = F.least(F.col("_steps"), (F.col(CHUNK) + 1) * size - 1 - F.col("_first"))
    return (
        pieces.repartition(*series.keys, CHUNK)
        .select(*series.keys, "_lo", CHUNK, F.explode(F.sequence(start, stop)).alias("_k"))
        .select(*series.keys, CHUNK, F.timestamp_micros(lo_us + F.col("_k") * step_us).alias(series.time))
    )


def regularise(df: DataFrame, series: Series) -> DataFrame:
    """Put the series on a gap-free time axis per key; missing steps become null rows.

    The axis starts at the key's first time; rows off its steps are left out.
    """
    on = [*series.keys, series.time]
    return time_axis(df, series).drop(CHUNK).join(df, on, "left").select(*df.columns)


def regularise_and_fill(
    df: DataFrame,
    series: Series,
    columns: Sequence[str],
    directions: Sequence[str] = ("forward", "backward"),
    default: object | None = None,
) -> DataFrame:
    """:func:`regularise`, then :func:`fill_nulls`.

    The steps added by the axis hold no values, so the chunk summaries come from the
    rows themselves and the axis join is computed once.
    """
    on = [*series.keys, series.time]
    # The join below implies this filter; stated here, both uses of the table share one shuffle.
    df = df.filter(reduce(and_, [F.col(c).isNotNull() for c in on]))
    whole = time_axis(df, series).join(df, on, "left")
    return fill_nulls(whole, series, columns, directions, default, observed=df).select(*df.columns)


def islands(df: DataFrame, series: Series, flag: Column, start: str = "_island") -> DataFrame:
    """Mark each row whose flag holds with the time its unbroken run of flags began.

    Rows whose flag does not hold get null. Neighbours are neighbouring rows of the
    index; use :func:`dense` first when the series has gaps that should not matter.
    """
    flagged = df.withColumn("_flag", F.coalesce(flag, F.lit(False)))
    opened = bounded_window(
        flagged,
        series,
        1,
        0,
        lambda w: {
            "_start": F.when(
                F.col("_flag") & ~F.coalesce(F.lag("_flag", 1).over(w), F.lit(False)), F.col(series.time)
            )
        },
    )
    if not series.short_keys:
        # The fill reads its input twice.
        opened = written(opened, "islands")
    carried = fill_nulls(opened, series, ["_start"], ("forward",))
    return carried.withColumn(start, F.when(F.col("_flag"), F.col("_start"))).drop("_start", "_flag")
