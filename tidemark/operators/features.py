"""Feature columns for regular series."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from tidemark.functions import calendar, scalars
from tidemark.operators.rolling import add_columns, add_lags, add_rolling
from tidemark.operators.series import Series, bounded_window, fill_nulls, in_chunks
from tidemark.session import written

TARGET = "carbon_intensity_gco2_per_kwh"
LOAD = "total_load_mw"
TEMPERATURE = "temperature_2m_c"
WIND = "wind_speed_100m_ms"
CLOUD = "cloud_cover_pct"
RADIATION = "shortwave_radiation_wm2"
CARBON_FREE = "carbon_free_energy_pct"
RENEWABLE = "renewable_energy_pct"


@dataclass(frozen=True)
class Profile:
    """One declared set of features, so that training and serving cannot drift apart unseen."""

    name: str
    lag_columns: tuple[str, ...]
    rolling: Mapping[str, Mapping[int, tuple[str, ...]]]
    lags: tuple[int, ...] = (1, 3, 6, 24, 168)
    short_names: bool = False
    variability_rows: int = 24

    def lag_name(self, column: str, n: int) -> str:
        return f"lag_{n}h" if self.short_names else f"{column}_lag_{n}h"

    def rolling_name(self, column: str, stat: str, rows: int) -> str:
        return f"rolling_{stat}_{rows}h" if self.short_names else f"{column}_{stat}_{rows}h"

    @property
    def reach(self) -> int:
        rows = [n for windows in self.rolling.values() for n in windows]
        return max([*self.lags, *[n - 1 for n in rows], self.variability_rows - 1, 1])


ALL_STATS = ("mean", "std", "min", "max")
TRAIN = Profile(
    "train",
    lag_columns=(TARGET, LOAD, TEMPERATURE, WIND),
    rolling={c: {n: ALL_STATS for n in (4, 12, 24)} for c in (TARGET, LOAD, TEMPERATURE)},
)
SERVE = Profile(
    "serve",
    lag_columns=(TARGET,),
    rolling={TARGET: {4: ("mean",), 12: ("mean",), 24: ("mean", "std")}},
    short_names=True,
)
PROFILES = {p.name: p for p in (TRAIN, SERVE)}


def lag_name(column: str, n: int) -> str:
    return f"{column}_lag_{n}h"


def rolling_name(column: str, stat: str, n: int) -> str:
    return f"{column}_{stat}_{n}h"


def full_window_std(df: DataFrame, over: str, column: str, rows: int, name: str) -> DataFrame:
    """Rolling standard deviation that needs all ``rows`` values, else 0."""
    parts = {s: f"_{s}_{column}" for s in ("std", "count")}
    rolled = add_rolling(df, over, {column: {rows: tuple(parts)}}, lambda c, s, n: parts[s])
    full = F.when(F.col(parts["count"]) == rows, F.col(parts["std"])).otherwise(0.0)
    return rolled.withColumn(name, full).drop(*parts.values())


def change_column(w: WindowSpec, column: str) -> Column:
    """Difference from the previous row; 0 where either is missing."""
    return F.coalesce(F.col(column) - F.lag(column, 1).over(w), F.lit(0.0))


TARGET_HORIZONS = (1, 6, 12, 24)


def target_name(horizon: int) -> str:
    return f"carbon_intensity_target_{horizon}h"


def lead_columns(w: WindowSpec, column: str, horizons: Sequence[int], name=target_name) -> dict[str, Column]:
    return {name(h): F.lead(column, h).over(w) for h in horizons}


def add_lag_features(df: DataFrame, series: Series, columns: Sequence[str], lags: Sequence[int]) -> DataFrame:
    return in_chunks(df, series, max(lags), 0, lambda rows, w: add_lags(rows, series.over(), columns, lags, lag_name))


def add_rolling_features(df: DataFrame, series: Series, rolling: Mapping[str, Mapping[int, Sequence[str]]]) -> DataFrame:
    reach = max(n for windows in rolling.values() for n in windows) - 1
    return in_chunks(df, series, reach, 0, lambda rows, w: add_rolling(rows, series.over(), rolling, rolling_name))


def add_targets(df: DataFrame, series: Series, column: str = TARGET, horizons: Sequence[int] = TARGET_HORIZONS) -> DataFrame:
    return bounded_window(df, series, 0, max(horizons), lambda w: lead_columns(w, column, horizons))


def add_calendar(df: DataFrame, profile: str = "train", time: str = "datetime") -> DataFrame:
    ts = F.col(time)
    return df.withColumns({**calendar.temporal_columns(ts, profile), **calendar.cyclic_columns(ts, profile)})


def interaction_columns(columns: Sequence[str], profile: str = "train") -> dict[str, Column]:
    """Row-wise interactions; a serving profile without weather gets zeros."""
    has = set(columns).issuperset
    if profile == "serve":
        return {
            "solar_potential": scalars.solar_from_radiation(F.col(RADIATION), F.col(CLOUD))
            if has({RADIATION, CLOUD})
            else F.lit(0.0),
            "temp_demand_proxy": scalars.temperature_distance(F.col(TEMPERATURE)) if has({TEMPERATURE}) else F.lit(0.0),
            "carbon_change_1h": F.col(TARGET) - F.col("lag_1h"),
        }
    return {
        "solar_potential": scalars.solar_potential(F.col("is_daytime"), F.col(CLOUD)),
        "temp_demand_proxy": scalars.temperature_demand(F.col(LOAD), F.col(TEMPERATURE)),
        "clean_energy_score": scalars.clean_energy_score(F.col(CARBON_FREE), F.col(RENEWABLE)),
    }


def numeric_columns(df: DataFrame) -> list[str]:
    kinds = ("tinyint", "smallint", "integer", "bigint", "long", "short", "byte", "int", "float", "double")
    return [f.name for f in df.schema.fields if f.dataType.typeName() in kinds]


def _fill_ahead(rows: DataFrame, over: str, spec: Profile) -> DataFrame:
    """Backward fill of features that lack history, for complete raw columns.

    The first lag a key has is its first value, so rows without a lag take the key's first
    value when the key is longer than the lag. A deviation of one row takes the next row's.
    """
    stds = [spec.rolling_name(c, "std", n) for c, windows in spec.rolling.items() for n, s in windows.items() if "std" in s]
    next_row = [*stds, *(["carbon_change_1h"] if spec.name == "serve" else [])]
    first = {c: f"_first_{c}" for c in spec.lag_columns}
    following = {c: f"_next_{c}" for c in next_row}
    helpers = {
        "_row": f"row_number() OVER ({over})",
        "_rows": f"count(1) OVER ({over} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)",
        **{f: f"first(`{c}`) OVER ({over} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)" for c, f in first.items()},
        **{f: f"lead(`{c}`) OVER ({over})" for c, f in following.items()},
    }
    filled = {c: f"coalesce(`{c}`, `{f}`)" for c, f in following.items()}
    for c in spec.lag_columns:
        for n in spec.lags:
            lag = spec.lag_name(c, n)
            # Without a lag the chunk begins at the key's first row.
            filled[lag] = f"CASE WHEN _row <= {n} AND _rows > {n} THEN coalesce(`{lag}`, `{first[c]}`) ELSE `{lag}` END"
    return add_columns(add_columns(rows, helpers), filled).drop(*helpers)


def build_features(
    df: DataFrame,
    series: Series = Series(),
    profile: str = "train",
    fill: str = "general",
) -> DataFrame:
    """All features of a profile in one pass over the series.

    Lags, rolling statistics, change and variability share one shuffle; calendar and
    interactions are row expressions.

    ``fill`` decides about features that lack history:

    * ``general``: train features are filled backward, forward, then with 0, so early rows
      get values from later ones; serve features are filled forward, then backward. Raw columns
      may hold any pattern of nulls; the fill is a second, two-phase pass.
    * ``complete``: the same result for raw columns that are complete, as cleaning leaves
      them, or wholly missing for a key. The fill then reaches no further than the longest
      lag and stays in the same pass. The precondition is not checked.
    * ``causal``: never looks ahead; missing history is 0.
    * ``none``: nulls stay.
    """
    if fill not in ("general", "complete", "causal", "none"):
        raise ValueError(f"unknown fill {fill!r}")
    spec = PROFILES[profile]
    ahead = fill == "complete"

    def windowed(rows: DataFrame, w: WindowSpec) -> DataFrame:
        rows = add_lags(rows, series.over(), spec.lag_columns, spec.lags, spec.lag_name)
        extra = {LOAD: {spec.variability_rows: ("count",)}} if profile == "train" else {}
        rolling = {c: dict(windows) for c, windows in spec.rolling.items()}
        for c, windows in extra.items():
            for n, stats in windows.items():
                rolling.setdefault(c, {})[n] = (*rolling.get(c, {}).get(n, ()), *stats)
        rows = add_rolling(rows, series.over(), rolling, spec.rolling_name)
        one = F.lag(TARGET, 1).over(w)
        if profile == "train":
            held = spec.rolling_name(LOAD, "count", spec.variability_rows)
            std = F.col(spec.rolling_name(LOAD, "std", spec.variability_rows))
            rows = rows.withColumns(
                {
                    "carbon_change_1h": F.coalesce(F.col(TARGET) - one, F.lit(0.0)),
                    "load_variability": F.when(F.col(held) == spec.variability_rows, std).otherwise(0.0),
                }
            ).drop(held)
        else:
            rows = rows.withColumn("carbon_change_1h", F.col(TARGET) - one)
        return _fill_ahead(rows, series.over(), spec) if ahead else rows

    forward = spec.reach if ahead else 0
    sized = replace(series, chunk_steps=max(series.chunk_steps, 4 * (spec.reach + forward)))
    windowed_rows = in_chunks(df, sized, spec.reach, forward, windowed, keep_chunk=fill == "general")
    if fill == "general":
        # The fill reads its input twice, for the rows and for the edges of their chunks.
        windowed_rows = written(windowed_rows, "windowed")
    present = windowed_rows.columns
    interactions = {k: v for k, v in interaction_columns(present, profile).items() if k not in present}
    features = add_calendar(windowed_rows, profile, series.time).withColumns(interactions)
    if fill == "none":
        return features
    complete = set(calendar.temporal_columns(F.lit(None), profile)) | set(calendar.cyclic_columns(F.lit(None), profile))
    nullable = [c for c in numeric_columns(features) if c not in complete and c not in ("_chunk", *series.keys)]
    if fill == "general":
        if profile == "serve":
            return fill_nulls(features, sized, nullable, ("forward", "backward"))
        return fill_nulls(features, sized, nullable, ("backward", "forward"), 0.0)
    if profile == "serve" and ahead:
        return features
    return features.fillna(0, subset=nullable)


def profile_skew(train: DataFrame, serve: DataFrame) -> DataFrame:
    """Which feature columns only one profile has, and which differ in type."""
    left = {f.name: f.dataType.simpleString() for f in train.schema.fields}
    right = {f.name: f.dataType.simpleString() for f in serve.schema.fields}
    rows = []
    for name in sorted(left.keys() | right.keys()):
        if name not in right:
            status = "train only"
        elif name not in left:
            status = "serve only"
        else:
            status = "same type" if left[name] == right[name] else "type differs"
        rows.append((name, left.get(name), right.get(name), status))
    return train.sparkSession.createDataFrame(rows, "feature string, train_type string, serve_type string, status string")


@dataclass(frozen=True)
class FeatureColumns:
    """Column choice for a model matrix."""

    excluded: tuple[str, ...] = (
        TARGET,
        "datetime",
        "zone",
        "aws_region",
        "gcp_region",
        "azure_region",
        "season",
        *map(target_name, TARGET_HORIZONS),
    )
    categories: Mapping[str, Sequence[str]] = field(default_factory=dict)

    def choose(self, df: DataFrame) -> list[str]:
        """Numeric columns that are not excluded, by name, with the one-hot columns."""
        hot = [f"{c}_{v}" for c, values in self.categories.items() for v in values]
        return sorted({c for c in numeric_columns(df) if c not in self.excluded} | set(hot))


def one_hot(df: DataFrame, column: str, values: Sequence[str]) -> DataFrame:
    """A 0/1 column ``<column>_<value>`` per listed value; the column itself goes."""
    hot = {f"{column}_{v}": F.coalesce((F.col(column) == v).cast("int"), F.lit(0)) for v in values}
    return df.withColumns(hot).drop(column)


def align_columns(df: DataFrame, expected: Sequence[str]) -> DataFrame:
    """Exactly the expected columns in order; missing ones are 0, text ones dropped to 0."""
    numeric = set(numeric_columns(df))
    return df.select(*[F.col(f"`{c}`") if c in numeric else F.lit(0).alias(c) for c in expected])


def common_columns(*tables: DataFrame) -> list[str]:
    return sorted(set.intersection(*[set(t.columns) for t in tables]))


def missing_columns(df: DataFrame, required: Sequence[str]) -> list[str]:
    return sorted(set(required) - set(df.columns))
