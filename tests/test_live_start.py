"""A live stream that starts from the hours of a batch table, and late samples of an alert stream."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.streaming import alerts, live


def hours(spark, first, last):
    i = F.col("id")
    rows = spark.range(first, last).select(F.explode(F.array(F.lit("a"), F.lit("b"))).alias("zone"), "id")
    return rows.filter("zone = 'a' OR id % 5 <> 0").select(
        "zone", F.timestamp_seconds(i * 3600).alias("datetime"), (i * 7919 % 101 + F.length("zone")).cast("double").alias("value")
    )


def test_only_the_last_hours_are_kept(spark):
    table = hours(spark, 0, 1000).unionByName(spark.sql("SELECT 'c' AS zone, timestamp '1970-01-02' AS datetime, CAST(null AS double) AS value"))
    kept = {r.zone: (r.n, r.first) for r in live.kept_hours(table).groupBy("zone").agg(F.count("*").alias("n"), F.min(F.unix_seconds("datetime") / 3600).alias("first")).collect()}
    assert kept["a"] == (live.HISTORY_HOURS, 1000 - live.HISTORY_HOURS) and set(kept) == {"a", "b"}


def test_rows_equal_those_of_the_whole_series(spark, tmp_path):
    late = "(id = 398 OR id >= 400)"
    whole = hours(spark, 0, 430).withColumn("id", (F.unix_seconds("datetime") / 3600).cast("long"))
    whole.filter(f"NOT {late}").drop("id").write.parquet(str(tmp_path / "history"))
    whole.filter(late).drop("id").write.parquet(str(tmp_path / "hours"))
    schema = "zone string, datetime timestamp, value double"

    def run(history):
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "hours"))
        found = live.live_features(stream, history).writeStream.foreachBatch(lambda b, n: b.write.mode("overwrite").parquet(str(tmp_path / f"table/batch={n}")))
        found.outputMode("update").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
        return live.newest_rows(spark.read.parquet(str(tmp_path / "table"))).toPandas()

    got = run(spark.read.schema(schema).parquet(str(tmp_path / "history")))
    plain = whole.toPandas()
    for zone in ("a", "b"):
        known = plain[plain.zone == zone].set_index("id").value.to_dict()
        wanted = [h for h in sorted(known) if h >= 398]
        expected = live.feature_rows(known, wanted).reset_index(drop=True)
        part = got[got.zone == zone].sort_values("datetime").reset_index(drop=True)
        assert len(part) == len(expected)
        for c in expected.columns:
            assert part[c].tolist() == pytest.approx(expected[c].tolist(), nan_ok=True), c


def test_late_samples_are_told_and_change_no_run(spark, tmp_path):
    schema = "k string, ts timestamp, value double"
    batches = [[(0, 9.0), (60, 9.0), (120, 1.0), (900, 1.0)], [(30, 1.0), (950, 1.0)]]
    for n, batch in enumerate(batches):
        rows = spark.createDataFrame([("a", at, v) for at, v in batch], "k string, at long, value double")
        rows.select("k", F.timestamp_seconds("at").alias("ts"), "value").write.mode("append").parquet(str(tmp_path / "samples"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "samples"))
        found = alerts.held_intervals(stream, "k", F.col("value") > 5, 60, 300)
        writer = found.writeStream.outputMode("append").option("checkpointLocation", str(tmp_path / "state"))
        writer.format("parquet").option("path", str(tmp_path / "out")).trigger(availableNow=True).start().awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).select(F.unix_seconds("started_at"), F.unix_seconds("last_seen"), "worst_value", "status")
    assert sorted(map(tuple, got.collect())) == [(0, 60, 9.0, "held"), (30, 30, 1.0, "late")]


class Kept:
    """Keyed state of one key in memory, which counts its calls."""

    def __init__(self):
        self.rows, self.one, self.calls = {}, None, 0

    def getMapState(self, *_):
        return self

    def getValueState(self, *_):
        return Kept()

    def iterator(self):
        return iter(list(self.rows.items()))

    def updateValue(self, key, value):
        self.rows[key], self.calls = value, self.calls + 1

    def removeKey(self, key):
        self.calls += 1
        del self.rows[key]

    def exists(self):
        return self.one is not None

    def get(self):
        return self.one

    def update(self, value):
        self.one = value


def plain_intervals(batches, hold, delay):
    """Late samples and held runs of batches of samples, one sample at a time."""
    waiting, judged, run, out = {}, None, [], []
    for batch in batches:
        newest = max([*waiting, *(s[0] for s in batch), *([] if judged is None else [judged])])
        late = [s for s in batch if judged is not None and s[0] <= judged]
        out += [(at, at, value, "late") for at, value, _ in late]
        waiting |= {at: (value, bad) for at, value, bad in batch if judged is None or at > judged}
        for at in sorted(t for t in waiting if t <= newest - delay):
            value, bad = waiting.pop(at)
            judged = at
            if bad:
                run.append((at, value))
            elif run:
                worst = run[0][1]
                for _, v in run:
                    worst = max(worst, v)
                if run[-1][0] - run[0][0] >= hold:
                    out.append((run[0][0], run[-1][0], worst, "held"))
                run = []
    return out, waiting


def held(batches, hold, delay, rows_at_once=7):
    state = Kept()
    processor = alerts.HeldCondition(hold, delay)
    processor.init(state)
    out = []
    for batch in batches:
        table = pd.DataFrame([(at * alerts.MICROS, v, b) for at, v, b in batch], columns=["at", "value", "bad"])
        frames = [table[i : i + rows_at_once] for i in range(0, len(table), rows_at_once)]
        for found in processor.handleInputRows(("a",), iter(frames), None):
            assert list(found.columns) == ["key", "started_at", "last_seen", "worst_value", "status"] and set(found["key"]) == {"a"}
            times = [found[c].astype("int64" if str(found[c].dtype) == "int64" else "datetime64[s]").astype("int64") for c in ("started_at", "last_seen")]
            out += list(zip(*times, found["worst_value"], found["status"]))
    return out, state


def test_runs_equal_those_judged_one_sample_at_a_time():
    rng = random.Random(3)
    for trial in range(60):
        batches = []
        for n in range(rng.randint(1, 6)):
            samples = [(rng.randint(-50, 50) + 60 * n, rng.choice([rng.randint(0, 9) * 1.0, float("nan")])) for _ in range(rng.randint(1, 60))]
            batches.append([(at, v, rng.random() < 0.7) for at, v in samples])
        got, state = held(batches, 3, 20)
        want, waiting = plain_intervals(batches, 3, 20)
        assert repr(got) == repr([(a, b, float(w), s) for a, b, w, s in want])
        assert repr(sorted(state.rows.items())) == repr(sorted(((t * alerts.MICROS,), x) for t, x in waiting.items()))


def test_state_is_written_for_waiting_samples_only():
    batch = [(at, at % 9 * 1.0, at % 5 > 0) for at in range(20_000)]
    _, state = held([batch, [(30_000, 1.0, False)]], 3, 100, 1000)
    assert len(state.rows) == 1 and state.calls <= 2 * 100 + 1
