"""Runs a registered query and its SQL side by side."""

import math
import sys

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def normal(value):
    if value is None:
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return 0.0 if value == 0 else value
    if isinstance(value, int):
        return float(value)
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(normal(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, query, sf_dir):
    """None when equal, else a short text."""
    df = query.run(spark, sf_dir)
    ours = rows_of(df.columns, df.collect())
    if query.sql is None:
        return None if ours is not None else "no rows"
    cur = con.execute(query.sql)
    names = [d[0] for d in cur.description]
    theirs = rows_of(names, cur.fetchall())
    if sorted(names) != sorted(df.columns):
        return f"columns differ: {sorted(set(names) ^ set(df.columns))}"
    if len(ours) != len(theirs):
        return f"rows differ: {len(ours)} against {len(theirs)}; {ours[:1]} {theirs[:1]}"
    bad = [(a, b) for a, b in zip(ours, theirs) if a != b]
    if not ours:
        return "empty result"
    return f"{len(bad)} rows differ, first {bad[0]}" if bad else None


if __name__ == "__main__":
    import os
    import time

    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__  # noqa: F401
    from tidemark.plans.registry import REGISTRY
    from tidemark.session import build_session

    sf = sys.argv[1]
    wanted = sys.argv[2:]
    session = build_session(
        "check",
        master="local[8]",
        **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g", "spark.ui.enabled": "false"},
    )
    session.sparkContext.setLogLevel("ERROR")
    db = connect(f"/root/testdata/sf{sf}")
    failed = 0
    for name, q in REGISTRY.items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        t0 = time.time()
        try:
            problem = compare(session, db, q, f"/root/testdata/sf{sf}")
        except Exception as e:  # noqa: BLE001
            problem = f"{type(e).__name__}: {str(e)[:1500]}"
        failed += problem is not None
        print(f"\n{'ok ' if problem is None else 'BAD'} {name} {time.time() - t0:.2f}s {problem or ''}", flush=True)
    print("failed", failed)
