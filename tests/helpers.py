"""Comparison of Spark and DuckDB results."""

import duckdb
import pandas as pd

from factloom.session import TABLES


def connection(folder):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    return con


def moved(spark, run):
    """(rows, bytes) that the stages of ``run()`` shuffled, and the bytes that they spilled."""
    store, jvm = spark.sparkContext._jsc.sc().statusStore(), spark._jvm

    def stages():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        found = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
        return {(s.stageId(), s.attemptId()): s for s in (found.apply(i) for i in range(found.size()))}

    known = set(stages())
    run()
    new = [s for k, s in stages().items() if k not in known]
    return sum(s.shuffleWriteRecords() for s in new), sum(s.shuffleWriteBytes() for s in new), sum(s.diskBytesSpilled() for s in new)


def plain(value):
    if value is None or value is pd.NA or value is pd.NaT or (isinstance(value, float) and value != value):
        return "NULL"
    if isinstance(value, float):
        return repr(round(value, 6) + 0.0)
    if hasattr(value, "tolist"):
        value = value.tolist()
    return str(value)


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return list(frame.columns), sorted(tuple(map(plain, r)) for r in frame.itertuples(index=False))
