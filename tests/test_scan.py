"""Scans over ordered rows against plain loops; keys that fill most of the table, nulls, ties of time."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidewatch.operators import scan


def rows_of(seed, n, hot=0.5):
    r = random.Random(seed)
    out, us = [], 0
    for i in range(n):
        us += r.choice([0, 0, 1, 1, 2, 5, 40])
        key = "hot" if r.random() < hot else r.choice(["a", "b", None, "c"])
        out.append((key, us, i, r.choice([None, None, 1, 2, 3]), r.choice([None, "x", "y", "z"]), "clash"))
    return out


@pytest.fixture(scope="module", params=[(1, 600, 0.9, 40), (2, 300, 0.2, 4), (3, 40, 1.0, 40)])
def table(request, spark):
    seed, n, hot, parts = request.param
    rows = rows_of(seed, n, hot)
    df = spark.createDataFrame(rows, "k string, us long, row_id long, v long, s string, idx string").repartition(3)
    kept = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.execution.arrow.maxRecordsPerBatch")}
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)  # keys go on across batches
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield rows, df
    for k, v in kept.items():
        spark.conf.set(k, v)


def test_numbers(table):
    rows, df = table
    got = {x.row_id: x.idx for x in scan.numbers(df, "k", ["us", "row_id"]).collect()}
    seen, want = {}, {}
    for k, _, i, *_ in rows:
        want[i] = seen[k] = seen.get(k, -1) + 1
    assert got == want
    assert sorted(x.pos for x in scan.positions(df, ["us", "row_id"]).collect()) == list(range(len(rows)))


def test_running(table):
    rows, df = table
    out = scan.running(df, ["k"], ["us", "row_id"], sums={"n": F.lit(1), "t": F.col("v")}, gaps={"g": ("us", 4)}, lasts={"l": F.col("s"), "lv": F.col("v")}, befores={"b": F.col("s"), "u": F.col("us")})
    assert out.columns == ["k", "us", "row_id", "v", "s", "idx", "n", "t", "g", "l", "lv", "b", "u"]
    state = {}
    want = {}
    for k, us, i, v, s, _ in rows:
        n, t, g, last, lv, u = state.get(k, (0, 0, 0, None, None, None))
        before = last
        g += u is not None and us - u > 4
        n, t, last, lv = n + 1, t + (v or 0), s if s is not None else last, v if v is not None else lv
        want[i] = (n, t, g, last, lv, before, u)
        state[k] = (n, t, g, last, lv, us)
    assert {x.row_id: tuple(x)[6:] for x in out.collect()} == want


def run_numbers(rows, size, age):
    state, want = {}, {}
    for k, us, i, *_ in rows:
        seg, n, start = state.get(k, (0, 0, 0))
        start = us if n == 0 else start
        want[i], n = seg, n + 1
        state[k] = (seg + 1, 0, 0) if n >= size or us - start >= age else (seg, n, start)
    return want


@pytest.mark.parametrize("size, age, block", [(5, 20, 8), (1, 5, 4), (7, 60, 1 << 16), (16, 100, 16)])
def test_cuts(table, size, age, block):
    rows, df = table
    got = {x.row_id: x.seg for x in scan.cuts(df, "k", ["us", "row_id"], "us", size, age, block=block).collect()}
    assert got == run_numbers(rows, size, age)


def test_empty(spark):
    none = spark.createDataFrame([], "k string, us long, row_id long")
    assert scan.numbers(none, "k", ["us"]).count() == scan.running(none, ["k"], ["us"], sums={"n": F.lit(1)}).count() == scan.cuts(none, "k", ["us", "row_id"], "us", 5, 5).count() == 0


def test_next_starts_of_wide_times():
    us = np.array([0, 5, 1 << 61, (1 << 61) + 1, 3, 4], np.int64)
    new = np.array([True, False, False, False, True, False])
    assert scan._next_starts(np.arange(6), new, us, 3, 5).tolist() == [2, 3, 4, 4, 6, 6]


def test_changes_with_nulls():
    assert scan._changes(pa.array([None, None, "a", "a", None]), pa.scalar(None, pa.string())).tolist() == [False, False, True, False, True]
    with pytest.raises(ValueError):
        scan._changes(pa.array([1.0]), None)
