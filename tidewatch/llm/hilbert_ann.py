"""Approximate nearest neighbours on shifted space-filling curves.

Each of ``CURVES`` curves projects the vectors to ``DIMS`` random orthonormal directions, maps
each coordinate to (0, 1) by a logistic curve, shifts it by a random offset and takes the Hilbert
key. Spark range-partitions and sorts the keys, which gives every vector a rank on every curve. A
query is compared with all vectors whose rank on some curve lies within its window; the windows'
best are merged and ranked by the exact cosine.

The window is ``WINDOW`` ranks and a share of the rows (``SHARE``). Vectors without structure (here:
isotropic in 64 dimensions, a neighbour at cosine 0.4) are hardly nearer on a curve than others,
so a window of a fixed number of rows would lose recall as rows are added; with clustered vectors
a far smaller share does. Ranks are cut into blocks of ``BLOCK`` vectors. A query goes once to
each block that its window meets and is compared there with the vectors inside the window, so a
task holds one block and some queries, whatever the number of rows.

Equal vectors are one class: it is searched once and stands for its members with the smallest
ids, so a vector that makes up a third of all rows is one point on every curve.

Vectors keep single precision where the column has it, else they are doubles; all products are
taken in double precision.

Edge cases: vectors that are null, empty, zero, of another length than most (of equally frequent
ones the longest), or that hold a null or a non-finite component take no part; null ids take no
part; repeated rows count once; fewer candidates than asked for give fewer rows; an empty table
gives none. Columns other than the id and the vector are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from .common import materialize

CURVES = 24
DIMS, BITS = 8, 7
WINDOW = 24  # ranks of a window, besides its share of the rows
SHARE = 0.025
BLOCK = 8192
NEIGHBOURS = 5


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Position of each row of cell coordinates (each below 2 ** bits) on the Hilbert curve.

    Bit planes from the top: each plane reflects or swaps the lower bits of the axes, then the
    Gray code of what is left is undone; dims * bits is at most 63.
    """
    x = cells.T.astype(np.int64)  # [axis, row]
    dims = len(x)
    for plane in range(bits - 1, 0, -1):
        low = (1 << plane) - 1
        for axis in range(dims):
            flip = (x[axis] >> plane) & 1 == 1
            swap = np.where(flip, 0, (x[0] ^ x[axis]) & low)
            x[0] ^= np.where(flip, low, swap)
            x[axis] ^= swap
    for axis in range(1, dims):
        x[axis] ^= x[axis - 1]
    carry = np.zeros(x.shape[1], np.int64)
    for plane in range(bits - 1, 0, -1):
        carry ^= np.where((x[-1] >> plane) & 1 == 1, (1 << plane) - 1, 0)
    x ^= carry
    key = np.zeros(x.shape[1], np.int64)
    for plane in range(bits - 1, -1, -1):
        for axis in range(dims):
            key = (key << 1) | ((x[axis] >> plane) & 1)
    return key


class Curves:
    """The fixed random projections and shifts for vectors of one length."""

    def __init__(self, length: int, curves: int = CURVES, dims: int = DIMS, bits: int = BITS):
        rng = np.random.default_rng(20240919)
        dims = min(dims, length)
        self.axes = [np.linalg.qr(rng.normal(size=(length, dims)))[0] * math.sqrt(length) for _ in range(curves)]
        self.shifts, self.bits = rng.random((curves, dims)), bits

    def keys(self, unit: np.ndarray) -> np.ndarray:
        """[vector, curve] of unit vectors."""
        top = (1 << self.bits) - 1
        out = []
        for axes, shift in zip(self.axes, self.shifts):
            place = 1 / (1 + np.exp(-1.7 * (unit @ axes)))  # near the normal distribution's own curve
            out.append(hilbert_keys(np.minimum(((place + shift) / 2 * (top + 1)).astype(np.int64), top), self.bits))
        return np.stack(out, 1)


def _matrix(column) -> np.ndarray:
    """Rows of equal length of a list column, in double precision."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _scaled(v: np.ndarray) -> np.ndarray:
    """Rows times a power of two that brings their largest component near 1, so that no square leaves the doubles' range."""
    return np.ldexp(v, -np.frexp(np.abs(v).max(1, keepdims=True))[1]) if len(v) else v


def _valid(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    v = F.col(vector_col)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    single = isinstance(rows.schema[vector_col].dataType.elementType, FloatType)
    held = rows.select(F.col(id_col).cast("long").alias("vec_id"), (v if single else v.cast("array<double>")).alias("v"), fine.alias("ok"))
    return held.where("vec_id is not null and ok").select("vec_id", "v")


def _ranks(keys: DataFrame) -> DataFrame:
    """keys (curve, key, c1, c2) with each row's rank on its curve."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, curve_now, at = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            curves = batch.column(0).to_numpy()
            index = np.empty(len(curves), np.int64)
            for curve in np.unique(curves):
                own = np.flatnonzero(curves == curve)
                at = at if curve == curve_now else 0
                index[own] = np.arange(at, at + len(own))
                curve_now, at = curve, at + len(own)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(batch.column(i) for i in (2, 3)), pa.array(np.full(len(curves), part, np.int32)), pa.array(index)], ["curve", "c1", "c2", "part", "at"])

    ordered = keys.repartitionByRange("curve", "key", "c1", "c2").sortWithinPartitions("curve", "key", "c1", "c2")
    placed = materialize(ordered.mapInArrow(count, "curve int, c1 long, c2 long, part int, at long"), "ann-ranks")
    # one row a partition and curve
    before = placed.groupBy("curve", "part").agg(F.count("*").alias("n"))
    window = Window.partitionBy("curve").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = before.select("curve", "part", F.coalesce(F.sum("n").over(window), F.lit(0)).alias("first"))
    return placed.join(before, ["curve", "part"]).select("curve", "c1", "c2", (F.col("first") + F.col("at")).alias("rank"))


def _best_of_block(k: int, half: int):
    """The k nearest of each query among a block's vectors within ``half`` ranks; of equal scores those with the smaller ids."""
    columns = ("q1", "q2", "c1", "c2", "first_id", "score")

    def best(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({c: np.zeros(0, float if c == "score" else np.int64) for c in columns})]
        if not len(asked) or not len(held):
            return out[0]
        held, asked = held.sort_values("rank").reset_index(drop=True), asked.sort_values("q_rank").reset_index(drop=True)
        c, place, ids = _scaled(np.stack(held.v.to_numpy()).astype(np.float64)), held["rank"].to_numpy(), held.first_id.to_numpy()
        c1, c2, size = held.c1.to_numpy(), held.c2.to_numpy(), np.sqrt((c * c).sum(1))
        ranks, at = asked.q_rank.to_numpy(), 0
        while at < len(asked):
            # queries whose windows nearly coincide
            to = min(at + 64, int(np.searchsorted(ranks, ranks[at] + max(half // 2, 1), side="right")))
            lo, hi = np.searchsorted(place, ranks[at] - half), np.searchsorted(place, ranks[to - 1] + half, side="right")
            part, at = asked.iloc[at:to], to
            if lo == hi:
                continue
            q, mine = _scaled(np.stack(part.qv.to_numpy()).astype(np.float64)), part.q_rank.to_numpy()
            scores = (q @ c[lo:hi].T) / (np.sqrt((q * q).sum(1))[:, None] * size[lo:hi])
            q1, q2 = part.q1.to_numpy(), part.q2.to_numpy()
            scores[(np.abs(mine[:, None] - place[lo:hi]) > half) | ((q1[:, None] == c1[lo:hi]) & (q2[:, None] == c2[lo:hi]))] = -np.inf
            least = np.partition(scores, -k, 1)[:, -k] if hi - lo > k else np.full(len(q), -np.inf)
            row, j = np.nonzero((scores >= least[:, None]) & np.isfinite(scores))
            score, j = scores[row, j], j + lo
            order = np.lexsort((ids[j], -score, row))
            row, j, score = row[order], j[order], score[order]
            first = np.arange(len(row)) - np.searchsorted(row, row) < k
            row, j = row[first], j[first]
            out.append(pd.DataFrame(dict(zip(columns, (q1[row], q2[row], c1[j], c2[j], ids[j], score[first])))))
        return pd.concat(out)

    return best


def neighbours(rows: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = NEIGHBOURS, curves: int = CURVES, share: float = SHARE, window: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k nearest by cosine, among all other rows.

    ``is_query`` is a condition on ``vec_id``.
    """
    held = _valid(rows, id_col, vector_col)
    usual = held.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    if usual is None:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    lengths = usual.n
    held = held.where(F.size("v") == lengths).distinct().withColumns({"c1": F.xxhash64("v"), "c2": F.xxhash64(F.lit(1), "v")})
    held = materialize(held, "ann-vectors")
    # the k + 1 smallest ids of each class: a query leaves itself out
    first = Window.partitionBy("c1", "c2").orderBy("vec_id")
    members = held.select("vec_id", "c1", "c2").withColumn("n", F.row_number().over(first)).where(F.col("n") <= k + 1)
    members = materialize(members, "ann-members")
    reps = held.join(members.where("n = 1").select("vec_id", "c1", "c2"), ["vec_id", "c1", "c2"], "left_semi")
    reps = materialize(reps.withColumnRenamed("vec_id", "first_id"), "ann-classes")
    maps = rows.sparkSession.sparkContext.broadcast(Curves(lengths, curves))

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            v = _scaled(_matrix(batch.column(0)))
            keys = maps.value.keys(v / np.sqrt((v * v).sum(1))[:, None])
            number = np.tile(np.arange(keys.shape[1], dtype=np.int32), len(keys))
            yield pa.RecordBatch.from_arrays([pa.array(number), pa.array(keys.reshape(-1)), *(pa.array(np.repeat(batch.column(i).to_numpy(), keys.shape[1])) for i in (1, 2))], ["curve", "key", "c1", "c2"])

    ranks = _ranks(reps.select("v", "c1", "c2").mapInArrow(keyed, "curve int, key long, c1 long, c2 long"))
    half = math.ceil((window + share * reps.count()) / 2)
    asked = held.where(is_query)
    candidates = ranks.join(reps, ["c1", "c2"]).select("curve", F.expr(f"`rank` div {block}").alias("block"), "rank", "c1", "c2", "first_id", "v")
    visits = ranks.join(asked.select("c1", "c2").distinct(), ["c1", "c2"], "left_semi").join(reps.select("c1", "c2", "v"), ["c1", "c2"])
    visits = visits.withColumn("block", F.explode(F.sequence(F.expr(f"greatest(`rank` - {half}, 0) div {block}"), F.expr(f"(`rank` + {half}) div {block}"))))
    visits = visits.select(F.col("curve").alias("q_curve"), F.col("block").alias("q_block"), F.col("rank").alias("q_rank"), F.col("c1").alias("q1"), F.col("c2").alias("q2"), F.col("v").alias("qv"))
    best = visits.groupBy("q_curve", "q_block").cogroup(candidates.groupBy("curve", "block"))
    best = best.applyInPandas(_best_of_block(k, half), "q1 long, q2 long, c1 long, c2 long, first_id long, score double")
    # one pair met on several curves has one score up to rounding
    best = best.groupBy("q1", "q2", "c1", "c2", "first_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("q1", "q2").orderBy(F.desc("score"), "first_id")
    best = best.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k).drop("n", "first_id")

    size = F.pow(F.lit(2.0), F.floor(F.log2(F.array_max(F.transform("v", lambda x: F.abs(x.cast("double")))))))
    square = F.aggregate(F.transform("v", lambda x: x.cast("double") / size), F.lit(0.0), lambda a, x: a + x * x)
    own = asked.select("vec_id", F.col("c1").alias("q1"), F.col("c2").alias("q2"), "v").distinct()
    same = own.select(F.col("vec_id").alias("query_id"), F.col("q1").alias("c1"), F.col("q2").alias("c2"), (square / (F.sqrt(square) * F.sqrt(square))).alias("score"))
    found = own.select(F.col("vec_id").alias("query_id"), "q1", "q2").join(best, ["q1", "q2"]).select("query_id", "c1", "c2", "score").unionByName(same)
    found = found.join(members.select("vec_id", "c1", "c2"), ["c1", "c2"]).where("vec_id != query_id")
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op4_hilbert_ann(spark, sf_dir: str) -> DataFrame:
    return neighbours(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0)
