"""Scans over ordered rows that no single task sees all of: positions, running values, cuts by count or age.

Rows are range-partitioned by key and order, so a key with most of the rows spreads over as many
partitions as its rows fill. Each partition works alone; what it hands to the next is one small row
(counts, last values), and those are combined over the partitions, not over the rows. Only a
partition's first key can have begun before, so only its rows are amended.

Edge cases: null keys are a key of their own; equal places are ordered as Spark's sort leaves them,
so the order should be total; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.plans.tables import materialize

ROW_BITS = 33  # of a monotonically increasing id, below the partition's number
BLOCK = 1 << 16


def _placed(rows: DataFrame, by: list[str]) -> DataFrame:
    return rows.repartitionByRange(*by).sortWithinPartitions(*by)


def positions(rows: DataFrame, by: list[str], out: str = "pos") -> DataFrame:
    """``rows`` with their position in the order, from 0, over the whole table. One range shuffle, all in the JVM."""
    held = materialize(_placed(rows, by).withColumn("_at", F.monotonically_increasing_id()), "positions")
    part = F.shiftright("_at", ROW_BITS).alias("_part")
    ends = held.groupBy(part).agg(F.count("*").alias("_n"))
    before = ends.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))  # a row a partition
    numbered = held.withColumn("_part", F.shiftright("_at", ROW_BITS)).join(F.broadcast(before), "_part")
    return numbered.withColumn(out, F.col("_at").bitwiseAND((1 << ROW_BITS) - 1) + F.col("_before")).drop("_at", "_part", "_before")


def numbers(rows: DataFrame, key: str, order: list[str], out: str = "idx") -> DataFrame:
    """``rows`` with their number in their key's order, from 0."""
    placed = positions(rows, [key, *order], "_pos")
    first = placed.groupBy(F.col(key).alias("_k")).agg(F.min("_pos").alias("_first"))
    return placed.join(first, F.col(key).eqNullSafe(F.col("_k"))).withColumn(out, F.col("_pos") - F.col("_first")).select(*(c for c in rows.columns if c != out), out)


def _changes(column: pa.Array, last: pa.Scalar | None) -> np.ndarray:
    """Where a column differs from the row before; ``last`` is the row before the first, None if there is none."""
    if pa.types.is_floating(column.type):
        raise ValueError("keys of a scan are no floats")
    same = np.zeros(len(column), bool)
    if len(column) > 1:
        a, b = column[1:], column[:-1]
        alike = pc.fill_null(pc.equal(a, b), False).to_numpy(zero_copy_only=False)
        same[1:] = alike | (a.is_null().to_numpy(zero_copy_only=False) & b.is_null().to_numpy(zero_copy_only=False))
    if last is not None:
        same[0] = column[0].as_py() == last.as_py()
    return ~same


def _local(keys: list[str], sums: dict[str, str], gaps: dict[str, tuple[str, int]], lasts: dict[str, str], befores: dict[str, str]):
    """A sorted partition's own values, and marks for what is amended later."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, key, head, seen = TaskContext.get().partitionId(), [None] * len(keys), True, 0
        total = dict.fromkeys([*sums, *gaps], 0)
        held: dict[str, pa.Scalar | None] = dict.fromkeys([*lasts, *befores, *gaps])
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            get = lambda c: batch.column(batch.schema.get_field_index(c))
            new = reduce(np.logical_or, (_changes(get(c), last) for c, last in zip(keys, key)))
            start = np.maximum.accumulate(np.where(new, np.arange(n), 0))  # 0 as well for rows of the key before
            carried = ~np.logical_or.accumulate(new)
            made: dict[str, pa.Array] = {}
            for out, column in lasts.items() | befores.items():
                values = get(column)
                at = np.maximum.accumulate(np.where(values.is_valid().to_numpy(zero_copy_only=False), np.arange(n), -1))
                end = at.copy()
                if out in befores:
                    at = np.concatenate([[-1], at[:-1]])
                known = at >= start
                taken = values.take(pa.array(np.where(known, at, 0), mask=~known))
                if held[out] is not None:
                    taken = pc.if_else(pa.array(carried & ~known), held[out], taken)
                made[out] = taken
                held[out] = values[int(end[-1])] if end[-1] >= start[-1] else held[out] if carried[-1] else None
            for out, (column, limit) in gaps.items():
                values = get(column).to_numpy(zero_copy_only=False)
                step = np.concatenate([[0], np.diff(values) > limit]).astype(np.int64)
                step[new] = 0
                if carried[0] and held[out] is not None:
                    step[0] = values[0] - held[out].as_py() > limit
                held[out] = get(column)[n - 1]
                made[out] = (step, total)
            for out, column in sums.items():
                made[out] = (get(column).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), total)
            for out in [*gaps, *sums]:
                run = np.cumsum(made[out][0])
                run = run - np.where(carried, -total[out], run[start] - made[out][0][start])
                total[out] = int(run[-1])
                made[out] = pa.array(run)
            is_head = carried if not seen else carried & head
            if not seen:
                is_head = ~np.logical_or.accumulate(np.concatenate([[False], new[1:]]))
            head, seen = bool(is_head[-1]), seen + n
            key = [get(c)[n - 1] for c in keys]
            names = [*sums, *gaps, *lasts, *befores]
            columns = [*batch.columns, *(made[c] for c in names), pa.array(is_head), pa.array(np.full(n, part, np.int32)), pa.array(np.arange(seen - n, seen))]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, *names, "_head", "_part", "_at"])

    return task


def running(rows: DataFrame, keys: list[str], order: list[str], sums: dict[str, Column] | None = None, gaps: dict[str, tuple[str, int]] | None = None, lasts: dict[str, Column] | None = None, befores: dict[str, Column] | None = None) -> DataFrame:
    """``rows`` with running values of their key, by name: all in one range shuffle.

    sums: the sum so far of a whole number, this row's included, null as 0. gaps: how often so far a
    column (whole numbers without nulls) was more than a limit above the row before. lasts and
    befores: the last value that is not null, with and without this row.
    """
    sums, gaps, lasts, befores = sums or {}, gaps or {}, lasts or {}, befores or {}
    staged = rows.withColumns({f"_in_{k}": v.cast("long") for k, v in sums.items()} | {f"_in_{k}": v for k, v in (lasts | befores).items()})
    kinds = {f.name: f.dataType for f in staged.schema}
    made = [T.StructField(k, T.LongType()) for k in (*sums, *gaps)] + [T.StructField(k, kinds[f"_in_{k}"]) for k in (*lasts, *befores)]
    schema = T.StructType([*staged.schema.fields, *made, T.StructField("_head", T.BooleanType()), T.StructField("_part", T.IntegerType()), T.StructField("_at", T.LongType())])
    inner = lambda names: {k: f"_in_{k}" for k in names}
    held = materialize(_placed(staged, [*keys, *order]).mapInArrow(_local(keys, inner(sums), gaps, inner(lasts), inner(befores)), schema), "running")

    # one row a partition: its first key, and its last key's values
    at, whole = F.col("_at"), F.every("_head").alias("_whole")
    key = F.struct(*keys)
    tails = [F.max_by(k, at).alias(f"_t_{k}") for k in (*sums, *gaps)] + [F.max_by(F.struct((F.coalesce(f"_in_{k}", k) if k in befores else F.col(k)).alias("v")), at).alias(f"_t_{k}") for k in (*lasts, *befores)]
    limits = [x for k, (c, _) in gaps.items() for x in (F.min_by(c, at).alias(f"_a_{k}"), F.max_by(c, at).alias(f"_z_{k}"))]
    edges = held.groupBy("_part").agg(F.min_by(key, at).alias("_first"), F.max_by(key, at).alias("_last"), whole, *tails, *limits)
    parts = Window.orderBy("_part")
    edges = edges.withColumn("_goes_on", F.coalesce(F.lag("_last").over(parts).eqNullSafe(F.col("_first")) & F.lag("_part").over(parts).isNotNull(), F.lit(False)))
    through = F.col("_whole") & F.col("_goes_on")
    edges = edges.withColumn("_chain", F.sum((~through).cast("int")).over(parts))
    for k, (_, limit) in gaps.items():
        step = F.coalesce((F.col("_goes_on") & (F.col(f"_a_{k}") - F.lag(f"_z_{k}").over(parts) > limit)).cast("long"), F.lit(0).cast("long"))
        edges = edges.withColumn(f"_b_{k}", step).withColumn(f"_t_{k}", F.col(f"_t_{k}") + F.when(through, F.col(f"_b_{k}")).otherwise(0))
    chain = Window.partitionBy("_chain").orderBy("_part")
    so_far = {k: F.sum(f"_t_{k}").over(chain) for k in (*sums, *gaps)} | {k: F.last(f"_t_{k}.v", ignorenulls=True).over(chain) for k in (*lasts, *befores)}
    edges = edges.withColumns({f"_s_{k}": v for k, v in so_far.items()})
    carry = {k: F.lag(f"_s_{k}").over(parts) + (F.col(f"_b_{k}") if k in gaps else F.lit(0)) for k in (*sums, *gaps)} | {k: F.lag(f"_s_{k}").over(parts) for k in (*lasts, *befores)}
    carried = edges.select("_part", "_goes_on", *(v.alias(f"_c_{k}") for k, v in carry.items())).where("_goes_on").drop("_goes_on")

    amended = held.join(F.broadcast(carried), "_part", "left")
    out = {k: F.when(F.col("_head"), F.col(k) + F.coalesce(f"_c_{k}", F.lit(0))).otherwise(F.col(k)) for k in (*sums, *gaps)}
    out |= {k: F.when(F.col("_head"), F.coalesce(k, f"_c_{k}")).otherwise(F.col(k)) for k in (*lasts, *befores)}
    return amended.withColumns(out).select(*(c for c in rows.columns if c not in out), *out)


def _next_starts(pos: np.ndarray, new: np.ndarray, us: np.ndarray, size: int, age: int) -> np.ndarray:
    """For each row the position at which the next run begins if one begins here.

    Rows lie in a row, ``size`` rows beyond the last one that is asked for, or to the table's end.
    """
    n = len(pos)
    key = np.cumsum(new)
    ends = np.append(np.flatnonzero(new), n)  # where each key begins
    end = ends[np.searchsorted(ends, np.arange(n), side="right")]
    # the first row of a key that is old enough: places in the order of (key, time)
    base = int(us.min())
    span = int(us.max()) - base + 1
    if int(key[-1] + 1) * (span + age) < 1 << 62:
        old = np.searchsorted(key * (span + age) + (us - base), key * (span + age) + (us - base) + age, side="left")
    else:  # too wide for one number: key by key
        first = np.flatnonzero(np.append([True], key[1:] != key[:-1]))
        old = np.concatenate([a + np.searchsorted(us[a:b], us[a:b] + age, side="left") for a, b in zip(first, np.append(first[1:], n))])
    return pos[0] + np.minimum(np.minimum(np.arange(n) + size, old + 1), end)


def _path(follow: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Rows that are reached from any of ``begins``; ``follow`` has len(follow) for what lies beyond. By doubling."""
    n = len(follow)
    on, jump = np.zeros(n + 1, bool), np.append(np.minimum(follow, n), n)
    on[begins] = True
    while (jump[:n] < n).any():
        on[jump[on]] = True
        jump = jump[jump]
    on[jump[on]] = True
    return on[:n]


def _exits(follow: np.ndarray, core: int) -> np.ndarray:
    """Where the chain from each of the first ``core`` rows leaves these rows, as places among all rows."""
    out = follow[:core].copy()
    while (inside := out < core).any():
        out[inside] = out[out[inside]]
    return out


def cuts(rows: DataFrame, key: str, order: list[str], us: str, size: int, age: int, out: str = "seg", block: int = BLOCK) -> DataFrame:
    """``rows`` with the number of their run in their key: a run closes with its ``size``-th row, or with the first that is ``age`` or more after its first.

    Where a run begins depends on all runs before it. Each row's next beginning, if a run began
    there, is a search in its block and the ``size`` rows after it. Blocks have a fixed number of
    rows of the whole order, whatever the keys, so no key is one task. A block with a key's first
    row leaves for the next at one place, whatever came before; another maps the places at which
    it may be entered to those at which it is left, and such maps are composed by doubling, so that
    k blocks of one key take log2(k) rounds. Then each block marks its beginnings.
    """
    block = max(block, size)
    placed = materialize(positions(rows, [key, *order], "_pos"), "cuts")
    narrow = placed.select("_pos", F.col(key).alias("_k"), F.col(us).cast("long").alias("_us"))
    own = F.floor(F.col("_pos") / block).cast("long")
    # the row before, to see a key begin, and the rows after, to look ahead
    to = F.array_distinct(F.array(own, F.floor((F.col("_pos") + 1) / block).cast("long"), F.greatest(F.floor((F.col("_pos") - size) / block).cast("long"), F.lit(0).cast("long"))))
    dealt = narrow.withColumn("_block", F.explode(to))

    def read(table: pa.Table) -> tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
        """(block, positions, whether a key begins, next beginnings as places, and the number of the block's own rows)."""
        table = table.sort_by("_pos").combine_chunks()
        b = table.column("_block")[0].as_py()
        pos, times = table.column("_pos").to_numpy(), table.column("_us").to_numpy()
        keys = table.column("_k").combine_chunks()
        keys = pa.concat_arrays(keys.chunks) if isinstance(keys, pa.ChunkedArray) else keys
        new = _changes(keys, None)
        skip = int(pos[0] < b * block)
        pos, times, new = pos[skip:], times[skip:], new[skip:]
        follow = _next_starts(pos, new, times, size, age) - (pos[0] if len(pos) else 0) if len(pos) else np.zeros(0, np.int64)
        return b, pos, new, follow, int((pos < (b + 1) * block).sum())

    def leave(table: pa.Table) -> pa.Table:
        b, pos, new, follow, core = read(table)
        if not core:
            return pa.table({"_block": pa.array([], pa.int64()), "_exits": pa.array([], pa.list_(pa.int64()))})
        begins = np.flatnonzero(new[:core])
        places = _exits(follow, core)
        found = places[begins[-1:]] if len(begins) else places[:size]
        return pa.table({"_block": pa.array([b], pa.int64()), "_exits": pa.array([(found - core).tolist()], pa.list_(pa.int64()))})

    # _exits: one place in the next block, or one for each place of entry
    maps = materialize(dealt.groupBy("_block").applyInArrow(leave, "_block long, _exits array<long>"), "cuts-maps")
    after = maps.select((F.col("_block") + 1).alias("_block"), F.col("_block").alias("_from"), "_exits")
    entry = after.where(F.size("_exits") == 1).select("_block", F.col("_exits")[0].alias("_entry"))
    if size > 1:
        waiting = materialize(after.where(F.size("_exits") > 1), "cuts-waiting")
        while not waiting.isEmpty():
            told = waiting.join(entry.select(F.col("_block").alias("_from"), "_entry"), "_from", "left")
            solved = told.where("_entry is not null").select("_block", F.get("_exits", F.col("_entry").cast("int")).alias("_entry"))
            left = told.where("_entry is null").drop("_entry")
            inner = waiting.select(F.col("_block").alias("_from"), F.col("_from").alias("_far"), F.col("_exits").alias("_inner"))
            further = left.join(inner, "_from").select("_block", F.col("_far").alias("_from"), F.transform("_inner", lambda x: F.get("_exits", x.cast("int"))).alias("_exits"))
            entry, waiting = materialize(entry.unionByName(solved), "cuts-entries"), materialize(further, "cuts-waiting")

    def mark(_, rows_of: pa.Table, entries: pa.Table) -> pa.Table:
        empty = {"_pos": pa.array([], pa.int64()), "_begins": pa.array([], pa.int64())}
        if not rows_of.num_rows:
            return pa.table(empty)
        _, pos, new, follow, core = read(rows_of)
        begins = np.flatnonzero(new[:core])
        if entries.num_rows:
            begins = np.append(begins, min(entries.column("_entry")[0].as_py(), core))
        on = _path(np.minimum(follow[:core], core), begins[begins < core])
        return pa.table({"_pos": pos[:core], "_begins": np.cumsum(on)})

    marked = materialize(dealt.groupBy("_block").cogroup(entry.groupBy("_block")).applyInArrow(mark, "_pos long, _begins long"), "cuts-marks")
    total = marked.groupBy(F.floor(F.col("_pos") / block).cast("long").alias("_block")).agg(F.max("_begins").alias("_n"))
    offset = total.select("_block", (F.sum("_n").over(Window.orderBy("_block")) - F.col("_n")).alias("_before"))  # a row a block
    ranked = placed.join(marked, "_pos").withColumn("_block", own).join(offset, "_block").withColumn("_rank", F.col("_begins") + F.col("_before"))
    first = ranked.groupBy(F.col(key).alias("_k")).agg(F.min("_rank").alias("_first"))
    return ranked.join(first, F.col(key).eqNullSafe(F.col("_k"))).withColumn(out, F.col("_rank") - F.col("_first")).select(*(c for c in rows.columns if c != out), out)
