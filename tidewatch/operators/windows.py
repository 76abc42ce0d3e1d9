"""Per-session order: numbers, first contacts, bursts, provenance, segments, lineage."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.operators import scan

ORDER = ("us", "row_id")


def numbered(events: DataFrame) -> DataFrame:
    """``events`` with idx, from 0 in each session, one namespace for all origins."""
    return scan.numbers(events, "session", list(ORDER))


def first_contacts(events: DataFrame, key: Column) -> DataFrame:
    """The first event of each (session, key); an empty or null key is none. Partial aggregation, no sort."""
    rows = events.withColumn("contact", key).where("contact is not null and contact != ''")
    first = rows.groupBy("session", "contact").agg(F.min_by(F.struct(*events.columns), F.struct(*ORDER)).alias("e"))
    return first.select("contact", "e.*")


def bursts(events: DataFrame, cls: Column, window_us: int = 1_000_000, threshold: int = 200) -> DataFrame:
    """Events at which a class's count within the window reaches the threshold, once a burst.

    The count holds the event and those before it that are later than its time minus the window.
    It fires when the count reaches the threshold from below and is armed again once it falls
    under it. Each event comes and, a window later, goes: the count is a running sum over both, so
    a busy session and class spreads over tasks.
    """
    rows = events.withColumn("burst_class", cls).where("burst_class is not null")
    came = rows.select("*", F.col("us").alias("_us"), F.lit(1).alias("_step"))
    # at equal times those that go are gone
    went = rows.select(*(F.col(c) if c in ("session", "burst_class", "row_id") else F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in rows.columns), (F.col("us") + window_us).alias("_us"), F.lit(-1).alias("_step"))
    keys = ["session", "burst_class"]
    counted = scan.running(came.unionByName(went), keys, ["_us", "_step", "row_id"], sums={"n": F.col("_step")}).where("_step = 1").drop("_us", "_step")
    before = scan.running(counted, keys, list(ORDER), befores={"_before": F.col("n")})
    return before.where((F.col("n") >= threshold) & (F.coalesce("_before", F.lit(0)) < threshold)).drop("_before")


def provenance(execs: DataFrame, path: str = "path", digest: str = "digest") -> DataFrame:
    """``execs`` with a digest, with exe_first_seen and exe_changed in their session."""
    same = Window.partitionBy("session", path, digest).orderBy(*ORDER)
    of_path = Window.partitionBy("session", path).orderBy(*ORDER)
    rows = execs.where(F.col(digest).isNotNull())
    before = F.lag(digest).over(of_path)
    return rows.withColumn("exe_first_seen", F.row_number().over(same) == 1).withColumn("exe_changed", F.coalesce(before != F.col(digest), F.lit(False)))


def owners(events: DataFrame, is_exec: Column, uid: str = "uid") -> DataFrame:
    """``events`` with owner_uid: that of the session's most recent exec, null before the first."""
    return scan.running(events, ["session"], list(ORDER), lasts={"owner_uid": F.when(is_exec, F.col(uid))})


def count_segments(events: DataFrame, size: int = 4096) -> DataFrame:
    """``events`` with seg by count alone."""
    return scan.numbers(events, "session", list(ORDER), "seg").withColumn("seg", F.floor(F.col("seg") / size).cast("long"))


def segments(events: DataFrame, size: int = 4096, age_us: int = 60_000_000) -> DataFrame:
    """``events`` with seg: a run closes with its ``size``-th event, or with the first that is ``age_us`` or more after its first."""
    return scan.cuts(events, "session", list(ORDER), "us", size, age_us)


def settled_changes(observations: DataFrame) -> DataFrame:
    """File changes from scans (path, scan_no, mtime, size, digest): a file is settled in a scan that equals the one before.

    A stability run gives one digest; a change is one that differs from the last settled digest of
    the same unbroken series of scans. A scan without the path ends the series.
    """
    by_path = Window.partitionBy("path").orderBy("scan_no")
    rows = observations.withColumn("_new", F.coalesce(F.col("scan_no") - F.lag("scan_no").over(by_path) != 1, F.lit(True)).cast("int"))
    rows = rows.withColumn("_island", F.sum("_new").over(by_path))
    series = Window.partitionBy("path", "_island").orderBy("scan_no")
    still = (F.lag("mtime").over(series) == F.col("mtime")) & (F.lag("size").over(series) == F.col("size"))
    settled = rows.withColumn("_still", still).where("_still")
    prev = F.lag("digest").over(series)
    out = settled.withColumn("prev_digest", prev).withColumn("size_delta", F.col("size") - F.coalesce(F.lag("size").over(series), F.lit(0)))
    return out.where("prev_digest is null or prev_digest != digest").drop("_new", "_island", "_still")


def inferred_clusters(events: DataFrame, gap_us: int) -> DataFrame:
    """``events`` with cluster, a number that grows at each pause longer than the gap."""
    return scan.running(events, ["session"], list(ORDER), gaps={"cluster": ("us", gap_us)})


def inferred_runs(events: DataFrame, processes: DataFrame, gap_us: int) -> DataFrame:
    """``events`` (session, us, row_id, pid) with root, cluster and label: what seems to belong together where nothing says so.

    Events of one process tree are a cluster until a pause longer than the gap. A pid means the
    process that had it at the time. root is the tree's topmost process as ``instance`` names it,
    or the pid alone for an event outside all known processes; label is always ``inferred``.
    """
    from tidewatch.operators import joins

    known = instances(processes)
    roots = lineage(known.select(F.col("instance").alias("pid"), F.col("parent").alias("ppid"))).select(F.col("pid").alias("_i"), F.coalesce("root", "pid").alias("_root"))
    held = known.join(roots, F.col("instance") == F.col("_i")).select(instance_key("session", "pid").alias("_key"), F.col("start_us").alias("us"), F.lit(0).cast("long").alias("row_id"), "end_us", "_root")
    met = joins.as_of(events.withColumn("_key", instance_key("session", "pid")), held, "_key", "us", ["end_us", "_root"])
    alive = F.col("_seen").isNotNull() & (F.col("r_end_us").isNull() | (F.col("us") < F.col("r_end_us")))
    rooted = met.withColumn("root", F.when(alive, F.col("r__root")).otherwise(F.col("_key"))).drop("_key", "_seen", "r_end_us", "r__root")
    return scan.running(rooted, ["session", "root"], list(ORDER), gaps={"cluster": ("us", gap_us)}).withColumn("label", F.lit("inferred"))


def instance_key(session: str, pid: str) -> Column:
    return F.concat_ws("|", session, F.col(pid).cast("string"))


def instances(processes: DataFrame) -> DataFrame:
    """``processes`` (session, pid, ppid, start_us, end_us or null) with instance and parent: pids come again, so a parent is the process that had the pid when the child began."""
    from tidewatch.operators import joins

    named = processes.withColumn("instance", F.concat_ws("|", instance_key("session", "pid"), F.col("start_us").cast("string")))
    children = named.withColumn("_key", F.when(F.col("ppid").isNotNull(), instance_key("session", "ppid"))).withColumn("_order", F.lit(1).cast("long"))
    parents = named.select(instance_key("session", "pid").alias("_key"), "start_us", F.lit(0).cast("long").alias("_order"), F.col("end_us").alias("until"), F.col("instance").alias("is"))
    met = joins.as_of(children, parents, "_key", "start_us", ["until", "is"], "_order")
    alive = F.col("_seen").isNotNull() & (F.col("r_until").isNull() | (F.col("start_us") < F.col("r_until"))) & (F.col("r_is") != F.col("instance"))
    return met.withColumn("parent", F.when(alive, F.col("r_is"))).drop("_key", "_order", "_seen", "r_until", "r_is")


def lineage(processes: DataFrame) -> DataFrame:
    """(pid, root, hops, cycle) of processes (pid, ppid): the topmost ancestor that is in the table, however far up.

    Pointers double in each round, so a chain of n processes takes log2(n) joins. Those that reach no
    top, for they are in a cycle or below one, have a null root and null hops and cycle is true.
    """
    from tidewatch.plans.tables import materialize

    known = processes.select("pid").distinct().select(F.col("pid").alias("_p"))
    up = processes.groupBy("pid").agg(F.max("ppid").alias("ppid")).join(known, F.col("ppid") == F.col("_p"), "left")
    is_top = F.col("_p").isNull() | (F.col("_p") == F.col("pid"))
    now = materialize(up.select("pid", F.coalesce("_p", "pid").alias("root"), F.when(is_top, 0).otherwise(1).cast("long").alias("hops"), is_top.alias("top")), "lineage")
    # top: the root is a topmost process. A round settles all within twice the distance, so one that settles none is the last
    left = before = None
    while left is None or 0 < left != before:
        above = now.select(F.col("pid").alias("root"), F.col("root").alias("_root"), F.col("hops").alias("_hops"), F.col("top").alias("_top"))
        now = materialize(now.join(above, "root").select("pid", F.col("_root").alias("root"), F.when(F.col("top"), F.col("hops")).otherwise(F.col("hops") + F.col("_hops")).alias("hops"), F.col("_top").alias("top")), "lineage")
        left, before = now.where("not top").count(), left
    none = ~F.col("top")
    return now.select("pid", F.when(F.col("top"), F.col("root")).alias("root"), F.when(F.col("top"), F.col("hops").cast("int")).alias("hops"), none.alias("cycle"))


def chained(rows: DataFrame, order: str, value: str, out: str = "before", first=None) -> DataFrame:
    """``rows`` with the value of the row before in one order over the whole table.

    Rows are range-partitioned and sorted; only each partition's last row meets the next partition,
    so no task sees all rows.
    """
    from tidewatch.plans.tables import materialize

    kind = rows.schema[value].dataType
    from pyspark.sql.types import IntegerType, StructField, StructType

    def local(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part, last = TaskContext.get().partitionId(), None
        for batch in batches:
            if len(batch):
                before = batch[value].shift(1).astype(object)
                before.iloc[0] = last
                last = batch[value].iloc[-1]
                yield batch.assign(**{out: before.where(before.notna(), None), "_part": part})

    made = StructType([*rows.schema.fields, StructField(out, kind), StructField("_part", IntegerType())])
    placed = materialize(rows.repartitionByRange(order).sortWithinPartitions(order).mapInPandas(local, made), "chained")
    # one row a partition
    edges = placed.groupBy("_part").agg(F.min(order).alias("_first"), F.max_by(value, order).alias("_last"))
    edges = edges.select("_first", F.lag("_last", 1, first).over(Window.orderBy("_first")).alias("_edge"))
    return placed.join(edges, F.col(order) == F.col("_first"), "left").withColumn(out, F.coalesce(out, "_edge")).drop("_part", "_first", "_edge")
