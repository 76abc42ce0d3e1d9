"""Load shedding by priority, with every loss accounted for."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

TIERS = 4


class TieredBucket:
    """Four buckets of ``burst`` tokens. Elapsed time fills the highest first and spills down."""

    def __init__(self, rate: float, burst: float):
        self.rate, self.burst, self.tokens, self.last = rate, burst, [float(burst)] * TIERS, None

    def admit(self, us: int, tier: int) -> bool:
        if self.last is not None:
            fresh = max(us - self.last, 0) * self.rate / 1e6
            for k in range(TIERS - 1, -1, -1):
                room = min(self.burst - self.tokens[k], fresh)
                self.tokens[k] += room
                fresh -= room
        self.last = us
        if self.tokens[tier] < 1:
            return False
        self.tokens[tier] -= 1
        return True


def shed(events: DataFrame, rate: float = 20_000, burst: float = 20_000) -> DataFrame:
    """``events`` (session, us, row_id, tier) with shed. A null tier is never shed and takes no token.

    A token depends on all events of the session before it, so rows are dealt by session, sorted,
    and pass through one bucket that is carried across batches.
    """
    def replay(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        session, bucket = None, None
        for batch in batches:
            out = []
            for s, us, tier in zip(batch.session, batch.us, batch.tier):
                if s != session:
                    session, bucket = s, TieredBucket(rate, burst)
                out.append(not pd.isna(tier) and not bucket.admit(int(us), int(tier)))
            yield batch.assign(shed=out)

    ordered = events.repartition("session").sortWithinPartitions("session", "us", "row_id")
    return ordered.mapInPandas(replay, StructType([*events.schema.fields, StructField("shed", BooleanType())]))


def gap_rows(events: DataFrame, every_us: int = 5_000_000, reason: str = "governor") -> DataFrame:
    """One gap a session and flush interval with losses: counts by class, and the interval of the lost events."""
    lost = events.where("shed").withColumn("flush", F.floor(F.col("us") / every_us))
    by = lost.groupBy("session", "flush", "class").agg(F.count("*").alias("n"), F.min("us").alias("a"), F.max("us").alias("b"))
    out = by.groupBy("session", "flush").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("class", "n")))).alias("counts"), F.min("a").alias("from_us"), F.max("b").alias("to_us"))
    return out.select("session", F.lit(reason).alias("reason"), "counts", "from_us", "to_us")


def loss_totals(gaps: DataFrame) -> DataFrame:
    """(session, reason, class, lost, from_us, to_us) over all gap rows."""
    rows = gaps.select("session", "reason", "from_us", "to_us", F.explode("counts").alias("class", "n"))
    return rows.groupBy("session", "reason", "class").agg(F.sum("n").alias("lost"), F.min("from_us").alias("from_us"), F.max("to_us").alias("to_us"))


def final_gap(gaps: DataFrame) -> DataFrame:
    """At a session's end: one row a reason with all its counts."""
    t = loss_totals(gaps)
    return t.groupBy("session", "reason").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("class", "lost")))).alias("counts"), F.min("from_us").alias("from_us"), F.max("to_us").alias("to_us"))


def conservation(offered: DataFrame, gaps: DataFrame) -> DataFrame:
    """(session, class, offered, admitted, lost) where admitted and recorded losses don't add up to what was offered."""
    a = offered.groupBy("session", "class").agg(F.count("*").alias("offered"), F.count_if(~F.col("shed")).alias("admitted"))
    b = loss_totals(gaps).groupBy("session", "class").agg(F.sum("lost").alias("lost"))
    both = a.join(b, ["session", "class"], "full").fillna(0, ["offered", "admitted", "lost"])
    return both.where("offered != admitted + lost")


def restart_gaps(batches: DataFrame, sessions: DataFrame, limit_us: int) -> DataFrame:
    """A daemon_restart gap for each active session (session, start_us, end_us) over each pause between batches (us)."""
    from pyspark.sql import Window

    from tidewatch.operators.joins import small

    # one row a batch: a small table of the stream's own log
    pauses = batches.select("us", F.lag("us").over(Window.orderBy("us")).alias("_before")).where(F.col("us") - F.col("_before") > limit_us)
    hit = sessions.join(small(pauses), (F.col("start_us") <= F.col("_before")) & (F.col("end_us").isNull() | (F.col("end_us") >= F.col("us"))))
    return hit.select("session", F.lit("daemon_restart").alias("reason"), F.col("_before").alias("from_us"), F.col("us").alias("to_us"))
