"""Tamper evidence: row hashes, Merkle roots, sealed segments, checkpoints, and their audit."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.functions.text import same_counts
from tidewatch.operators import scan
from tidewatch.operators.windows import chained

ZERO = "0" * 64
SPAN = 4096  # places in a bucket, as many as a segment has events at most
CHECKPOINT_SEGMENTS, CHECKPOINT_US = 64, 300_000_000


def _sha(hexes: Column) -> Column:
    return F.sha2(F.unhex(hexes), 256)


def canonical(columns: list[str]) -> Column:
    """A row as text with its fields in the given order; null and empty differ. Floats are refused by ``row_hash``."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


#: Texts of the envelope, from closed vocabularies or made by the recorder: the only ones that are hashed as they are.
ENVELOPE = ("session", "type", "origin", "state", "gap_reason", "path_source")


def raw_texts(rows: DataFrame, columns: list[str]) -> list[str]:
    """Those of ``columns`` that hold texts, also inside lists, maps and structs, and are neither of the envelope nor marked as redacted."""
    from tidewatch.operators.redact import REDACTED

    def holds_text(kind: T.DataType) -> bool:
        inner = [f.dataType for f in kind.fields] if isinstance(kind, T.StructType) else [getattr(kind, x) for x in ("elementType", "keyType", "valueType") if hasattr(kind, x)]
        return isinstance(kind, (T.StringType, T.VarcharType, T.CharType)) or any(map(holds_text, inner))

    return [f.name for f in rows.select(*columns).schema if holds_text(f.dataType) and f.name not in ENVELOPE and not f.metadata.get(REDACTED)]


def row_hash(rows: DataFrame, columns: list[str]) -> DataFrame:
    """``rows`` with row_hash: the leaf hash of their canonical text. Texts must have been redacted, as their columns' metadata say."""
    floats = [c for c, t in rows.select(*columns).dtypes if t in ("double", "float")]
    if floats:
        raise ValueError(f"floating point has no canonical form: {floats}")
    raw = raw_texts(rows, columns)
    if raw:
        raise ValueError(f"raw text is not hashed, redact it first: {raw}")
    return rows.withColumn("row_hash", _sha(F.concat(F.lit("00"), F.hex(canonical(columns).cast("binary")))))


def merkle_root(leaves: Column) -> Column:
    """Root of an ordered array of leaf hashes: pairs are hashed, an odd last one with itself; no leaves give zeros."""
    def level(nodes: Column) -> Column:
        pairs = F.transform(F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / 2).cast("int")), lambda i: _sha(F.concat(F.lit("01"), F.get(nodes, 2 * i), F.coalesce(F.get(nodes, 2 * i + 1), F.get(nodes, 2 * i)))))
        return F.when(F.size(nodes) > 1, pairs).otherwise(nodes)

    # as many levels as the number of leaves has binary digits
    top = F.aggregate(F.sequence(F.lit(1), F.length(F.bin(F.size(leaves)))), leaves, lambda nodes, _: level(nodes))
    return F.when(F.size(leaves) == 0, F.lit(ZERO)).otherwise(F.get(top, F.lit(0)))


def segment_table(events: DataFrame) -> DataFrame:
    """Unlinked segments of events (session, seg, us, row_id, type, row_hash, gap_reason)."""
    leaves = F.transform(F.array_sort(F.collect_list(F.struct("us", "row_id", "row_hash"))), lambda x: x["row_hash"])
    gaps = F.collect_list(F.when(F.col("type") == "gap", F.col("gap_reason")))
    made = events.groupBy("session", "seg").agg(F.count("*").alias("event_count"), F.min("row_id").alias("first_row"), F.max("row_id").alias("last_row"), F.max("us").alias("sealed_us"), merkle_root(leaves).alias("merkle_root"), gaps.alias("_g"))
    counts = F.map_from_entries(F.transform(F.array_sort(F.array_distinct("_g")), lambda r: F.struct(r, F.size(F.filter("_g", lambda x: x == r)).cast("long"))))
    return made.withColumn("gap", counts).drop("_g")


def header(columns: dict[str, Column] | None = None) -> Column:
    """A segment's header text without its link."""
    c = {k: F.col(k) for k in ("session", "seg", "event_count", "first_row", "last_row", "sealed_us", "merkle_root", "gap")} | (columns or {})
    gaps = F.array_join(F.transform(F.array_sort(F.map_entries(c["gap"])), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",")
    return F.concat_ws("|", *(c[k].cast("string") for k in ("session", "seg", "event_count", "first_row", "last_row", "sealed_us", "merkle_root")), gaps)


def seal(segments: DataFrame) -> DataFrame:
    """``segments`` with prev_seg_hash and seg_hash, linked in each session from zeros.

    The link needs the hash before it, so a session's segments (one for up to 4096 events) pass in
    order through one iterator that holds one hash.
    """
    import hashlib

    def link(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        session, last = None, ZERO
        for batch in batches:
            prevs, hashes = [], []
            for s, text in zip(batch.session, batch["_header"]):
                last = ZERO if s != session else last
                session = s
                prevs.append(last)
                last = hashlib.sha256(f"{text}|{last}".encode()).hexdigest()
                hashes.append(last)
            yield batch.drop(columns="_header").assign(prev_seg_hash=prevs, seg_hash=hashes)

    from pyspark.sql.types import StringType, StructField, StructType

    ordered = segments.withColumn("_header", header()).repartition("session").sortWithinPartitions("session", "seg")
    return ordered.mapInPandas(link, StructType([*segments.schema.fields, StructField("prev_seg_hash", StringType()), StructField("seg_hash", StringType())]))


def checkpoints(segments: DataFrame, every: int = CHECKPOINT_SEGMENTS, age_us: int = CHECKPOINT_US) -> DataFrame:
    """Attestations (cid, session, seg_first, seg_last, chain_head, signed_us, body, prev_hash) of sealed segments.

    A session's pending segments are attested at ``every`` segments, at an age, and at its end;
    prev_hash links the attestations of all sessions in one order.
    """
    pending = scan.cuts(segments.select("session", "seg", "sealed_us", "seg_hash"), "session", ["seg"], "sealed_us", every, age_us, out="_point")
    last = F.max_by(F.struct("seg", "seg_hash", "sealed_us"), "seg").alias("_l")
    made = pending.groupBy("session", "_point").agg(F.min("seg").alias("seg_first"), last)
    made = made.select("session", "seg_first", F.col("_l.seg").alias("seg_last"), F.col("_l.seg_hash").alias("chain_head"), F.col("_l.sealed_us").alias("signed_us"))
    made = made.withColumn("cid", F.concat_ws("/", F.lpad(F.col("signed_us").cast("string"), 20, "0"), "session", F.lpad(F.col("seg_last").cast("string"), 12, "0")))
    made = made.withColumn("body", F.sha2(F.concat_ws("|", "session", F.col("seg_first").cast("string"), F.col("seg_last").cast("string"), "chain_head", F.col("signed_us").cast("string")), 256))
    return chained(made, "cid", "body", "prev_hash", ZERO)


def _finding(rows: DataFrame, kind: str, detail: Column | None = None) -> DataFrame:
    return rows.select(F.lit(kind).alias("kind"), "session", F.col("seg").cast("long").alias("seg"), (F.lit("") if detail is None else detail.cast("string")).alias("detail"))


def audit_events(events: DataFrame, segments: DataFrame) -> DataFrame:
    """merkle_mismatch, row_continuity_broken and gap_dishonest: one aggregation of the events for all three.

    Archived segments (archived_path) are left to their headers.
    """
    now = segment_table(events).select("session", "seg", F.col("event_count").alias("n"), F.col("merkle_root").alias("root"), F.col("gap").alias("tally"))
    both = segments.where("archived_path is null").join(now, ["session", "seg"], "left") if "archived_path" in segments.columns else segments.join(now, ["session", "seg"], "left")
    n = F.coalesce("n", F.lit(0))
    clean = F.size(F.map_filter("gap", lambda k, v: v != 0)) <= 0
    broken = _finding(both.where((n != F.col("event_count")) & clean), "row_continuity_broken", F.concat_ws(" of ", n.cast("string"), F.col("event_count").cast("string")))
    # a segment that lost rows has no root to compare
    wrong = _finding(both.where((n == F.col("event_count")) & (F.col("root") != F.col("merkle_root"))), "merkle_mismatch")
    dishonest = _finding(both.where(~same_counts(F.col("gap"), F.col("tally"))), "gap_dishonest")
    return broken.unionByName(wrong).unionByName(dishonest)


def audit_links(segments: DataFrame) -> DataFrame:
    """chain_link_broken: a header that does not hash to its seg_hash, or a link that is not the predecessor's."""
    w = Window.partitionBy("session").orderBy("seg")
    before = F.lag("seg_hash", 1, ZERO).over(w)
    number = F.lag("seg", 1, -1).over(w)
    rows = segments.withColumn("_p", before).withColumn("_s", number).withColumn("_h", F.sha2(F.concat_ws("|", header(), "prev_seg_hash"), 256))
    why = F.when(F.col("_h") != F.col("seg_hash"), "header").when(F.col("prev_seg_hash") != F.col("_p"), "link").when(F.col("seg") != F.col("_s") + 1, "missing")
    return _finding(rows.withColumn("_w", why).where("_w is not null"), "chain_link_broken", F.col("_w"))


def audit_heads(points: DataFrame, segments: DataFrame) -> DataFrame:
    """checkpoint_head_mismatch, and archive_missing where the attested segment is gone."""
    held = segments.select("session", F.col("seg").alias("seg_last"), "seg_hash")
    both = points.join(held, ["session", "seg_last"], "left").withColumnRenamed("seg_last", "seg")
    gone = _finding(both.where("seg_hash is null"), "archive_missing")
    return gone.unionByName(_finding(both.where("seg_hash != chain_head"), "checkpoint_head_mismatch"))


def audit_ledger_chain(points: DataFrame) -> DataFrame:
    """checkpoint_chain_broken: prev_hash is not the body before it, over all sessions."""
    linked = chained(points.drop("_b"), "cid", "body", "_b", ZERO)
    return _finding(linked.where("prev_hash != _b").withColumnRenamed("seg_last", "seg"), "checkpoint_chain_broken")


def audit_mirror(points: DataFrame, heads: DataFrame) -> DataFrame:
    """mirror_mismatch; mirror_uncheckable if there are checkpoints and the mirror knows none of them.

    heads: session, seg_last, mirror_hash, n (line order; the last line of a key counts).
    """
    last = heads.groupBy("session", "seg_last").agg(F.max_by("mirror_hash", "n").alias("mirror_hash"))
    both = points.join(last, ["session", "seg_last"], "left").withColumnRenamed("seg_last", "seg")
    wrong = _finding(both.where("mirror_hash != chain_head"), "mirror_mismatch")
    seen = both.agg(F.count("*").alias("n"), F.count("mirror_hash").alias("m")).where("n > 0 and m = 0")
    return wrong.unionByName(_finding(seen.select(F.lit("").alias("session"), F.lit(-1).alias("seg")), "mirror_uncheckable"))


def unattested(segments: DataFrame, points: DataFrame) -> DataFrame:
    """Segments after their session's last checkpoint; without one, all."""
    last = points.groupBy("session").agg(F.max("seg_last").alias("_last"))
    return segments.join(last, "session", "left").where(F.col("seg") > F.coalesce("_last", F.lit(-1))).drop("_last")


def pending(segments: DataFrame, points: DataFrame) -> DataFrame:
    """session, last_checkpointed, pending segments and the oldest unsigned one's time, for sessions with pending ones."""
    last = points.groupBy("session").agg(F.max("seg_last").alias("last_checkpointed"))
    open_ = segments.join(last, "session", "left").where(F.col("seg") > F.coalesce("last_checkpointed", F.lit(-1)))
    return open_.groupBy("session").agg(F.max(F.coalesce("last_checkpointed", F.lit(-1))).alias("last_checkpointed"), F.count("*").alias("pending"), F.min("sealed_us").alias("oldest_us"))


INCOMPLETE = ("mirror_uncheckable", "archived")


def verify(events: DataFrame, segments: DataFrame, points: DataFrame, heads: DataFrame | None = None) -> DataFrame:
    """All findings: kind, session, seg, detail. Checks are independent and run in parallel."""
    found = audit_events(events, segments).unionByName(audit_links(segments)).unionByName(audit_heads(points, segments)).unionByName(audit_ledger_chain(points))
    if "archived_path" in segments.columns:
        found = found.unionByName(_finding(segments.where("archived_path is not null"), "archived"))
    return found if heads is None else found.unionByName(audit_mirror(points, heads))


def verdict(findings: DataFrame, sessions: DataFrame) -> DataFrame:
    """session and code: 2 with a finding, 3 with an incompleteness only, else 0."""
    code = F.when(F.col("kind").isin(*INCOMPLETE), 3).otherwise(2)
    rank = F.when(F.col("kind").isin(*INCOMPLETE), 1).otherwise(2)
    worst = findings.groupBy("session").agg(F.max_by(code, rank).alias("code"), F.count("*").alias("findings"))
    return sessions.select("session").distinct().join(worst, "session", "left").select("session", F.coalesce("code", F.lit(0)).alias("code"), F.coalesce("findings", F.lit(0).cast("long")).alias("findings"))


def trust_card(verdicts: DataFrame, segments: DataFrame, points: DataFrame) -> DataFrame:
    """One row: sessions, segments, unattested, failing sessions and status."""
    a = verdicts.agg(F.count("*").alias("sessions"), F.count_if(F.col("code") == 2).alias("failing"))
    b = segments.agg(F.count("*").alias("segments"))
    c = unattested(segments, points).agg(F.count("*").alias("unattested"))
    # three tables of one row
    return a.crossJoin(b).crossJoin(c).withColumn("status", F.when(F.col("failing") > 0, "fail").otherwise("pass"))


def export_leaves(exported: DataFrame, segments: DataFrame) -> DataFrame:
    """Exported events with the segment their place in the session falls into: a cursor over cumulative counts.

    exported: session, us, row_id, row_hash. Places are dealt to buckets of ``SPAN``; a segment goes
    to each bucket that it reaches into, so an event meets the segments of its bucket alone.
    """
    end = F.sum("event_count").over(Window.partitionBy("session").orderBy("seg"))
    spans = segments.select("session", "seg", (end - F.col("event_count")).alias("_from"), end.alias("_to")).where("_to > _from")
    bucket = lambda c: F.floor(c / SPAN).cast("long")
    spans = spans.withColumn("_bucket", F.explode(F.sequence(bucket(F.col("_from")), bucket(F.col("_to") - 1))))
    placed = scan.numbers(exported, "session", ["us", "row_id"], "_place").withColumn("_bucket", bucket(F.col("_place")))
    return placed.join(spans, ["session", "_bucket"]).where("_place >= _from and _place < _to").drop("_place", "_from", "_to", "_bucket")
