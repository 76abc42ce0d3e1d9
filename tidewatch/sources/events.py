"""Event sources: typed ingest with a quarantine, markers, raw records, head mirrors."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch import schema as S
from tidewatch.functions.text import CROCKFORD

#: The driver's event kinds as event types.
KINDS = {"purchase": "proc.exec", "click": "fs.write_open", "view": "net.connect", "signup": "net.dns", "error": "fs.sensitive_read"}


def session_start(session: str) -> datetime.datetime | None:
    """When a session with a ULID for its name began, as the ULID's first ten characters say; None for other names."""
    text = session.upper()
    if len(text) != 26 or text[0] not in CROCKFORD[:8] or any(c not in CROCKFORD for c in text):
        return None
    millis = 0
    for c in text[:10]:
        millis = 32 * millis + CROCKFORD.index(c)
    try:
        return datetime.datetime.fromtimestamp(0, datetime.UTC) + datetime.timedelta(milliseconds=millis)
    except OverflowError:
        return None


def read_events(spark: SparkSession, path: str, session: str | None = None, until: datetime.date | None = None, slack_days: int = 1) -> DataFrame:
    """Stored events of ``append_events``, by day. A session reaches the scan as a filter.

    Folders of days before a session began are not listed, if its name is a ULID: its events are
    from ``slack_days`` before the ULID's time, for clocks differ, to ``until``, both included.
    """
    stored = T.StructType([*S.EVENT.fields, T.StructField("event_date", T.DateType())])
    rows = spark.read.schema(stored).parquet(path)
    if session is None:
        return rows
    began = session_start(session)
    if began is not None:
        rows = rows.where(F.col("event_date") >= F.lit((began - datetime.timedelta(days=slack_days)).date()))
    if until is not None:
        rows = rows.where(F.col("event_date") <= F.lit(until))
    return rows.where(F.col("session") == session)


def adapt(events: DataFrame) -> DataFrame:
    """The driver's events table as flat envelope columns; ``row_id`` is unique, ``us`` is time in microseconds."""
    k = F.regexp_extract("props", '"k": ([0-9]+)', 1).cast("long")
    kind = F.coalesce(*(F.when(F.col("event_type") == a, F.lit(b)) for a, b in KINDS.items()))
    rows = events.select(F.col("event_id").alias("row_id"), F.concat(F.lit("s"), F.col("user_id").cast("string")).alias("session"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), kind.alias("type"), k.alias("k"), "value")
    return rows.withColumns({
        "qname": F.when(F.col("type") == "net.dns", F.concat(F.lit("host"), F.col("k"), F.lit(".example"))),
        "addr": F.when(F.col("type").isin("net.connect", "net.dns"), F.when(F.col("k") < 50, F.concat(F.lit("10.0.0."), F.col("k"))).otherwise(F.concat(F.lit("8.8.8."), F.col("k")))),
        "path": F.when(F.col("type").isin("proc.exec", "fs.write_open", "fs.sensitive_read"), F.concat(F.lit("/data/f"), F.col("k"))),
        "pid": F.col("k") + 100,
    })


#: As ``adapt``, for DuckDB.
EV_SQL = """ev AS (
  SELECT row_id, session, us, type, k, value,
         CASE WHEN type = 'net.dns' THEN 'host' || k || '.example' END AS qname,
         CASE WHEN type IN ('net.connect', 'net.dns') THEN CASE WHEN k < 50 THEN '10.0.0.' || k ELSE '8.8.8.' || k END END AS addr,
         CASE WHEN type IN ('proc.exec', 'fs.write_open', 'fs.sensitive_read') THEN '/data/f' || k END AS path, k + 100 AS pid
  FROM (SELECT event_id AS row_id, 's' || user_id AS session, epoch_us(ts) AS us, value, CAST(regexp_extract(props, '"k": ([0-9]+)', 1) AS BIGINT) AS k,
               CASE event_type WHEN 'purchase' THEN 'proc.exec' WHEN 'click' THEN 'fs.write_open' WHEN 'view' THEN 'net.connect'
                               WHEN 'signup' THEN 'net.dns' WHEN 'error' THEN 'fs.sensitive_read' END AS type
        FROM events))"""


def reject_reason(c: dict[str, Column]) -> Column:
    """Why an event is not valid, the first reason that holds; null if it is.

    c: v, session, type, origin, state, path_source, reason (of a gap) and daddr_length.
    """
    marker = c["type"].startswith("marker.") & (F.length(c["type"]) > 7)
    return (
        F.when(c["v"].isNull() | (c["v"] != 1), "version").when(F.coalesce(c["session"], F.lit("")) == "", "session").when(F.coalesce(c["type"], F.lit("")) == "", "type_empty")
        .when(c["origin"].isNull() | ~c["origin"].isin(*S.ORIGINS), "origin").when(c["state"].isNull() | ~c["state"].isin(*S.STATES), "state")
        .when(~marker & ~c["type"].isin(*S.EVENT_TYPES), "type_unknown").when(marker != (c["origin"] == "enrichment"), "origin_marker")
        .when((c["type"] == "net.connect") & (F.coalesce(c["daddr_length"], F.lit(0)) != 16), "daddr").when((c["type"] == "gap") & (c["reason"].isNull() | ~c["reason"].isin(*S.GAP_REASONS)), "gap_reason")
        .when(c["path_source"].isNotNull() & ~c["path_source"].isin(*S.PATH_SOURCES), "path_source")
    )


def validate(rows: DataFrame, columns: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(valid rows, quarantined rows with reject_reason)."""
    marked = rows.withColumn("reject_reason", reject_reason(columns))
    return marked.where("reject_reason is null").drop("reject_reason"), marked.where("reject_reason is not null")


def parse_markers(lines: DataFrame, declared: list[str], carried: list[str], forbidden: list[str], line: str = "value", salt: str | None = None) -> DataFrame:
    """JSON lines as marker events: type, fields and reject_reason.

    A line has at most 4096 bytes and is one object whose event is a declared string; carried
    fields that are not forbidden stay, of strings, booleans and whole numbers from 0; nulls are
    dropped; fractions, negative numbers, arrays and objects reject the line. With a ``salt``
    strings are redacted.
    """
    parsed = F.try_variant_get(F.try_parse_json(F.col(line)), "$", "map<string,variant>")
    allowed = F.array(*(F.lit(x) for x in carried if x not in forbidden))
    kind = lambda v: F.schema_of_variant(v)
    kept = F.map_filter("__m", lambda k, v: F.array_contains(allowed, k) & v.isNotNull() & (kind(v) != "VOID"))
    whole = lambda v: (kind(v) == "BIGINT") & (F.try_variant_get(v, "$", "bigint") >= 0)
    bad = F.exists(F.map_values("__kept"), lambda v: ~(kind(v).isin("STRING", "BOOLEAN") | whole(v)))
    held = F.element_at(F.col("__m"), F.lit("event"))
    event = F.when(F.schema_of_variant(held) == "STRING", F.try_variant_get(held, "$", "string"))
    rows = lines.withColumn("__m", parsed).withColumn("__kept", kept)
    reason = F.when(F.octet_length(line) > 4096, "too_long").when(F.col("__m").isNull(), "not_an_object").when(event.isNull() | ~event.isin(*declared), "undeclared").when(bad, "not_a_scalar")
    rows = rows.withColumn("reject_reason", reason)
    good = F.col("reject_reason").isNull()
    rows = rows.withColumn("type", F.when(good, F.concat(F.lit("marker."), event)))
    values = F.transform(F.map_values("__kept"), lambda v: F.try_variant_get(v, "$", "string"))
    if salt is not None:
        from tidewatch.operators.redact import redact_lists

        texts = F.transform(F.map_values("__kept"), lambda v: kind(v) == "STRING")
        values = F.zip_with(values, F.arrays_zip(redact_lists(values, salt).alias("done"), texts.alias("text")), lambda v, x: F.when(x["text"], x["done"]).otherwise(v))
    return rows.withColumn("fields", F.when(good, F.map_from_arrays(F.map_keys("__kept"), values))).drop("__m", "__kept")


def read_heads(spark: SparkSession, path: str) -> DataFrame:
    """A head mirror of JSON lines. A torn last line of a file is skipped, any other bad line is an error row."""
    from pyspark.sql import Window

    fields = "session_id string, seg_last long, chain_head array<int>, ckpt_hash array<int>, at long"
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("n"))
    parsed = lines.withColumn("head", F.from_json("value", fields)).withColumn("bad", F.col("head").isNull() | F.col("head.session_id").isNull())
    last = F.col("n") == F.max("n").over(Window.partitionBy("file"))
    return parsed.withColumn("error", F.col("bad") & ~last).where(~F.col("bad") | F.col("error")).select("head.*", "n", "error", "value")
