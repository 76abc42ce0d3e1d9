"""Exported folders checked from disk: files listed, lines parsed, hashes, roots, links and heads computed anew.

Edge cases: a session without events is named by its manifest and needs no files; a kind of file
that no session has is missing for all; lines that are no JSON of the table's form damage their
session's file, and the rest of it is not judged.
"""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.operators import ledger

MANIFEST = "format_version int, hash string, sig string, encoding string, session string, event_count long, status string"
SEGMENTS = "session string, seg long, event_count long, first_row long, last_row long, sealed_us long, merkle_root string, gap map<string,long>, prev_seg_hash string, seg_hash string"
CHECKPOINTS = "session string, seg_first long, seg_last long, chain_head string, signed_us long, cid string, body string, prev_hash string"
TABLES = ("events", "segments", "checkpoints")
BAD = "_damaged"


SMALL = 1 << 20


def _session(path: Column) -> Column:
    """The session that a file's folder names; folder names escape signs by their codes."""
    return F.url_decode(F.replace(F.regexp_extract(path, r"/session=([^/]*)/[^/]*$", 1), F.lit("+"), F.lit("%2B")))


def stored(spark: SparkSession, path: str, name: str) -> DataFrame | None:
    """(path, length, content) of the files of an export's table; None if no session has it. Listed once, read when content is asked for.

    Spark gives a task 32 small files at most; here a core gets four tasks.
    """
    try:
        found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{path}/{name}")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return found.where(F.col("path").rlike("/session=[^/]*/[^/]*$")).coalesce(4 * spark.sparkContext.defaultParallelism)


def files_of(found: dict[str, DataFrame | None], spark: SparkSession) -> DataFrame:
    """(session, file, bytes) of an export's files a session, by their names alone."""
    each = [df.where(F.col("path").rlike("/part-[^/]*$")).select(_session(F.col("path")).alias("session"), F.lit(name).alias("file"), "length") for name, df in found.items() if df is not None]
    rows = reduce(DataFrame.unionByName, each) if each else spark.createDataFrame([], "session string, file string, length long")
    return rows.groupBy("session", "file").agg(F.sum("length").alias("bytes"))


def read_table(spark: SparkSession, path: str, name: str, schema: str, found: DataFrame | None) -> DataFrame:
    """A table of an export, lines that are not of its form in ``_damaged``; empty if no session has it.

    Small files are read whole, as opening one as a table of lines takes some
    10 ms of CPU; those beyond 1 MiB are split by Spark.
    """
    kind = T.StructType.fromDDL(f"{schema}, {BAD} string")
    if found is None:
        return spark.createDataFrame([], kind)
    lines = found.where(F.col("length") <= SMALL).select(_session(F.col("path")).alias("session"), F.explode(F.split(F.col("content").cast("string"), "[\r\n]+")).alias("line"))
    if not found.where(F.col("length") > SMALL).select("length").isEmpty():
        where = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))  # escaped once more than the folder's name
        large = spark.read.option("recursiveFileLookup", "true").text(f"{path}/{name}").where(F.col("_metadata.file_size") > SMALL)
        lines = lines.unionByName(large.where(where.rlike("/session=[^/]*/[^/]*$")).select(_session(where).alias("session"), F.col("value").alias("line")))
    body = T.StructType([f for f in kind if f.name != "session"])
    read = lines.where(F.col("line").rlike(r"\S")).withColumn("_row", F.from_json("line", body, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BAD}))
    damaged = F.when(F.col("_row").isNull(), F.col("line")).otherwise(F.col(f"_row.{BAD}"))  # null is no object
    return read.select(*(F.col("session") if f.name == "session" else damaged.alias(BAD) if f.name == BAD else F.col(f"_row.{f.name}") for f in kind))


def verify_folder(spark: SparkSession, path: str, columns: list[str], event_schema: str) -> DataFrame:
    """(session, declared, found, status) of each session of an exported folder.

    status, the first that holds: BROKEN(manifest) for other algorithms, unknown_session,
    INCOMPLETE(file) for a missing file, BROKEN(file) for a damaged one, BROKEN(event_count),
    BROKEN(row_hash), BROKEN(kind) for the ledger's findings, OK. ``columns`` are those that a row's
    hash covers, in order; ``event_schema`` has them, session, us, row_id, type and gap_reason.
    """
    from tidewatch.plans.tables import materialize

    manifest = spark.read.schema(MANIFEST).json(f"{path}/manifest")
    stock = {name: stored(spark, path, name) for name in TABLES}
    files = materialize(files_of(stock, spark), "export-files")
    made = {name: materialize(read_table(spark, path, name, schema, stock[name]), f"export-{name}") for name, schema in zip(TABLES, (f"{event_schema}, row_hash string", SEGMENTS, CHECKPOINTS))}
    whole = {name: df.where(F.col(BAD).isNull()).drop(BAD) for name, df in made.items()}

    expected = manifest.where("status = 'ok'").select("session", F.explode(F.array(*map(F.lit, TABLES))).alias("file"))
    lacking = expected.join(files, ["session", "file"], "left_anti").groupBy("session").agg(F.max("file").alias("lacking"))
    damaged = [df.where(F.col(BAD).isNotNull()).select("session", F.lit(name).alias("file")) for name, df in made.items()]
    damaged = damaged[0].unionByName(damaged[1]).unionByName(damaged[2]).groupBy("session").agg(F.max("file").alias("damaged"))

    events = whole["events"]
    found = events.groupBy("session").agg(F.count("*").alias("found"))
    again = ledger.row_hash(events.withColumnRenamed("row_hash", "_said"), columns)
    forged = again.where("_said is null or _said != row_hash").select("session").distinct().withColumn("forged", F.lit(True))
    # only what has all its files and lines is worth a look at its chain
    sound = expected.select("session").distinct().join(lacking, "session", "left_anti").join(damaged, "session", "left_anti")
    mine = {name: materialize(df.join(sound, "session", "left_semi"), f"export-sound-{name}") for name, df in (whole | {"events": again.drop("_said")}).items()}
    # events beyond the last segment belong to none: their count tells
    placed = ledger.export_leaves(mine["events"], mine["segments"])
    findings = ledger.audit_events(placed, mine["segments"]).unionByName(ledger.audit_links(mine["segments"])).unionByName(ledger.audit_heads(mine["checkpoints"], mine["segments"]))
    kinds = findings.groupBy("session").agg(F.min("kind").alias("kind"))

    rows = manifest.select("session", F.col("event_count").alias("declared"), F.col("status").alias("_status"), ((F.col("format_version") == 1) & (F.col("hash") == "sha256") & (F.col("sig") == "none") & (F.col("encoding") == "json")).alias("_known"))
    for more in (found, lacking, damaged, forged, kinds):
        rows = rows.join(more, "session", "left")
    broken = lambda c: F.concat(F.lit("BROKEN("), c, F.lit(")"))
    count = F.coalesce("found", F.lit(0).cast("long"))
    status = (
        F.when(~F.coalesce("_known", F.lit(False)), broken(F.lit("manifest"))).when(F.col("_status") != "ok", F.col("_status")).when(F.col("lacking").isNotNull(), F.concat(F.lit("INCOMPLETE("), "lacking", F.lit(")")))
        .when(F.col("damaged").isNotNull(), broken(F.col("damaged"))).when(count != F.col("declared"), broken(F.lit("event_count"))).when(F.col("forged"), broken(F.lit("row_hash")))
        .when(F.col("kind").isNotNull(), broken(F.col("kind"))).otherwise("OK")
    )
    return rows.select("session", "declared", count.alias("found"), status.alias("status"))
