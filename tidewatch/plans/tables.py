"""Tables that long plans are cut at, and the sinks' tables."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; where it is unset a temporary one, on a local master only."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        shared = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(shared)
    return shared


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` in the shared scratch folder and read it back: lineage ends at the files."""
    path = f"{scratch_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def append_events(rows: DataFrame, path: str) -> None:
    """Append sink: partitioned by day, clustered by session."""
    day = F.to_date(F.timestamp_micros(F.floor(F.col("ts_wall") / 1000)))
    rows.withColumn("event_date", day).repartition("event_date", "session").sortWithinPartitions("session").write.mode("append").partitionBy("event_date").option("compression", "zstd").parquet(path)


def append_heads(heads: DataFrame, path: str) -> None:
    heads.write.mode("append").json(path)


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of an absolute path with its scheme, and the path there."""
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), re.sub("^file:(//)?", "", path)
    return pafs.FileSystem.from_uri(path)


def folder_name(key: str, value) -> str:
    """The folder of a key's value, as Spark names it: signs that paths give a meaning are escaped."""
    text = "" if value is None else str(value)
    return f"{key}=" + (re.sub(r"""[\x01-\x1f"#%'*/:=?\\\x7f{\[\]^]""", lambda x: f"%{ord(x[0]):02X}", text) or "__HIVE_DEFAULT_PARTITION__")


def write_folders(rows: DataFrame, key: str, order: list[str], path: str, mode: str = "overwrite") -> None:
    """The texts ``value`` of ``rows`` as lines, a folder a key, as ``partitionBy(key).text`` lays them out; ``order`` is the lines' order.

    Made for many small folders. Rows are range-partitioned by key and order, so a key has one file,
    or as many as the partitions it fills, and not one for each task that meets it. Tasks write the
    files themselves: Spark's writer takes some 20 ms of CPU for each, as Hadoop without its native
    library starts a process for a folder, a file and a checksum. A file gets its name when it is
    whole and a task that runs again replaces its own files; unlike with Spark's writer, those of
    a failed job stay. Where Arrow doesn't know the path's file system, Spark's writer takes over.
    """
    # by a number, as tiny rows would be put in one task though each may be a file
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = rows.repartitionByRange(tasks, key, *order).sortWithinPartitions(key, *order).select(key, "value")
    base = path if re.match(r"\w+:", path) else rows.sparkSession.sparkContext._jsc.hadoopConfiguration().get("fs.defaultFS").rstrip("/") + path
    try:
        files, root = file_system(base)
    except (pa.ArrowException, OSError):
        placed.write.mode(mode).partitionBy(key).text(path)
        return
    if mode == "overwrite":
        files.delete_dir_contents(root, missing_dir_ok=True)
    files.create_dir(root)
    run = uuid.uuid4().hex

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        files, root = file_system(base)
        task = TaskContext.get()
        name, made = f"part-{task.partitionId():05d}-{run}", 0
        folder = out = None

        def finish() -> None:
            if out is not None:
                out.close()
                files.move(f"{folder}/.{name}-{task.taskAttemptId()}", f"{folder}/{name}")

        for batch in batches:
            for value, lines in groupby(zip(*(c.to_pylist() for c in batch.columns)), lambda x: x[0]):
                its = f"{root}/{folder_name(key, value)}"
                if its != folder:
                    finish()
                    folder, made = its, made + 1
                    files.create_dir(folder)
                    out = files.open_output_stream(f"{folder}/.{name}-{task.taskAttemptId()}")
                out.write(b"".join((line or b"") + b"\n" for _, line in lines))
        finish()
        yield pa.RecordBatch.from_pydict({"files": pa.array([made], pa.int64())})

    placed.select(key, F.col("value").cast("binary")).mapInArrow(write, "files long").agg(F.sum("files")).collect()


def as_lines(rows: DataFrame, key: str = "session") -> DataFrame:
    """``rows`` with value: their columns but the key as one JSON object."""
    return rows.withColumn("value", F.to_json(F.struct(*(c for c in rows.columns if c != key))))


#: The order of an export's lines in a session.
LINES = {"events": ["us", "row_id"], "segments": ["seg"], "checkpoints": ["seg_last"]}


def export_sessions(events: DataFrame, segments: DataFrame, checkpoints: DataFrame, sessions: DataFrame, path: str) -> DataFrame:
    """Write the sessions' events, segments and checkpoints as JSON, a folder a session, and a manifest; returns the manifest.

    A session without events has a manifest row with status unknown_session.
    """
    wanted = sessions.select("session").distinct()
    for name, table in (("events", events), ("segments", segments), ("checkpoints", checkpoints)):
        write_folders(as_lines(table.join(wanted, "session", "left_semi")), "session", LINES[name], f"{path}/{name}")
    made = manifest(events.join(wanted, "session", "left_semi"), wanted)
    made.write.mode("overwrite").json(f"{path}/manifest")
    return made


def manifest(events: DataFrame, wanted: DataFrame) -> DataFrame:
    counts = events.groupBy("session").agg(F.count("*").alias("event_count"))
    rows = wanted.join(counts, "session", "left")
    return rows.select(F.lit(1).alias("format_version"), F.lit("sha256").alias("hash"), F.lit("none").alias("sig"), F.lit("json").alias("encoding"), "session", F.coalesce("event_count", F.lit(0).cast("long")).alias("event_count"), F.when(F.col("event_count").isNull(), "unknown_session").otherwise("ok").alias("status"))


EXPORT_FILES = ("manifest", "events", "segments", "checkpoints", "verdict")


def missing_files(found: DataFrame, sessions: DataFrame) -> DataFrame:
    """(session, file) of the expected files that an export lacks. found: session, file."""
    expected = sessions.select("session").distinct().select("session", F.explode(F.array(*map(F.lit, EXPORT_FILES))).alias("file"))
    return expected.join(found, ["session", "file"], "left_anti")


def route_by_owner(events: DataFrame, path: str) -> None:
    """Owner sink: one folder an owner; rows without one go to the dead letters."""
    events.where("owner_uid is not null").write.mode("append").partitionBy("owner_uid").parquet(f"{path}/owners")
    events.where("owner_uid is null").write.mode("append").parquet(f"{path}/dead_letters")


def retention_due(segments: DataFrame, ttl: DataFrame, now_us: int) -> DataFrame:
    """Segments sealed a profile's time to live ago or earlier, not archived yet.

    segments: session, seg, profile, sealed_us, archived_path. ttl: profile, ttl_us.
    """
    return segments.join(ttl, "profile").where((F.col("sealed_us") <= F.lit(now_us) - F.col("ttl_us")) & F.col("archived_path").isNull()).drop("ttl_us")


def archive(events: DataFrame, segments: DataFrame, due: DataFrame, path: str) -> tuple[DataFrame, DataFrame]:
    """Write the due segments' events to the archive; (events that stay hot, segments with archived_path set for those written).

    The archive is clustered by session and segment: a reader of one session skips by the files'
    statistics what others hold, and the number of files follows the rows and not the sessions.
    """
    key = ["session", "seg"]
    due = due.select(*key).distinct()
    events.join(due, key, "left_semi").repartitionByRange(*key).sortWithinPartitions(*key).write.mode("append").option("compression", "zstd").parquet(path)
    moved = due.withColumn("_now", F.lit(path))
    had = F.col("archived_path") if "archived_path" in segments.columns else F.lit(None).cast("string")
    marked = segments.join(moved, key, "left").withColumn("archived_path", F.coalesce(had, "_now")).drop("_now")
    return events.join(due, key, "left_anti"), marked


def read_export(spark: SparkSession, path: str, name: str, schema=None) -> DataFrame:
    """A table of an exported folder, with the session that its folder names."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.json(f"{path}/{name}")


def verify_export(manifests: DataFrame, events: DataFrame) -> DataFrame:
    """(session, declared, found, status) of an export: its events are counted against the manifest."""
    found = events.groupBy("session").agg(F.count("*").alias("found"))
    both = manifests.select("session", F.col("event_count").alias("declared")).join(found, "session", "left").withColumn("found", F.coalesce("found", F.lit(0).cast("long")))
    return both.withColumn("status", F.when(F.col("declared") == F.col("found"), "OK").otherwise("BROKEN(events)"))


def mutations(trusted: DataFrame, stored: DataFrame, key: str = "row_id", digest: str = "row_hash") -> DataFrame:
    """(key, change) of rows added, removed or changed against a trusted copy."""
    a = trusted.select(F.col(key), F.col(digest).alias("_a"))
    b = stored.select(F.col(key), F.col(digest).alias("_b"))
    change = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(F.col("_a") != F.col("_b"), "changed")
    return a.join(b, key, "full").withColumn("change", change).where("change is not null").select(key, "change")


def check_exports(manifests: DataFrame, files: DataFrame) -> DataFrame:
    """(session, status): BROKEN(manifest) for other algorithms than ours, INCOMPLETE for a missing file, else OK."""
    lacking = missing_files(files, manifests).groupBy("session").agg(F.count("*").alias("_n"))
    known = (F.col("format_version") == 1) & (F.col("hash") == "sha256") & (F.col("sig") == "none") & (F.col("encoding") == "json")
    status = F.when(~known, "BROKEN(manifest)").when(F.col("_n") > 0, "INCOMPLETE").otherwise("OK")
    return manifests.join(lacking, "session", "left").select("session", status.alias("status"))
