"""Raw records of ten kinds, one JSON line each, decoded in one scan to typed columns or a reject reason.

A line is an object with v, kind and the kind's fields. It is parsed once to a variant; each field of
any kind is one typed column, null where its kind lacks it. What does not fit is rejected, never fatal.

Edge cases: a null or empty line is rejected as json; unknown fields are passed over; a field of
another type than its column's is as if missing.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions import classify as C

VERSION = 1
#: A record's fields by kind, as names of ``FIELDS``; those with a question mark may be missing.
KINDS = {
    "exec": "pid ppid uid cgid ts_mono ts_wall comm exe_path cwd argv argv_truncated? exe_digest?",
    "fork": "pid ppid cgid ts_mono ts_wall",
    "exit": "pid cgid ts_mono ts_wall exit_code utime_ns stime_ns",
    "fs_op": "op path_source pid cgid ts_mono ts_wall flags mode path path2?",
    "connect": "proto family pid cgid ts_mono ts_wall daddr dport",
    "sendmsg": "proto family pid cgid ts_mono ts_wall daddr dport",
    "unix_connect": "pid cgid ts_mono ts_wall path",
    "flow_close": "proto family pid cgid ts_mono ts_wall daddr dport bytes_tx bytes_rx dur_ns",
    "dns": "pid cgid ts_mono ts_wall ttl qname answers answers_truncated?",
    "migration": "pid from_cgid to_cgid ts_mono ts_wall",
}
#: Types other than a whole number, and bounds: bytes of a text or address, members of a list.
FIELDS = {"comm": "string", "exe_path": "string", "cwd": "string", "path": "string", "path2": "string", "qname": "string", "daddr": "string", "exe_digest": "string", "argv": "array<string>", "answers": "array<string>", "argv_truncated": "boolean", "answers_truncated": "boolean"}
BOUNDS = {"comm": (0, 16), "path": (1, 4096), "path2": (0, 4096), "exe_path": (0, 4096), "cwd": (0, 4096), "qname": (0, 255), "daddr": (32, 32), "exe_digest": (64, 64), "argv": (0, 256), "answers": (0, 4)}
#: Event types of kinds with only one.
TYPES = {"exec": "proc.exec", "fork": "proc.fork", "exit": "proc.exit", "connect": "net.connect", "sendmsg": "net.connect", "unix_connect": "unix.connect", "flow_close": "net.flow_close", "dns": "net.dns", "migration": "alert.cgroup_escape"}

_NAMED = {kind: [(f.rstrip("?"), f.endswith("?")) for f in fields.split()] for kind, fields in KINDS.items()}
COLUMNS = list(dict.fromkeys(f for fields in _NAMED.values() for f, _ in fields))


def _fits(field: str) -> Column:
    """Whether a field that is there has a length within its bounds."""
    if field not in BOUNDS:
        return F.lit(True)
    low, high = BOUNDS[field]
    size = F.size(field) if FIELDS[field].startswith("array") else F.octet_length(field)
    return size.between(low, high)


def decode(lines: DataFrame, line: str = "value") -> DataFrame:
    """``lines`` with kind, type, every field of any kind, and reject_reason: json, version, kind, length, or null.

    length: a field of the kind is missing or longer or shorter than it can be.
    """
    whole = F.try_parse_json(F.col(line))
    parsed = lines.withColumn("_v", F.when(F.schema_of_variant(whole).startswith("OBJECT"), whole))
    get = lambda name, kind: F.try_variant_get("_v", f"$.{name}", kind)
    fields = {f: get(f, FIELDS.get(f, "bigint")) for f in COLUMNS}
    wide = parsed.withColumns({"_version": get("v", "bigint"), "kind": get("kind", "string"), **fields})
    lacks = lambda f, free: (F.col(f).isNull() & F.lit(not free)) | ~F.coalesce(_fits(f), F.lit(True))
    bad = F.lit(None).cast("boolean")
    for kind, names in _NAMED.items():
        bad = F.when(F.col("kind") == kind, reduce(lambda a, b: a | b, (lacks(f, free) for f, free in names))).otherwise(bad)
    reason = (
        F.when(F.col("_v").isNull(), "json").when(F.col("_version").isNull() | (F.col("_version") != VERSION), "version").when(F.coalesce(~F.col("kind").isin(*KINDS), F.lit(True)), "kind")
        .when(bad | ((F.col("kind") == "fs_op") & C.fs_op_type(F.col("op")).isNull()), "length")
    )
    kinds = F.lit(None).cast("string")
    for kind, name in TYPES.items():
        kinds = F.when(F.col("kind") == kind, name).otherwise(kinds)
    told = wide.withColumn("reject_reason", reason)
    good = F.col("reject_reason").isNull()
    # a kind's columns are its own fields, whatever else its line holds
    own = {f: F.when(good & F.col("kind").isin(*(k for k, names in _NAMED.items() if f in dict(names))), F.col(f)) for f in COLUMNS}
    typed = told.withColumns(own).withColumn("type", F.when(good, F.when(F.col("kind") == "fs_op", C.fs_op_type(F.col("op"))).otherwise(kinds)))
    return typed.drop("_v", "_version").select(*lines.columns, "kind", "type", *COLUMNS, "reject_reason")


def split(lines: DataFrame, line: str = "value") -> tuple[DataFrame, DataFrame]:
    """(typed records, quarantined lines with reject_reason)."""
    made = decode(lines, line)
    return made.where("reject_reason is null").drop("reject_reason", line), made.where("reject_reason is not null").select(*lines.columns, "kind", "reject_reason")
