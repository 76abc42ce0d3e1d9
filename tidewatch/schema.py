"""The event envelope, its payload and its closed vocabularies."""

from __future__ import annotations

from pyspark.sql import types as T

#: The event types. ``marker.*`` is an open family beside them.
EVENT_TYPES = (
    "session.start", "session.end", "proc.exec", "proc.fork", "proc.exit", "fs.write_open", "fs.unlink", "fs.rename", "fs.mkdir",
    "fs.chmod", "fs.truncate", "fs.settle", "fs.sensitive_read", "net.connect", "net.dns", "net.flow_close", "unix.connect",
    "alert.new_domain", "alert.sensitive_read", "alert.cgroup_escape", "alert.escape_precursor", "alert.burst", "gap",
)
#: Origins, states, path sources and gap reasons.
ORIGINS = ("kernel", "svc", "enrichment")
STATES = ("observed",)
PATH_SOURCES = ("resolved", "claimed")
GAP_REASONS = ("ringbuf_full", "governor", "daemon_restart")

_TEXT = "comm cwd exe_path path path2 path_source rule proto family qname reason class precursor from to net_class asn correlated_host severity profile exe_known"
_LONG = "ppid uid exit_code utime_ns stime_ns flags mode size size_delta mtime_ns dport ttl bytes_tx bytes_rx dur_ns from_ns to_ns count window_ns"
_BOOL = "dns_bypass dns_rebind exfil_precursor exe_first_seen exe_changed"

#: One nullable struct with every type's fields, so that scans prune to the fields they use.
PAYLOAD = T.StructType(
    [T.StructField(n, T.StringType()) for n in _TEXT.split()]
    + [T.StructField(n, T.LongType()) for n in _LONG.split()]
    + [T.StructField(n, T.BooleanType()) for n in _BOOL.split()]
    + [T.StructField(n, T.ArrayType(T.StringType())) for n in ("argv", "answers", "adopt_caveats")]
    + [T.StructField(n, T.BinaryType()) for n in ("daddr", "prev_digest", "new_digest")]
    + [T.StructField("counts", T.MapType(T.StringType(), T.LongType()))]
    + [T.StructField(n, T.MapType(T.StringType(), T.StringType())) for n in ("host", "marker")]
)

EVENT = T.StructType(
    [
        T.StructField("v", T.ByteType()), T.StructField("type", T.StringType()), T.StructField("session", T.StringType()),
        T.StructField("seg", T.LongType()), T.StructField("idx", T.LongType()), T.StructField("ts_mono", T.LongType()),
        T.StructField("ts_wall", T.LongType()), T.StructField("pid", T.LongType()), T.StructField("origin", T.StringType()),
        T.StructField("state", T.StringType()), T.StructField("data", PAYLOAD),
    ]
)
