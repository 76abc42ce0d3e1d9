"""Joins in time and space: bindings, as-of, interval, profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


DAY_US = 86_400_000_000
SMALL = 100_000  # rows of a table that may be broadcast


def small(rows: DataFrame, limit: int = SMALL) -> DataFrame:
    """``rows`` marked for broadcast if they are counted to ``limit`` at most; else left to Spark's own choice."""
    return F.broadcast(rows) if rows.limit(limit + 1).count() <= limit else rows


def _bound(rows: DataFrame, key: str, bindings: DataFrame, out: str) -> DataFrame:
    """``rows`` (key, us) with the session that held their cgroup at their time, null for none."""
    b = bindings.select(F.col("cgid").alias(key), F.col("bind_us").alias("us"), F.coalesce("unbind_us", F.lit(1 << 62)).alias("__order"), "session", "unbind_us")
    met = as_of(rows.withColumn("__order", F.lit(0).cast("long")), b, key, "us", ["session", "unbind_us"], "__order")
    held = F.col("_seen").isNotNull() & (F.col("r_unbind_us").isNull() | (F.col("us") < F.col("r_unbind_us")))
    return met.withColumn(out, F.when(held, F.col("r_session"))).drop("__order", "_seen", "r_session", "r_unbind_us")


def attribute(records: DataFrame, bindings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(records with their session, quarantined records): the binding of the cgroup at record time.

    bindings: cgid, session, bind_us, unbind_us (null: still bound), which do not overlap for one
    cgid, so only the latest one can hold a record. records: cgid, us.
    """
    joined = _bound(records.drop("session"), "cgid", bindings, "session")
    return joined.where("session is not null"), joined.where("session is null").drop("session")


def migrations(moves: DataFrame, bindings: DataFrame) -> DataFrame:
    """Cgroup escapes: moves (from_cgid, to_cgid, us) with both sides' sessions, 'unknown' for none.

    Moves between two unknown cgroups are dropped; the session is that moved from, else that moved to.
    """
    both = _bound(_bound(moves, "from_cgid", bindings, "s_from"), "to_cgid", bindings, "s_to").where("s_from is not null or s_to is not null")
    both = both.withColumn("session", F.coalesce("s_from", "s_to")).withColumn("type", F.lit("alert.cgroup_escape"))
    return both.withColumn("s_from", F.coalesce("s_from", F.lit("unknown"))).withColumn("s_to", F.coalesce("s_to", F.lit("unknown")))


def as_of(left: DataFrame, right: DataFrame, key: str, time: str, values: list[str], order: str = "row_id", width: int = DAY_US) -> DataFrame:
    """``left`` with the values of the latest ``right`` row of its key at or before its time.

    Both sides are stacked and the last right row is carried forward inside each key and bucket of
    ``width``; each bucket's last right row is carried on to later buckets by itself, so a busy key
    is as many tasks as it has buckets. Right rows come before left rows of the same time. A null
    key meets nothing. The output has ``_seen`` (the right row's time), null without one;
    conditions on its age belong after this, for they must not change which row is the latest.
    """
    packed, bucket = F.struct(F.col(time).alias("t"), *values), F.floor(F.col(time) / width).alias("_bucket")
    r = right.where(F.col(key).isNotNull()).select(F.col(key).alias("_key"), bucket, F.col(time).alias("_time"), F.col(order).alias("_order"), F.lit(0).alias("_side"), packed.alias("_right"))
    l = left.select(F.col(key).alias("_key"), bucket, F.col(time).alias("_time"), F.col(order).alias("_order"), F.lit(1).alias("_side"), F.struct(*left.columns).alias("_left"))
    both = r.unionByName(l, allowMissingColumns=True)
    w = Window.partitionBy("_key", "_bucket").orderBy("_time", "_side", "_order").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = both.withColumn("_here", F.last("_right", ignorenulls=True).over(w)).where("_side = 1")
    # one row a key and bucket
    ends = r.groupBy("_key", "_bucket").agg(F.max_by("_right", F.struct("_time", "_order")).alias("_end"))
    places = l.select("_key", "_bucket").distinct().join(ends, ["_key", "_bucket"], "full")
    earlier = Window.partitionBy("_key").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = places.select("_key", "_bucket", F.last("_end", ignorenulls=True).over(earlier).alias("_before")).where("_before is not null")
    met = met.join(before, ["_key", "_bucket"], "left").withColumn("_last", F.coalesce("_here", "_before"))
    return met.select("_left.*", F.col("_last.t").alias("_seen"), *(F.col(f"_last.{v}").alias(f"r_{v}") for v in values))


def dns_join(connects: DataFrame, answers: DataFrame, window_us: int = 30_000_000) -> DataFrame:
    """``connects`` with qname: the latest answer for the address, if it is still valid and recent.

    answers: addr, us, row_id, qname, ttl_us. A later answer replaces an earlier one even if it
    expires first.
    """
    met = as_of(connects.drop("qname"), answers, "addr", "us", ["qname", "ttl_us"])
    fresh = (F.col("us") <= F.col("_seen") + F.col("r_ttl_us")) & (F.col("us") - F.col("_seen") <= window_us)
    return met.withColumn("qname", F.when(fresh, F.col("r_qname"))).drop("_seen", "r_qname", "r_ttl_us")


def within(left: DataFrame, right: DataFrame, key: str, time: str, width: int) -> DataFrame:
    """Pairs of one key at most ``width`` apart in time, either order, each once: structs l and r.

    Time is cut into buckets of the width and each right row visits three, so only rows that are
    near meet; a busy key is spread over its buckets.
    """
    bucket = F.floor(F.col(time) / width)
    l = left.select(F.col(key).alias("_k"), bucket.alias("_b"), F.struct(*left.columns).alias("l"))
    r = right.select(F.col(key).alias("_k"), F.explode(F.array(bucket - 1, bucket, bucket + 1)).alias("_b"), F.struct(*right.columns).alias("r"))
    return l.join(r, ["_k", "_b"]).where(F.abs(F.col(f"l.{time}") - F.col(f"r.{time}")) <= width).select("l", "r")


def match_profiles(processes: DataFrame, profiles: DataFrame) -> DataFrame:
    """The best profile of each process (pid, exe, argv array): profile and rank, null for none.

    profiles: name, position, exe_basename (array), argv_contains (array). Rank 2: the
    executable's name is listed; 1: an argument contains a listed text; ties go to the earlier
    profile. Names join on equality, so only substring rules meet every process, and these are a
    configuration table.
    """
    base = F.regexp_extract("exe", "([^/]*)$", 1)
    by_name = profiles.select("name", "position", F.explode("exe_basename").alias("_base"))
    exact = processes.withColumn("_base", base).join(by_name, "_base").select("pid", "name", "position", F.lit(2).alias("rank"))
    rules = profiles.select("name", "position", F.explode("argv_contains").alias("_part"))
    part = processes.join(small(rules), F.exists("argv", lambda a: F.contains(a, F.col("_part")))).select("pid", "name", "position", F.lit(1).alias("rank"))
    best = exact.unionByName(part).groupBy("pid").agg(F.min_by(F.struct("name", "rank"), F.struct(-F.col("rank"), "position")).alias("_b"))
    return processes.join(best, "pid", "left").withColumns({"profile": F.col("_b.name"), "rank": F.col("_b.rank")}).drop("_b")


def merge_missing(timeline: DataFrame, alerts: DataFrame, key: str = "row_id") -> DataFrame:
    """The timeline and the alerts it does not hold yet."""
    return timeline.unionByName(alerts.join(timeline.select(key), key, "left_anti"), allowMissingColumns=True)


def run_intervals(markers: DataFrame) -> DataFrame:
    """(session, run, start_us, end_us) of runs from their markers (session, run, us, event): the first run.start to the last run.end; both must be there."""
    at = lambda event: F.when(F.col("event") == event, F.col("us"))
    runs = markers.where("run is not null").groupBy("session", "run").agg(F.min(at("run.start")).alias("start_us"), F.max(at("run.end")).alias("end_us"))
    return runs.where("start_us <= end_us")


def interval_members(events: DataFrame, runs: DataFrame, width: int) -> DataFrame:
    """Events inside runs (session, run, start_us, end_us) of their session; runs visit the buckets they cover."""
    r = runs.select("session", "run", "start_us", "end_us", F.explode(F.sequence(F.floor(F.col("start_us") / width), F.floor(F.col("end_us") / width))).alias("_b"))
    return events.withColumn("_b", F.floor(F.col("us") / width)).join(r, ["session", "_b"]).where("us between start_us and end_us").drop("_b")


def by_ancestor(rows: DataFrame, rules: DataFrame, path: str = "path", prefix: str = "prefix", directories: bool = True) -> DataFrame:
    """``rows`` with the longest rule prefix that is the path or, with ``directories``, a folder above it.

    Paths are expanded to their ancestors, which join on equality; distinct paths are joined once.
    """
    asked = rows.select(F.col(path).alias("_p")).where("_p is not null").distinct()
    parts = F.split("_p", "/")
    ancestors = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.concat_ws("/", F.slice(parts, F.lit(1), n)))
    keyed = asked.select("_p", F.explode(ancestors if directories else F.array("_p")).alias(prefix))
    extra = [c for c in rules.columns if c != prefix]
    best = keyed.join(rules, prefix).groupBy("_p").agg(F.max_by(F.struct(prefix, *extra), F.length(prefix)).alias("_r"))
    return rows.join(best, F.col(path) == F.col("_p"), "left").select(*rows.columns, F.col(f"_r.{prefix}").alias(prefix), *(F.col(f"_r.{c}").alias(c) for c in extra))


PATH_BYTES = 256  # of a path that is looked up


def watched(events: DataFrame, paths: DataFrame, inodes: DataFrame) -> DataFrame:
    """``events`` (path, dev, ino) with rule: that of the whole path, cut to 256 bytes, else that of the pinned (dev, ino); null for none.

    paths: prefix, rule. inodes: dev, ino, rule. Of several rules the least name holds.
    """
    key = F.when(F.octet_length("path") <= PATH_BYTES, F.col("path").cast("binary")).otherwise(F.substring(F.col("path").cast("binary"), 1, PATH_BYTES))
    by_path = paths.groupBy(F.col("prefix").cast("binary").alias("_p")).agg(F.min("rule").alias("_by_path"))
    by_inode = inodes.groupBy(F.col("dev").alias("_d"), F.col("ino").alias("_i")).agg(F.min("rule").alias("_by_inode"))
    met = events.join(small(by_path), key == F.col("_p"), "left").join(small(by_inode), (F.col("dev") == F.col("_d")) & (F.col("ino") == F.col("_i")), "left")
    return met.withColumn("rule", F.coalesce("_by_path", "_by_inode")).drop("_p", "_by_path", "_d", "_i", "_by_inode")


def builtin_watchlist(homes: DataFrame, data_dir: str | None = None) -> DataFrame:
    """(prefix, rule) of the built-in sensitive paths below each home (column home), and of the data folder. A star at a path's end is cut off."""
    from tidewatch.functions.classify import SENSITIVE_PATHS

    names = F.explode(F.array(*(F.lit(p.removeprefix("~").removesuffix("*")) for p in SENSITIVE_PATHS)))
    rules = homes.select("home", names.alias("_n")).select(F.concat("home", "_n").alias("prefix"), F.concat(F.lit("builtin:"), F.substring("_n", 2, 256)).alias("rule")).distinct()
    own = homes.sparkSession.createDataFrame([(data_dir, "data")] if data_dir else [], "prefix string, rule string")
    return rules.unionByName(own)


def with_logs(markers: DataFrame, logs: DataFrame, key: str = "run_id", log_key: str | None = None) -> DataFrame:
    """Markers with the rows of a framework's own log of the same run; markers and rows without a partner are left out."""
    right = logs.withColumnRenamed(log_key or key, "_run")
    return markers.where(F.col(key).isNotNull()).join(small(right), F.col(key) == F.col("_run")).drop("_run")


MOUNTED = "/mnt/host"  # where a guest sees the host's folders


def clean_path(path: Column) -> Column:
    """An absolute path without empty, ``.`` and ``..`` segments; it never leads above the root."""
    none = F.array().cast("array<string>")
    parts = F.aggregate(F.split(path, "/"), none, lambda a, p: F.when(p.isin("", "."), a).when(p == "..", F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.concat(a, F.array(p))))
    return F.concat(F.lit("/"), F.array_join(parts, "/"))


def host_to_guest(rows: DataFrame, mounts: DataFrame, path: str) -> DataFrame:
    """``rows`` with guest_path, by the longest mounted root (tag, host_root) that is the path or above it; null for none."""
    held = by_ancestor(rows.withColumn("__clean", clean_path(F.col(path))), mounts.select(F.col("host_root").alias("__root"), "tag"), "__clean", "__root")
    guest = F.concat(F.lit(MOUNTED + "/"), "tag", F.expr("substring(__clean, length(__root) + 1)"))
    return held.select(*rows.columns, guest.alias("guest_path"))


def guest_to_host(rows: DataFrame, mounts: DataFrame, path: str) -> DataFrame:
    """``rows`` with host_path and unmapped: why there is none (not_under_mount, unknown_tag). ``..`` is resolved first and cannot leave a mount."""
    parts = F.split("__clean", "/")
    known = mounts.select(F.col("tag").alias("__tag"), F.col("host_root").alias("__root"))
    held = rows.withColumn("__clean", clean_path(F.col(path))).withColumn("__under", F.col("__clean").startswith(MOUNTED + "/"))
    held = held.join(known, (F.get(parts, F.lit(3)) == F.col("__tag")) & F.col("__under"), "left")
    rest = F.array_join(F.slice(parts, 5, 1 << 20), "/")
    host = F.when(F.col("__root").isNotNull(), F.when(rest == "", F.col("__root")).otherwise(F.concat("__root", F.lit("/"), rest)))
    why = F.when(~F.col("__under"), "not_under_mount").when(F.col("__root").isNull(), "unknown_tag")
    return held.select(*rows.columns, host.alias("host_path"), why.alias("unmapped"))


def glob_regex(glob: str) -> str:
    """A scope glob as a regular expression: ``*`` and ``?`` stay inside a segment, ``**`` spans any number of them."""
    parts = [p for p in glob.split("/") if p]
    out = ""
    for i, part in enumerate(parts):
        if part == "**":
            out += "(?:/+[^/]+)*"
            continue
        body, j = "", 0
        while j < len(part):
            c = part[j]
            close = part.find("]", j + 2) if c == "[" else -1
            if c == "*":
                body += "[^/]*"
            elif c == "?":
                body += "[^/]"
            elif close > 0:
                body += "[" + part[j + 1 : close].replace("\\", "\\\\").replace("!", "^", 1 if part[j + 1] == "!" else 0) + "]"
                j = close
            else:
                body += "\\" + c if c in r".^$+{}()|\[]" else c
            j += 1
        out += "/+" + body
    return f"^{out}/*$"


def in_scope(path: Column, include: list[str], exclude: list[str], cwd: str = "") -> Column:
    """Included by a glob and excluded by none; ``$SESSION_CWD`` stands for ``cwd``."""
    def matches(globs: list[str]) -> Column:
        out = F.lit(False)
        for g in globs:
            out = out | path.rlike(glob_regex(g.replace("$SESSION_CWD", cwd)))
        return out

    return matches(include) & ~matches(exclude)
