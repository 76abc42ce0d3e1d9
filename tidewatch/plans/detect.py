"""Detection: alerts from base events, escalations, notifications; and the views over sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions import classify as C
from tidewatch.functions import net
from tidewatch.operators import joins, windows


def new_domain_alerts(events: DataFrame, prefixes: DataFrame | None = None) -> DataFrame:
    """First contact of a session with a name (dns) or an address (connect), with its network class and flags.

    One set of contacts a session; ``dns_bypass``: a connect that no resolved name explains;
    ``dns_rebind``: a name that resolves to an address that is not public, by all of ``answers``
    where there are several. ``prefixes`` (as of ``net.prefix_table``) label the address in ``asn``.
    """
    contact = F.when(F.col("type") == "net.dns", F.col("qname")).when(F.col("type") == "net.connect", F.col("addr"))
    first = windows.first_contacts(events, contact)
    connect = F.col("type") == "net.connect"
    inner = lambda a: F.coalesce(net.ip_class(a) != "public", F.lit(False))
    rebound = inner(F.col("addr")) | (F.coalesce(F.exists("answers", inner), F.lit(False)) if "answers" in events.columns else F.lit(False))
    asn = []
    if prefixes is not None:
        first = net.label_addresses(first, prefixes)
        asn = [F.when(connect, F.col("asn")).alias("asn")]
    return first.select(
        "session", "row_id", "us", F.lit("alert.new_domain").alias("type"), "contact", "pid", F.when(connect, net.ip_class(F.col("addr"))).alias("net_class"),
        (connect & F.col("qname").isNull()).alias("dns_bypass"), (~connect & rebound).alias("dns_rebind"), *asn,
    )


def sensitive_alerts(events: DataFrame) -> DataFrame:
    """Every sensitive read."""
    return events.where("type = 'fs.sensitive_read'").select("session", "row_id", "us", F.lit("alert.sensitive_read").alias("type"), "path", "pid")


def burst_alerts(events: DataFrame, window_us: int, threshold: int) -> DataFrame:
    fired = windows.bursts(events, C.burst_class(F.col("type")), window_us, threshold)
    return fired.select("session", "row_id", "us", F.lit("alert.burst").alias("type"), "burst_class", F.col("n").cast("long").alias("n"))


def exfil_precursors(reads: DataFrame, domains: DataFrame, window_us: int) -> DataFrame:
    """Escalations: a sensitive read and a first contact of one session within the window, either order, each pair once."""
    pairs = joins.within(reads, domains, "session", "us", window_us)
    return pairs.select(
        F.col("l.session").alias("session"), F.col("l.row_id").alias("read_id"), F.col("r.row_id").alias("contact_id"), F.greatest("l.us", "r.us").alias("us"),
        F.col("l.path").alias("path"), F.col("l.pid").alias("pid"), F.col("r.contact").alias("host"),
    )


def escape_precursors(events: DataFrame, names: tuple[str, ...] = ("systemd-run", "busctl", "dbus-send"), bus: str = "bus") -> DataFrame:
    """Execs of programs that can leave the session, and connects to the bus socket."""
    base = F.regexp_extract("path", "([^/]*)$", 1)
    return events.where(((F.col("type") == "proc.exec") & base.isin(*names)) | ((F.col("type") == "unix.connect") & F.col("path").endswith(bus))).select("session", "row_id", "us", F.lit("alert.escape_precursor").alias("type"), "path", "pid")


def all_alerts(events: DataFrame, burst_window_us: int, burst_threshold: int) -> DataFrame:
    """All rules' alerts, numbered in each session in time order and, at one event, in rule order.

    The events are read once: what the rules look at is written in narrow form, and each rule reads
    that. First contacts are a partial aggregate and bursts a segmented scan, so no shuffle puts a
    session into one task but that of the alerts' own numbers.
    """
    from tidewatch.plans.tables import materialize

    t = F.col("type")
    looked_at = t.isin("net.dns", "net.connect", "fs.sensitive_read", "alert.cgroup_escape", "alert.escape_precursor", *(x for types in C.SHED_TYPES.values() for x in types))
    events = materialize(events.where(looked_at).select(*(c for c in events.columns if c in ("session", "row_id", "us", "type", "path", "addr", "qname", "answers", "pid"))), "alert-events")
    a = new_domain_alerts(events).select("session", "row_id", "us", "type", F.col("contact").alias("subject"), F.lit(0).alias("rule"))
    b = sensitive_alerts(events).select("session", "row_id", "us", "type", F.col("path").alias("subject"), F.lit(1).alias("rule"))
    c = events.where(F.col("type").isin("alert.cgroup_escape", "alert.escape_precursor")).select("session", "row_id", "us", "type", F.col("path").alias("subject"), F.lit(2).alias("rule"))
    d = burst_alerts(events, burst_window_us, burst_threshold).select("session", "row_id", "us", "type", F.col("burst_class").alias("subject"), F.lit(3).alias("rule"))
    every = a.unionByName(b).unionByName(c).unionByName(d)
    from pyspark.sql import Window

    return every.withColumn("alert_idx", (F.row_number().over(Window.partitionBy("session").orderBy("us", "row_id", "rule")) - 1).cast("long"))


def notifications(alerts: DataFrame) -> DataFrame:
    """Title and body rows; escapes pass through here and are not raised again."""
    t = F.col("type")
    title = F.when(t == "alert.new_domain", "New destination").when(t == "alert.sensitive_read", "Sensitive file read").when(t == "alert.burst", "Burst of activity").otherwise("Escape from the session")
    return alerts.select("session", "alert_idx", title.alias("title"), F.concat(F.lit("session "), "session", F.lit(": "), F.coalesce("subject", F.lit("?"))).alias("body"))


def session_list(events: DataFrame) -> DataFrame:
    """session, profile (where events name one, the first), started, ended and state of all sessions, from their events."""
    ended = F.max(F.when(F.col("type") == "session.end", F.col("us")))
    profile = [F.min_by("profile", F.when(F.col("profile").isNotNull(), F.struct("us", "row_id"))).alias("profile")] if "profile" in events.columns else []
    return events.groupBy("session").agg(*profile, F.min("us").alias("started_us"), ended.alias("ended_us"), F.count("*").alias("events")).withColumn("state", F.when(F.col("ended_us").isNull(), "active").otherwise("ended"))


def session_summary(events: DataFrame) -> DataFrame:
    t = F.col("type")
    crit = C.severity(t, F.lit(False)) == "crit"
    return events.groupBy("session").agg(F.count("*").alias("events"), F.count_if(t == "proc.exec").alias("execs"), F.count_if(t.startswith("fs.")).alias("files"), F.count_if(t == "net.connect").alias("connects"), F.count_if(t == "fs.sensitive_read").alias("sensitive_reads"), F.count_if(crit).alias("critical"))


def event_rows(events: DataFrame, session: str, after: int | None = None, limit: int = 0) -> DataFrame:
    """The session's events after an idx, by idx; all of them with a limit of 0 or less."""
    rows = events.where(F.col("session") == session)
    if after is not None:
        rows = rows.where(F.col("idx") > after)
    rows = rows.orderBy("idx")
    return rows.limit(limit) if limit > 0 else rows


def event_page(events: DataFrame, session: str, after: int | None = None, limit: int = 200) -> DataFrame:
    """The session's events after an idx, by idx. A limit outside 1 to 2000 is 200."""
    return event_rows(events, session, after, limit if 1 <= limit <= 2000 else 200)


def first_of(events: DataFrame, kind: str) -> DataFrame:
    """Each session's first event of a type, whole."""
    return events.where(F.col("type") == kind).groupBy("session").agg(F.min_by(F.struct(*events.columns), F.struct("us", "row_id")).alias("e")).select("e.*")


def next_after(page: DataFrame) -> DataFrame:
    """The idx to ask for next, null after an empty page."""
    return page.agg(F.max("idx").alias("next_after"))


def timeline(events: DataFrame, alerts: DataFrame) -> DataFrame:
    """Load-bearing events, alerts that are stored among them, and alerts that are not, each as a line.

    An alert is stored if an event of its session has its type, time and subject.
    """
    subject = lambda *c: F.concat_ws("|", "session", F.col("us").cast("string"), "type", F.coalesce(*c, F.lit(""))).alias("key")
    stored = F.col("type").startswith("alert.")
    held = events.where(C.load_bearing(F.col("type")) | stored).select("session", F.concat(F.lit("e"), F.col("row_id")).alias("row_id"), "us", "type", F.when(stored, F.coalesce("path", "qname", "addr")).otherwise(F.col("path")).alias("path"), "addr", F.when(stored, F.coalesce("path", "qname", "addr")).otherwise(F.col("qname")).alias("qname"), subject("path", "qname", "addr"))
    more = alerts.select("session", F.concat(F.lit("a"), F.col("row_id"), F.lit("."), F.col("rule")).alias("row_id"), "us", "type", F.col("subject").alias("path"), F.lit(None).cast("string").alias("addr"), F.col("subject").alias("qname"), subject("subject"))
    both = joins.merge_missing(held, more, "key")
    return both.select("session", "row_id", "us", "type", C.describe(F.col("type"), F.col("path"), F.col("addr"), F.col("qname")).alias("line"))


def incident_headers(events: DataFrame, alerts: DataFrame) -> DataFrame:
    """One row a session: span, events, alerts, when it says that it began, and the first program."""
    counts = alerts.groupBy("session").agg(F.count("*").alias("alerts"))
    head = events.groupBy("session").agg(F.min("us").alias("from_us"), F.max("us").alias("to_us"), F.count("*").alias("events"), F.min_by("path", F.when(F.col("type") == "proc.exec", F.struct("us", "row_id"))).alias("first_exec"))
    starts = first_of(events, "session.start").select("session", F.col("us").alias("start_us"))
    head = head.join(starts, "session", "left")
    return head.join(counts, "session", "left").withColumn("alerts", F.coalesce("alerts", F.lit(0).cast("long")))


FOOTER = "What this record can and cannot show is stated in the limits of the library."


def incident_text(lines: DataFrame, headers: DataFrame, session: str, clusters: DataFrame | None = None) -> DataFrame:
    """A session's report as ordered lines: header, timeline, causality clusters, footer; an unknown session is an error."""
    if headers.where(F.col("session") == session).isEmpty():
        raise ValueError(f"unknown session {session}")

    def part(rows: DataFrame, number: int, us: Column, key: Column, line: Column) -> DataFrame:
        return rows.where(F.col("session") == session).select(F.lit(number).alias("part"), us.cast("long").alias("us"), key.cast("string").alias("row_id"), line.alias("line"))

    no, none = F.lit(0), F.lit("")
    out = part(headers, 0, no, none, F.concat(F.lit("incident report for "), "session", F.lit(": "), F.col("events").cast("string"), F.lit(" events, "), F.col("alerts").cast("string"), F.lit(" alerts")))
    body = part(lines, 1, F.col("us"), F.col("row_id"), F.col("line"))
    out = out.unionByName(body if not body.isEmpty() else part(headers, 1, no, none, F.lit("no load-bearing events")))
    if clusters is not None:
        out = out.unionByName(part(clusters, 2, F.col("first_ord"), F.col("run_id"), F.concat(F.lit("run "), "run_id", F.lit(": "), F.col("markers").cast("string"), F.lit(" markers, last status "), F.coalesce("last_status", F.lit("unknown")))))
    return out.unionByName(part(headers, 3, no, none, F.lit(FOOTER))).orderBy("part", "us", "row_id").drop("part")


def causality_clusters(markers: DataFrame) -> DataFrame:
    """Markers by non-empty run: count, interval, last status. markers: session, run_id, ord, status, agent."""
    rows = markers.where("run_id is not null and run_id != ''")
    return rows.groupBy("session", "run_id").agg(F.count("*").alias("markers"), F.min("ord").alias("first_ord"), F.max("ord").alias("last_ord"), F.max_by("status", "ord").alias("last_status"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "status"))), lambda x: x["status"]), ">").alias("steps"))
