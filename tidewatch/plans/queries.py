"""The library's operators as queries over the driver's tables, each with the SQL that checks it."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions import classify as C
from tidewatch.functions import net, text
from tidewatch.operators import govern, joins, ledger, redact, windows
from tidewatch.plans import api, detect, exports, tables
from tidewatch.sources import files, records
from tidewatch.sources.events import EV_SQL, adapt, parse_markers, read_heads, reject_reason

HOUR = 3_600_000_000
QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, ev: bool = True):
    """Register a query; ``ev`` puts the adapted events before its SQL as a table."""
    def add(f):
        QUERIES[name] = f
        if sql:
            more = sql.startswith("--")  # further tables follow
            SQL[name] = f"WITH {EV_SQL}{',' if more else ''} {sql[2:] if more else sql}" if ev else sql
        return f

    return add


def ev(spark, d: str) -> DataFrame:
    return adapt(spark.read.parquet(f"{d}/events.parquet"))


def table(spark, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# first contacts, bursts, correlation

FIRST_SQL = """-- c AS (
  SELECT *, CASE WHEN type = 'net.dns' THEN qname WHEN type = 'net.connect' THEN addr END AS contact FROM ev),
first AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY session, contact ORDER BY us, row_id) AS rn FROM c WHERE contact IS NOT NULL) WHERE rn = 1) """


@query("first_contact", FIRST_SQL + "SELECT session, contact, row_id, us FROM first")
def first_contact(spark, d):
    contact = F.when(F.col("type") == "net.dns", F.col("qname")).when(F.col("type") == "net.connect", F.col("addr"))
    return windows.first_contacts(ev(spark, d), contact).select("session", "contact", "row_id", "us")


@query("new_domain_alerts", FIRST_SQL + """SELECT session, row_id, us, 'alert.new_domain' AS type, contact, pid,
  CASE WHEN type = 'net.connect' THEN CASE WHEN addr LIKE '10.%' THEN 'private' ELSE 'public' END END AS net_class, CASE WHEN type = 'net.connect'
   AND addr LIKE '8.8.8.%' THEN 'Google Public DNS' END AS asn,
  type = 'net.connect' AND qname IS NULL AS dns_bypass, type <> 'net.connect' AND (addr LIKE '10.%' OR k % 7 = 0) AS dns_rebind FROM first""")
def new_domain_alerts(spark, d):
    """Names resolve to their address and, every seventh, to a loopback address besides, written as IPv6."""
    answers = F.array(F.col("addr"), F.when(F.col("k") % 7 == 0, "::ffff:127.0.0.1").otherwise("2001:4860:4860::8888"))
    return detect.new_domain_alerts(ev(spark, d).withColumn("answers", answers), net.prefix_table(spark))


@query("sensitive_alerts", "SELECT session, row_id, us, 'alert.sensitive_read' AS type, path, pid FROM ev WHERE type = 'fs.sensitive_read'")
def sensitive_alerts(spark, d):
    return detect.sensitive_alerts(ev(spark, d))


@query("exfil_precursor", FIRST_SQL + f"""SELECT r.session, r.row_id AS read_id, f.row_id AS contact_id, greatest(r.us, f.us) AS us, r.path, r.pid, f.contact AS host
  FROM ev r JOIN first f ON r.session = f.session AND abs(r.us - f.us) <= {6 * HOUR} WHERE r.type = 'fs.sensitive_read'""")
def exfil_precursor(spark, d):
    e = ev(spark, d)
    return detect.exfil_precursors(detect.sensitive_alerts(e), detect.new_domain_alerts(e), 6 * HOUR)


BURST_CLASS = "CASE type WHEN 'fs.write_open' THEN 'fs.write_open' WHEN 'net.dns' THEN 'flow_dns' END"
BURST_SQL = f"""-- n AS (
  SELECT *, row_number() OVER (PARTITION BY session, cls ORDER BY us, row_id)
            - count(*) OVER (PARTITION BY session, cls ORDER BY us RANGE BETWEEN UNBOUNDED PRECEDING AND {240 * HOUR} PRECEDING) AS n
  FROM (SELECT *, {BURST_CLASS} AS cls FROM ev) WHERE cls IS NOT NULL),
fired AS (SELECT * FROM (SELECT *, lag(n, 1, 0) OVER (PARTITION BY session, cls ORDER BY us, row_id) AS b FROM n) WHERE n >= 5 AND b < 5) """


@query("burst_alerts", BURST_SQL + "SELECT session, row_id, us, 'alert.burst' AS type, cls AS burst_class, CAST(n AS BIGINT) AS n FROM fired")
def burst_alerts(spark, d):
    return detect.burst_alerts(ev(spark, d), 240 * HOUR, 5)


ALERTS_SQL = FIRST_SQL.rstrip() + ", " + BURST_SQL.replace("--", "", 1).rstrip() + """,
raw AS (
  SELECT session, row_id, us, 'alert.new_domain' AS type, contact AS subject, 0 AS rule FROM first
  UNION ALL SELECT session, row_id, us, 'alert.sensitive_read', path, 1 FROM ev WHERE type = 'fs.sensitive_read'
  UNION ALL SELECT session, row_id, us, 'alert.burst', cls, 3 FROM fired),
alerts AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY us, row_id, rule) - 1 AS alert_idx FROM raw) """


PLANTED = {3: "session.start", 7: "alert.cgroup_escape", 8: "alert.escape_precursor"}


def planted(spark, d: str) -> DataFrame:
    """The events with three files' writes made a session's start and two kinds of escapes."""
    kind = F.col("type")
    for k, name in PLANTED.items():
        kind = F.when((F.col("type") == "fs.write_open") & (F.col("k") == k), name).otherwise(kind)
    return ev(spark, d).withColumn("type", kind)


PLANTED_SQL = f"""-- pe AS (SELECT * REPLACE (CASE {' '.join(f"WHEN type = 'fs.write_open' AND k = {k} THEN '{name}'" for k, name in PLANTED.items())}
   ELSE type END AS type) FROM ev),
 {ALERTS_SQL[2:].replace("FROM ev", "FROM pe").replace("FROM fired),", "FROM fired UNION ALL SELECT session, row_id, us, type, path, 2 FROM pe WHERE type LIKE 'alert.%'),")}"""


@query("alert_engine", PLANTED_SQL + "SELECT session, row_id, us, type, subject, rule, alert_idx FROM alerts")
def alert_engine(spark, d):
    """All rules' alerts, escapes that the events hold among them."""
    return detect.all_alerts(planted(spark, d), 240 * HOUR, 5)


@query("session_starts", PLANTED_SQL + "SELECT session, min(row_id) AS row_id, min(us) AS us, arg_min(path, row_id) AS path FROM pe WHERE type = 'session.start' GROUP BY session")
def session_starts(spark, d):
    return detect.first_of(planted(spark, d), "session.start").select("session", "row_id", "us", "path")


@query("type_families", """SELECT row_id, k % 4 = 0 AS is_marker, k % 4 = 1 AS is_gap, k % 4 = 2 AS is_alert FROM ev""")
def type_families(spark, d):
    """Markers, gaps and alerts among the types."""
    m = F.col("k") % 4
    rows = ev(spark, d).withColumn("type", F.when(m == 0, "marker.run.start").when(m == 1, "gap").when(m == 2, "alert.burst").otherwise(F.col("type")))
    t = F.col("type")
    return rows.select("row_id", C.is_marker(t).alias("is_marker"), C.is_gap(t).alias("is_gap"), C.is_alert(t).alias("is_alert"))


@query("notifications", PLANTED_SQL + """SELECT session, alert_idx, CASE type WHEN 'alert.new_domain' THEN 'New destination'
   WHEN 'alert.sensitive_read' THEN 'Sensitive file read' WHEN 'alert.burst' THEN 'Burst of activity' ELSE 'Escape from the session' END AS title,
  'session ' || session || ': ' || coalesce(subject, '?') AS body FROM alerts""")
def notifications(spark, d):
    return detect.notifications(detect.all_alerts(planted(spark, d), 240 * HOUR, 5))


@query("escape_precursors", """SELECT session, row_id, us, 'alert.escape_precursor' AS type, path, pid FROM ev
  WHERE type = 'proc.exec' AND regexp_extract(path, '([^/]*)$', 1) IN ('f1', 'f2', 'f3')""")
def escape_precursors(spark, d):
    return detect.escape_precursors(ev(spark, d), names=("f1", "f2", "f3"))


# network

@query("dns_asof", f"""-- a AS (SELECT addr AS x, us AS seen, row_id AS rid, qname AS q, CAST((60 + k) * 60000000 AS BIGINT) AS ttl FROM ev WHERE type = 'net.dns'),
 c AS (SELECT * FROM ev WHERE type = 'net.connect')
 SELECT c.session, c.row_id, c.us, c.addr, CASE WHEN c.us <= a.seen + a.ttl AND c.us - a.seen <= {HOUR} THEN a.q END AS qname
 FROM c ASOF LEFT JOIN a ON c.addr = a.x AND c.us >= a.seen""")
def dns_asof(spark, d):
    e = ev(spark, d)
    answers = e.where("type = 'net.dns'").withColumn("ttl_us", (60 + F.col("k")) * 60_000_000)
    return joins.dns_join(e.where("type = 'net.connect'").select("session", "row_id", "us", "addr"), answers, HOUR).select("session", "row_id", "us", "addr", "qname")


@query("ip_class", r"""WITH a AS (SELECT doc_id, unnest(regexp_extract_all(text, '[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}')) AS addr FROM documents),
 p AS (SELECT doc_id, addr, list_transform(string_split(addr, '.'), lambda x: CAST(x AS BIGINT)) AS o FROM a),
 n AS (SELECT doc_id, addr, CASE WHEN list_max(o) <= 255 AND NOT regexp_matches(addr,
   '(^|[.])0[0-9]') THEN o[1] * 16777216 + o[2] * 65536 + o[3] * 256 + o[4] END AS n FROM p)
 SELECT addr, count(*) AS hits, CASE WHEN n IS NULL THEN NULL WHEN n BETWEEN 2130706432 AND 2147483647 THEN 'loopback' WHEN n BETWEEN 2851995648
   AND 2852061183 OR n BETWEEN 3758096384 AND 3758096639 THEN 'link_local'
   WHEN n BETWEEN 1681915904 AND 1686110207 THEN 'cgnat' WHEN n BETWEEN 167772160 AND 184549375 OR n BETWEEN 2886729728 AND 2887778303 OR n BETWEEN 3232235520
   AND 3232301055 THEN 'private' ELSE 'public' END AS ip_class
 FROM n GROUP BY addr, n""", ev=False)
def ip_class(spark, d):
    found = table(spark, d, "documents").select(F.explode(F.regexp_extract_all("text", F.lit(r"([0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3})"), F.lit(1))).alias("addr"))
    return found.groupBy("addr").agg(F.count("*").alias("hits")).withColumn("ip_class", net.ip_class(F.col("addr")))


@query("asn_label", "SELECT row_id, addr, CASE WHEN addr LIKE '8.8.8.%' THEN 'Google Public DNS' END AS asn FROM ev WHERE type = 'net.connect'")
def asn_label(spark, d):
    return net.label_addresses(ev(spark, d).where("type = 'net.connect'").select("row_id", "addr"), net.prefix_table(spark))


@query("address_render", "SELECT DISTINCT addr, addr AS rendered FROM ev WHERE addr IS NOT NULL")
def address_render(spark, d):
    return ev(spark, d).select("addr").where("addr is not null").distinct().withColumn("rendered", net.render_address(net.mapped_bytes(F.col("addr"))))


ADDRESSES = (("2001:db8::", 32, "Documentation"), ("2001:db8:40::", 42, "Examples"), ("fd00::", 9, "Local"), ("10.0.0.0", 27, "Lab"))


@query("address_forms", """-- f AS (SELECT row_id, k, row_id % 10 AS m, lpad(lower(to_hex(k)), 2, '0') AS h, lower(to_hex(k)) AS x FROM ev),
 g AS (SELECT *, CASE m WHEN 0 THEN '::ffff:10.0.0.' || k WHEN 1 THEN '0:0:0:0:0:FFFF:0a00:' || x WHEN 2 THEN 'fe80::' || x || '%eth0'
   WHEN 3 THEN 'fd' || h || '::1:0:0:' || x WHEN 4 THEN '2001:DB8:' || x || '::' WHEN 5 THEN '0:0::1'
     WHEN 6 THEN 'ff02::1:' || x WHEN 7 THEN '1::2::' || x WHEN 8 THEN '1:2:3:4:5:6:7:8:' || x ELSE '64:ff9b::192.0.2.' || k END AS addr FROM f)
 SELECT row_id, addr, CASE m WHEN 0 THEN 'private' WHEN 1 THEN 'private' WHEN 2 THEN 'link_local' WHEN 3 THEN 'private' WHEN 4 THEN 'public'
   WHEN 5 THEN 'loopback' WHEN 6 THEN 'link_local' WHEN 9 THEN 'public' END AS ip_class,
   CASE m WHEN 0 THEN '10.0.0.' || k WHEN 1 THEN '10.0.0.' || k WHEN 2 THEN 'fe80:0:0:0:0:0:0:' || x WHEN 3 THEN 'fd' || h || ':0:0:0:1:0:0:' || x
   WHEN 4 THEN '2001:db8:' || x || ':0:0:0:0:0' WHEN 5 THEN '0:0:0:0:0:0:0:1'
     WHEN 6 THEN 'ff02:0:0:0:0:0:1:' || x WHEN 9 THEN '64:ff9b:0:0:0:0:c000:2' || h ELSE '' END AS rendered,
   CASE WHEN m < 2 AND k < 32 THEN 'Lab' WHEN m = 3 THEN 'Local' WHEN m = 4 AND k >= 64 THEN 'Examples' WHEN m = 4 THEN 'Documentation' END AS asn FROM g""")
def address_forms(spark, d):
    """Addresses of both families in many spellings, two of them none: class, full form and longest prefix."""
    k, m, x = F.col("k"), F.col("row_id") % 10, F.lower(F.hex("k"))
    addr = (
        F.when(m == 0, F.concat(F.lit("::ffff:10.0.0."), k)).when(m == 1, F.concat(F.lit("0:0:0:0:0:FFFF:0a00:"), x)).when(m == 2, F.concat(F.lit("fe80::"), x, F.lit("%eth0"))).when(m == 3, F.concat(F.lit("fd"), F.lpad(x, 2, "0"), F.lit("::1:0:0:"), x))
        .when(m == 4, F.concat(F.lit("2001:DB8:"), x, F.lit("::"))).when(m == 5, F.lit("0:0::1")).when(m == 6, F.concat(F.lit("ff02::1:"), x)).when(m == 7, F.concat(F.lit("1::2::"), x)).when(m == 8, F.concat(F.lit("1:2:3:4:5:6:7:8:"), x)).otherwise(F.concat(F.lit("64:ff9b::192.0.2."), k))
    )
    rows = ev(spark, d).select("row_id", addr.alias("addr"))
    rows = rows.withColumn("ip_class", net.ip_class(F.col("addr"))).withColumn("rendered", net.render_address(net.address_bytes(F.col("addr"))))
    return net.label_addresses(rows, net.prefix_table(spark, ADDRESSES)).select("row_id", "addr", "ip_class", "rendered", "asn")


# sessions, pages, classes

@query("session_list", """SELECT session, min(us) AS started_us, max(CASE WHEN k = 99 THEN us END) AS ended_us, count(*) AS events,
  CASE WHEN max(CASE WHEN k = 99 THEN us END) IS NULL THEN 'active' ELSE 'ended' END AS state, arg_min('p' || (k % 5), us) FILTER (k % 4 = 1) AS profile
   FROM ev GROUP BY session""")
def session_list(spark, d):
    e = ev(spark, d).withColumn("profile", F.when(F.col("k") % 4 == 1, F.concat(F.lit("p"), F.col("k") % 5)))
    return detect.session_list(e.withColumn("type", F.when(F.col("k") == 99, "session.end").otherwise(F.col("type"))))


@query("session_summary", """SELECT session, count(*) AS events, count(*) FILTER (type = 'proc.exec') AS execs, count(*) FILTER (type LIKE 'fs.%') AS files,
  count(*) FILTER (type = 'net.connect') AS connects, count(*) FILTER (type = 'fs.sensitive_read') AS sensitive_reads, CAST(0 AS BIGINT) AS critical
   FROM ev GROUP BY session""")
def session_summary(spark, d):
    return detect.session_summary(ev(spark, d))


NUMBERED = "n AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY us, row_id) - 1 AS idx FROM ev)"


@query("event_page", f"-- {NUMBERED} SELECT session, idx, row_id, type FROM n WHERE session = 's7' AND idx > 10 ORDER BY idx LIMIT 20")
def event_page(spark, d):
    return detect.event_page(windows.numbered(ev(spark, d)), "s7", 10, 20).select("session", "idx", "row_id", "type")


@query("event_rows", f"-- {NUMBERED} SELECT session, idx, row_id, type FROM n WHERE session = 's7' AND idx > 2")
def event_rows(spark, d):
    """All that comes after a place; a limit of 0 is none."""
    return detect.event_rows(windows.numbered(ev(spark, d)), "s7", 2, 0).select("session", "idx", "row_id", "type")


@query("event_numbers", f"-- {NUMBERED} SELECT session, row_id, CAST(idx AS BIGINT) AS idx FROM n")
def event_numbers(spark, d):
    return windows.numbered(ev(spark, d)).select("session", "row_id", "idx")


@query("alert_list", ALERTS_SQL + "SELECT session, alert_idx, type FROM alerts WHERE type LIKE 'alert.%' AND session = 's7'")
def alert_list(spark, d):
    alerts = detect.all_alerts(ev(spark, d), 240 * HOUR, 5)
    return alerts.where(C.is_alert(F.col("type")) & (F.col("session") == "s7")).select("session", "alert_idx", "type").orderBy(F.desc("alert_idx"))


@query("lanes_severity", """SELECT row_id, CASE WHEN type LIKE 'proc.%' THEN 'process' WHEN type LIKE 'fs.%' THEN 'filesystem' ELSE 'network' END AS lane,
  CASE WHEN value > 95 THEN 'crit' WHEN type = 'fs.sensitive_read' THEN 'warn' END AS severity FROM ev""")
def lanes_severity(spark, d):
    return ev(spark, d).select("row_id", C.lane(F.col("type")).alias("lane"), C.severity(F.col("type"), F.col("value") > 95).alias("severity"))


@query("event_class", f"""SELECT row_id, CASE type WHEN 'proc.exec' THEN 'exec' WHEN 'net.connect' THEN 'connect' WHEN 'fs.sensitive_read' THEN 'sensitive_read'
   WHEN 'net.dns' THEN 'flow_dns' ELSE type END AS class, type IN ('proc.exec', 'fs.sensitive_read', 'net.connect') AS never_shed,
  CASE type WHEN 'fs.write_open' THEN 2 WHEN 'net.dns' THEN 3 END AS tier, {BURST_CLASS} AS burst_class,
  type IN ('proc.exec', 'fs.sensitive_read', 'net.connect', 'net.dns') AS load_bearing FROM ev""")
def event_class(spark, d):
    t = F.col("type")
    return ev(spark, d).select("row_id", C.event_class(t).alias("class"), C.never_shed(t).alias("never_shed"), C.shed_tier(t).alias("tier"), C.burst_class(t).alias("burst_class"), C.load_bearing(t).alias("load_bearing"))


DESCRIBE = """CASE type WHEN 'proc.exec' THEN 'executed ' || coalesce(path, '?') WHEN 'fs.sensitive_read' THEN 'read sensitive ' || coalesce(path, '?')
  WHEN 'net.connect' THEN 'connected to ' || coalesce(addr, '?') WHEN 'net.dns' THEN 'resolved ' || coalesce(qname, '?') ELSE type END"""


@query("describe_events", f"SELECT row_id, {DESCRIBE} AS line FROM ev")
def describe_events(spark, d):
    return ev(spark, d).select("row_id", C.describe(F.col("type"), F.col("path"), F.col("addr"), F.col("qname")).alias("line"))


@query("capture_switches", """SELECT row_id, CASE WHEN type = 'net.dns' AND k % 2 = 0 THEN 'net.flow_close' ELSE type END AS type FROM ev
  WHERE type IN ('proc.exec', 'net.connect', 'fs.sensitive_read') OR (type = 'fs.write_open' AND k % 3 <> 1) OR (type = 'net.dns' AND k % 3 <> 2)""")
def capture_switches(spark, d):
    """Two profiles switch off files, and names and flows (every second name's event is made a flow's end); exec, connect and sensitive reads cannot be switched off."""
    profiles = spark.createDataFrame([(0, True, None), (1, False, True), (2, None, False)], "p long, capture_file_write boolean, capture_flow boolean")
    off = {c: F.lit(None).cast("boolean") for c in C.SWITCHES if c not in profiles.columns}
    flow = F.when((F.col("type") == "net.dns") & (F.col("k") % 2 == 0), "net.flow_close").otherwise(F.col("type"))
    rows = ev(spark, d).withColumn("p", F.col("k") % 3).withColumn("type", flow).join(joins.small(profiles), "p").withColumns(off)
    return rows.where(C.captured(F.col("type"))).select("row_id", "type")


@query("exe_class", """SELECT DISTINCT p_name, CASE WHEN p_partkey % 3 = 0 AND p_name = 'part 3' THEN 'allowlisted' ELSE 'unclassified' END AS exe_class FROM (
  SELECT 'part ' || (p_partkey % 7) AS p_name, p_partkey % 7 AS p_partkey FROM part)""", ev=False)
def exe_class(spark, d):
    rows = table(spark, d, "part").select(F.concat(F.lit("part "), F.col("p_partkey") % 7).alias("p_name")).distinct()
    return rows.withColumn("exe_class", C.exe_class(F.concat(F.lit("/usr/bin/"), F.col("p_name")), names=("part 3",), prefixes=()))


# ingest

INJECT = {"version": 1, "session": 2, "type_empty": 3, "origin": 4, "state": 5, "type_unknown": 6, "origin_marker": 7, "daddr": 8, "path_source": 9}


@query("validate_rejects", """SELECT row_id, CASE row_id % 97 WHEN 1 THEN 'version' WHEN 2 THEN 'session' WHEN 3 THEN 'type_empty' WHEN 4 THEN 'origin'
   WHEN 5 THEN 'state'
  WHEN 6 THEN 'type_unknown' WHEN 7 THEN 'origin_marker' ELSE CASE WHEN row_id % 97 = 8 AND type = 'net.connect' THEN 'daddr'
   WHEN row_id % 97 = 9 THEN 'path_source' END END AS reject_reason
  FROM ev WHERE row_id % 97 BETWEEN 1 AND 7 OR (row_id % 97 = 8 AND type = 'net.connect') OR row_id % 97 = 9""")
def validate_rejects(spark, d):
    """Events with faults put in by their number; the rejects and their reasons."""
    m = F.col("row_id") % 97
    cols = {
        "v": F.when(m == 1, 2).otherwise(1), "session": F.when(m == 2, "").otherwise(F.col("session")), "type": F.when(m == 3, "").when(m == 6, "proc.unknown").otherwise(F.col("type")),
        "origin": F.when(m == 4, "user").when(m == 7, "enrichment").otherwise("kernel"), "state": F.when(m == 5, "inferred").otherwise("observed"),
        "path_source": F.when(m == 9, "guessed").otherwise("resolved"), "reason": F.lit(None).cast("string"), "daddr_length": F.when(m == 8, 4).otherwise(16),
    }
    return ev(spark, d).withColumn("reject_reason", reject_reason(cols)).where("reject_reason is not null").select("row_id", "reject_reason")


@query("marker_ingest", """SELECT row_id, CASE row_id % 8 WHEN 1 THEN 'not_an_object' WHEN 2 THEN 'undeclared' WHEN 3 THEN 'not_a_scalar' WHEN 5 THEN 'not_a_scalar'
   WHEN 7 THEN 'too_long' END AS reject_reason,
  CASE WHEN row_id % 8 IN (0, 4, 6) THEN 'marker.run.start' END AS type, CASE row_id % 8 WHEN 0 THEN session WHEN 4 THEN '-1.5'
   WHEN 6 THEN CAST(row_id AS VARCHAR) END AS run_id FROM ev""")
def marker_ingest(spark, d):
    """Marker lines whose run id is a text (also one that looks like a number), a number, a fraction or a list; and other faults."""
    m = F.col("row_id") % 8
    text_of = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    value = F.when(m == 3, "1.5").when(m == 4, text_of(F.lit("-1.5"))).when(m == 5, "[1]").when(m == 6, F.col("row_id").cast("string")).otherwise(text_of(F.col("session")))
    run = F.concat(F.lit('{"event": "'), F.when(m == 2, "other").otherwise("run.start"), F.lit('", "agentId": null, "runId": '), value, F.lit(', "token": {"x": 1}'), F.when(m == 7, F.concat(F.lit(', "pad": "'), F.repeat(F.lit("x"), 4096), F.lit('"'))).otherwise(""), F.lit("}"))
    rows = ev(spark, d).select("row_id", F.when(m == 1, "[1]").otherwise(run).alias("value"))
    made = parse_markers(rows, ["run.start", "run.end"], ["runId", "agentId", "token"], ["token"])
    return made.select("row_id", "reject_reason", "type", F.col("fields")["runId"].alias("run_id"))


@query("raw_records", """SELECT row_id, CASE k % 8 WHEN 0 THEN NULL WHEN 1 THEN 'fs.write_open' WHEN 2 THEN 'fs.unlink' WHEN 3 THEN 'fs.rename'
   WHEN 4 THEN 'fs.mkdir' WHEN 5 THEN 'fs.chmod' WHEN 6 THEN 'fs.truncate' ELSE 'fs.sensitive_read' END AS fs_type,
  CASE WHEN k % 2 = 0 THEN 'udp' ELSE 'tcp' END AS proto, CASE WHEN k % 3 = 0 THEN '6' ELSE '4' END AS family, array_to_string(['run', 'a' || k], ' ') AS argv FROM ev""")
def raw_records(spark, d):
    argv = text.argv_of(F.concat(F.lit("run"), F.lit("\x00"), F.lit("a"), F.col("k"), F.lit("\x00")))
    return ev(spark, d).select("row_id", C.fs_op_type(F.col("k") % 8).alias("fs_type"), C.proto_label(F.when(F.col("k") % 2 == 0, 17).otherwise(6)).alias("proto"), C.family_label(F.when(F.col("k") % 3 == 0, 6).otherwise(4)).alias("family"), F.array_join(argv, " ").alias("argv"))


RAW_SQL = """-- m AS (SELECT *, ['exec', 'fork', 'exit', 'fs_op', 'connect', 'sendmsg', 'unix_connect', 'flow_close', 'dns',
   'migration'][row_id % 10 + 1] AS kind, row_id % 23 AS f FROM ev),
 r AS (SELECT *, CASE f WHEN 1 THEN 'json' WHEN 2 THEN 'version' WHEN 3 THEN 'kind' WHEN 4 THEN 'length' WHEN 5 THEN 'length' END AS bad FROM m)
 SELECT row_id, bad AS reject_reason, CASE WHEN f = 3 THEN 'ptrace' WHEN f <> 1 THEN kind END AS kind, CASE WHEN bad IS NULL THEN CASE kind
   WHEN 'exec' THEN 'proc.exec' WHEN 'fork' THEN 'proc.fork' WHEN 'exit' THEN 'proc.exit'
     WHEN 'fs_op' THEN ['fs.write_open', 'fs.unlink', 'fs.rename', 'fs.mkdir', 'fs.chmod', 'fs.truncate', 'fs.sensitive_read'][k % 7 + 1]
   WHEN 'unix_connect' THEN 'unix.connect' WHEN 'flow_close' THEN 'net.flow_close' WHEN 'dns' THEN 'net.dns' WHEN 'migration' THEN 'alert.cgroup_escape'
   ELSE 'net.connect' END END AS type,
   CASE WHEN bad IS NULL THEN pid END AS pid, CASE WHEN bad IS NULL AND kind IN ('fs_op', 'unix_connect') THEN '/f' || k END AS path, CASE WHEN bad IS NULL
   AND kind IN ('exec', 'fork') THEN 1 END AS ppid,
   CASE WHEN bad IS NULL AND kind IN ('connect', 'sendmsg', 'flow_close') THEN k END AS dport, CASE WHEN bad IS NULL
   AND kind = 'exec' THEN 'run a' || k END AS argv, CASE WHEN bad IS NULL AND kind = 'dns' THEN 'h' || k END AS qname, CASE WHEN bad IS NULL
   AND kind = 'migration' THEN k END AS to_cgid FROM r"""


@query("raw_kinds", RAW_SQL)
def raw_kinds(spark, d):
    """Lines of all ten kinds, each with every field there is, and five faults: no JSON, another version, an unknown kind, a missing and an overlong field."""
    m, f, k = F.col("row_id") % 10, F.col("row_id") % 23, F.col("k")
    kind = F.when(f == 3, "ptrace").otherwise(F.element_at(F.array(*map(F.lit, records.KINDS)), (m + 1).cast("int")))
    fields = {name: F.lit(1).cast("long") for name in records.COLUMNS if name not in records.FIELDS} | {"pid": F.when(f != 4, F.col("pid")), "op": k % 7 + 1, "dport": k, "to_cgid": k, "ts_wall": F.col("us"), "comm": F.lit("c"), "exe_path": F.lit("/x"), "cwd": F.lit("/"), "path2": F.lit("/g"), "exe_digest": F.repeat(F.lit("0"), 64)}
    fields |= {"path": F.concat(F.lit("/f"), k), "qname": F.concat(F.lit("h"), k), "daddr": F.repeat(F.lit("a"), 32), "argv": F.array(F.lit("run"), F.concat(F.lit("a"), k)), "answers": F.array(F.lit("::1")), "argv_truncated": F.lit(False), "answers_truncated": F.lit(True)}
    # too long for any kind: it has one of these
    for name, value in (("comm", F.repeat(F.lit("c"), 17)), ("path", F.repeat(F.lit("p"), 4097)), ("daddr", F.lit("aa")), ("qname", F.repeat(F.lit("q"), 256))):
        fields[name] = F.when(f == 5, value).otherwise(fields[name])
    for name in ("ppid", "exit_code", "from_cgid"):
        fields[name] = F.when(f != 5, fields[name])
    line = F.to_json(F.struct(F.when(f == 2, 2).otherwise(1).alias("v"), kind.alias("kind"), *(v.alias(n) for n, v in fields.items())))
    made = records.decode(ev(spark, d).select("row_id", F.when(f == 1, F.concat(F.lit("torn "), line)).otherwise(line).alias("value")))
    return made.select("row_id", "reject_reason", "kind", "type", "pid", "path", "ppid", "dport", F.array_join("argv", " ").alias("argv"), "qname", "to_cgid")


# bindings, profiles, paths

BINDINGS = f"b AS (SELECT k AS cgid, session AS s, us AS bind_us, lead(us) OVER (PARTITION BY k ORDER BY us, row_id) AS unbind_us FROM ev WHERE type = 'proc.exec')"


def _bindings(e: DataFrame) -> DataFrame:
    w = Window.partitionBy("k").orderBy("us", "row_id")
    return e.where("type = 'proc.exec'").select(F.col("k").alias("cgid"), "session", F.col("us").alias("bind_us"), F.lead("us").over(w).alias("unbind_us"))


@query("attribution", f"-- {BINDINGS} SELECT ev.row_id, b.s AS session FROM ev JOIN b ON ev.k = b.cgid AND ev.us >= b.bind_us AND (b.unbind_us IS NULL OR ev.us < b.unbind_us) WHERE ev.type = 'net.connect'")
def attribution(spark, d):
    e = ev(spark, d)
    held, _ = joins.attribute(e.where("type = 'net.connect'").select("row_id", F.col("k").alias("cgid"), "us"), _bindings(e))
    return held.select("row_id", "session")


@query("migration", f"""-- {BINDINGS}, m AS (SELECT row_id, k AS f, (k + 7) % 100 AS t, us FROM ev WHERE type = 'fs.write_open')
  SELECT m.row_id, coalesce(x.s, y.s) AS session, coalesce(x.s, 'unknown') AS s_from, coalesce(y.s, 'unknown') AS s_to FROM m
  LEFT JOIN b x ON m.f = x.cgid AND m.us >= x.bind_us AND (x.unbind_us IS NULL OR m.us < x.unbind_us)
  LEFT JOIN b y ON m.t = y.cgid AND m.us >= y.bind_us AND (y.unbind_us IS NULL OR m.us < y.unbind_us) WHERE x.s IS NOT NULL OR y.s IS NOT NULL""")
def migration(spark, d):
    e = ev(spark, d)
    moves = e.where("type = 'fs.write_open'").select("row_id", F.col("k").alias("from_cgid"), ((F.col("k") + 7) % 100).alias("to_cgid"), "us")
    return joins.migrations(moves, _bindings(e)).select("row_id", "session", "s_from", "s_to")


@query("exe_provenance", """SELECT row_id, row_number() OVER (PARTITION BY session, path, g ORDER BY us, row_id) = 1 AS exe_first_seen,
  coalesce(lag(g) OVER (PARTITION BY session, path ORDER BY us, row_id) <> g, false) AS exe_changed FROM (SELECT *,
   CAST(floor(value) AS BIGINT) % 3 AS g FROM ev WHERE type = 'proc.exec')""")
def exe_provenance(spark, d):
    execs = ev(spark, d).where("type = 'proc.exec'").withColumn("digest", (F.floor("value") % 3).cast("long"))
    return windows.provenance(execs).select("row_id", "exe_first_seen", "exe_changed")


@query("owner_route", """SELECT row_id, last_value(CASE WHEN type = 'proc.exec' THEN 1000 + k % 3 END IGNORE NULLS) OVER (PARTITION BY session
   ORDER BY us, row_id ROWS UNBOUNDED PRECEDING) AS owner_uid FROM ev""")
def owner_route(spark, d):
    e = ev(spark, d).withColumn("uid", 1000 + F.col("k") % 3)
    return windows.owners(e, F.col("type") == "proc.exec").select("row_id", "owner_uid")


def _processes(spark, d: str) -> DataFrame:
    return table(spark, d, "part").select(F.col("p_partkey").alias("pid"), F.concat(F.lit("/bin/"), "p_brand").alias("exe"), F.split("p_name", " ").alias("argv"))


def _profiles(spark, d: str) -> DataFrame:
    p = table(spark, d, "part").select(F.col("p_brand").alias("name"), F.array("p_brand").alias("exe_basename"), F.substring("p_brand", 7, 2).alias("_s")).distinct()
    return p.where("_s like '%1'").withColumn("position", F.row_number().over(Window.orderBy("name"))).withColumn("argv_contains", F.array("_s")).drop("_s")


PROFILE_SQL = """WITH p AS (SELECT p_partkey AS pid, p_brand AS base, string_split(p_name, ' ') AS argv FROM part),
 r AS (SELECT name, s, row_number() OVER (ORDER BY name) AS position FROM (SELECT DISTINCT p_brand AS name, substr(p_brand, 7, 2) AS s FROM part) WHERE s LIKE '%1'),
 m AS (SELECT pid, name, position, CASE WHEN base = name THEN 2 ELSE 1 END AS rank FROM p JOIN r ON base = name OR len(list_filter(argv, lambda a: contains(a, s))) > 0),
 b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY pid ORDER BY rank DESC, position) AS n FROM m) WHERE n = 1) """


@query("profile_match", PROFILE_SQL + "SELECT p.pid, b.name AS profile, b.rank FROM p LEFT JOIN b USING (pid)", ev=False)
def profile_match(spark, d):
    return joins.match_profiles(_processes(spark, d), _profiles(spark, d)).select("pid", "profile", "rank")


@query("detected_agents", PROFILE_SQL + "SELECT name AS profile, min(pid) AS pid, count(*) AS processes, max(rank) = 2 AS corroborated FROM b GROUP BY name", ev=False)
def detected_agents(spark, d):
    m = joins.match_profiles(_processes(spark, d), _profiles(spark, d)).where("profile is not null")
    return m.groupBy("profile").agg(F.min("pid").alias("pid"), F.count("*").alias("processes"), (F.max("rank") == 2).alias("corroborated"))


GLOBS = (["/en/**", "/*/[0-4]*"], ["/en/1*"])


@query("glob_scope", rf"""SELECT page_id, path FROM (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/?#]*(/[^?#]*)', 1) AS path FROM pages)
 WHERE (regexp_matches(path, '{joins.glob_regex(GLOBS[0][0])}') OR regexp_matches(path, '{joins.glob_regex(GLOBS[0][1])}')) AND NOT regexp_matches(path,
   '{joins.glob_regex(GLOBS[1][0])}')""", ev=False)
def glob_scope(spark, d):
    rows = table(spark, d, "pages").select("page_id", F.regexp_extract("url", "^[a-z]+://[^/?#]*(/[^?#]*)", 1).alias("path"))
    return rows.where(joins.in_scope(F.col("path"), *GLOBS))


@query("watchlist", """SELECT row_id, path, CASE WHEN k % 9 = 0 THEN 'rule' || (k % 4) ELSE 'all-data' END AS rule FROM ev WHERE path IS NOT NULL""")
def watchlist(spark, d):
    """The longest rule on the path or a folder above it."""
    e = ev(spark, d)
    listed = e.where("path is not null and k % 9 = 0").select(F.col("path").alias("prefix"), F.concat(F.lit("rule"), F.col("k") % 4).alias("rule")).distinct()
    rules = listed.unionByName(spark.createDataFrame([("/data", "all-data")], "prefix string, rule string"))
    return joins.by_ancestor(e.where("path is not null").select("row_id", "path"), rules).select("row_id", "path", "rule")


@query("watchlist_identity", """SELECT row_id, CASE WHEN k % 4 = 0 THEN 'builtin:.ssh' WHEN k % 4 IN (1, 3)
   AND row_id % 3 = 0 THEN 'pinned' || (row_id % 2) WHEN k % 4 = 2 AND k % 3 = 1 THEN 'data' END AS rule FROM ev WHERE path IS NOT NULL""")
def watchlist_identity(spark, d):
    """Built-in paths of three homes and a data folder; else pinned files by (dev, ino), however they are called."""
    m, home = F.col("k") % 4, F.concat(F.lit("/home/u"), F.col("k") % 3)
    path = F.when(m == 0, F.concat(home, F.lit("/.ssh"))).when((m == 2) & (F.col("k") % 3 == 1), "/var/lib/own").otherwise(F.concat(home, F.lit("/.ssh/id"), F.col("k")))
    e = ev(spark, d).where("path is not null").select("row_id", path.alias("path"), F.lit(1).alias("dev"), F.when(m != 2, F.col("row_id")).alias("ino"))
    homes = spark.createDataFrame([(f"/home/u{i}",) for i in range(3)], "home string")
    pinned = ev(spark, d).where("row_id % 3 = 0").select(F.lit(1).alias("dev"), F.col("row_id").alias("ino"), F.concat(F.lit("pinned"), F.col("row_id") % 2).alias("rule"))
    return joins.watched(e, joins.builtin_watchlist(homes, "/var/lib/own"), pinned).select("row_id", "rule")


@query("path_translate", """SELECT row_id, '/home/u' || (k % 3) || '/data/f' || k AS host_path, '/mnt/host/t' || (k % 3) || '/data/f' || k AS guest_path
   FROM ev WHERE path IS NOT NULL""")
def path_translate(spark, d):
    """Host paths to guest paths by the longest mounted root."""
    e = ev(spark, d).where("path is not null")
    mounts = e.select((F.col("k") % 3).alias("m")).distinct().select(F.concat(F.lit("/home/u"), "m").alias("prefix"), F.concat(F.lit("t"), "m").alias("tag"))
    rows = e.select("row_id", F.concat(F.lit("/home/u"), F.col("k") % 3, "path").alias("host_path"))
    return joins.host_to_guest(rows, mounts.withColumnRenamed("prefix", "host_root"), "host_path").select("row_id", "host_path", "guest_path")


@query("path_back", """SELECT row_id, CASE k % 5 WHEN 0 THEN '/home/u0/data/f' || k WHEN 1 THEN '/home/u1/data/f' || k WHEN 4 THEN '/home/u2' END AS host_path,
   CASE k % 5 WHEN 2 THEN 'not_under_mount' WHEN 3 THEN 'unknown_tag' END AS unmapped FROM ev WHERE path IS NOT NULL""")
def path_back(spark, d):
    """Guest paths to host paths: plain, with dots, out of the mount, of an unknown tag, and a mount itself."""
    k = F.col("k") % 5
    guest = F.when(k == 0, F.concat(F.lit("/mnt/host/t0"), "path")).when(k == 1, F.concat(F.lit("/mnt/host/t1/x/.././"), "path")).when(k == 2, F.concat(F.lit("/mnt/host/t2/../../etc"), "path")).when(k == 3, F.concat(F.lit("/mnt/host/zz"), "path")).otherwise("/mnt/host/t2/")
    mounts = spark.createDataFrame([(f"t{i}", f"/home/u{i}") for i in range(3)], "tag string, host_root string")
    rows = ev(spark, d).where("path is not null").select("row_id", guest.alias("guest_path"))
    return joins.guest_to_host(rows, joins.small(mounts), "guest_path").select("row_id", "host_path", "unmapped")


# ledger

def _ledger_events(spark, d: str, size: int = 16) -> DataFrame:
    e = windows.count_segments(ev(spark, d).select("session", "row_id", "us", "type", "k", "path", "addr", "qname"), size)
    e = e.withColumn("gap_reason", F.when(F.col("k") == 13, "governor").when(F.col("k") == 14, "ringbuf_full"))
    e = e.withColumn("type", F.when(F.col("gap_reason").isNotNull(), "gap").otherwise(F.col("type")))
    return ledger.row_hash(e, ["session", "row_id", "us", "type", "k"])


def _sealed(spark, d: str, points: bool = True):
    e = tables.materialize(_ledger_events(spark, d), "ledger-events")
    s = tables.materialize(ledger.seal(ledger.segment_table(e)), "ledger-segments")
    return e, s, tables.materialize(ledger.checkpoints(s, 4, 1 << 60), "ledger-checkpoints") if points else None


LEDGER = f"""-- {NUMBERED}, g AS (SELECT *, CAST(floor(idx / 16) AS BIGINT) AS seg, CASE WHEN k IN (13, 14) THEN 'gap' ELSE type END AS t FROM n),
 h AS (SELECT *, sha256(unhex('00' || hex('{{"session":"' || session || '","row_id":' || row_id || ',"us":' || us || ',"type":"' || t || '","k":' || k || '}}'))) AS row_hash
   FROM g) """


@query("row_hash", LEDGER + "SELECT row_id, row_hash FROM h")
def row_hash(spark, d):
    return _ledger_events(spark, d).select("row_id", "row_hash")


@query("redacted_hash", r"""WITH d AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN NULL
   ELSE 'token = ⟦R:entropy:m:' || substr(sha256(sha256(CAST(doc_id AS VARCHAR)) || 'salt'), 1, 8) || '⟧' END AS t FROM documents)
 SELECT doc_id, sha256(unhex('00' || hex('{"doc_id":' || doc_id || ',"text_redacted":' || coalesce('"' || t || '"', 'null') || '}'))) AS row_hash FROM d""".replace(":m:", ":l:"), ev=False)
def redacted_hash(spark, d):
    """Texts with a credential, redacted and then hashed; as they were they would be refused."""
    secret = F.concat(F.lit("token = "), F.sha2(F.col("doc_id").cast("string"), 256))
    rows = redact.redact(table(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 3 != 0, secret).alias("text")), "text", "salt")
    return ledger.row_hash(rows, ["doc_id", "text_redacted"]).select("doc_id", "row_hash")


@query("segments_count", LEDGER + """SELECT session, seg, count(*) AS event_count, min(row_id) AS first_row, max(row_id) AS last_row, max(us) AS sealed_us,
  count(*) FILTER (k = 13) AS governor, count(*) FILTER (k = 14) AS ringbuf_full FROM h GROUP BY session, seg""")
def segments_count(spark, d):
    s = ledger.segment_table(_ledger_events(spark, d))
    zero = lambda r: F.coalesce(F.try_element_at("gap", F.lit(r)), F.lit(0).cast("long")).alias(r)
    return s.select("session", "seg", "event_count", "first_row", "last_row", "sealed_us", zero("governor"), zero("ringbuf_full"))


def _level(x: str) -> str:
    pair = f"list_transform(range(1, len({x}) + 1, 2), lambda i: sha256(unhex('01' || {x}[i] || coalesce({x}[i + 1], {x}[i]))))"
    return f"CASE WHEN len({x}) > 1 THEN {pair} ELSE {x} END"


@query("merkle_root", LEDGER.rstrip() + f""", l0 AS (SELECT session, seg, list(row_hash ORDER BY us, row_id) AS x FROM h GROUP BY session, seg),
 l1 AS (SELECT session, seg, {_level('x')} AS x FROM l0), l2 AS (SELECT session, seg, {_level('x')} AS x FROM l1), l3 AS (SELECT session, seg,
   {_level('x')} AS x FROM l2),
 l4 AS (SELECT session, seg, {_level('x')} AS x FROM l3) SELECT session, seg, x[1] AS merkle_root FROM l4""")
def merkle_root(spark, d):
    return ledger.segment_table(_ledger_events(spark, d)).select("session", "seg", "merkle_root")


@query("chain_verify", LEDGER + "SELECT 'chain_link_broken' AS kind, session, seg + 1 AS seg, 'link' AS detail FROM h GROUP BY session, seg HAVING seg = 1 AND (SELECT max(seg) FROM h x WHERE x.session = h.session) >= 2 UNION ALL SELECT 'chain_link_broken', session, 1, 'header' FROM h WHERE seg = 1 GROUP BY session")
def chain_verify(spark, d):
    """Every session's segment 1 is forged: its hash is replaced."""
    _, s, _ = _sealed(spark, d, points=False)
    return ledger.audit_links(s.withColumn("seg_hash", F.when(F.col("seg") == 1, F.sha2("seg_hash", 256)).otherwise(F.col("seg_hash"))))


@query("event_audit", LEDGER + """SELECT 'row_continuity_broken' AS kind, session, seg, (count(*) - 1) || ' of ' || count(*) AS detail FROM h GROUP BY session,
   seg HAVING bool_or(row_id % 50 = 3 AND k NOT IN (13, 14)) AND count(*) FILTER (row_id % 50 = 3) = 1 AND count(*) > 1 AND count(*) FILTER (k IN (13,
   14)) = 0
  UNION ALL SELECT 'gap_dishonest', session, seg, '' FROM h GROUP BY session, seg HAVING false""")
def event_audit(spark, d):
    """Rows are deleted from segments that claim no gap; where one of several is gone, its count tells."""
    e, s, _ = _sealed(spark, d, points=False)
    hit = e.where("row_id % 50 = 3").groupBy("session", "seg").agg(F.count("*").alias("n")).where("n = 1").select("session", "seg")
    clean = s.where((F.col("event_count") > 1) & (F.size("gap") == 0)).select("session", "seg")
    cut = hit.join(clean, ["session", "seg"])
    kept = e.join(cut.withColumn("_hit", F.lit(True)), ["session", "seg"], "left").where("_hit is null or row_id % 50 != 3").drop("_hit")
    return ledger.audit_events(kept, s)


@query("gap_honesty", LEDGER + "SELECT 'gap_dishonest' AS kind, session, seg, '' AS detail FROM h GROUP BY session, seg HAVING count(*) FILTER (k = 13) > 0")
def gap_honesty(spark, d):
    """Headers that hide the governor's gaps."""
    e, s, _ = _sealed(spark, d, points=False)
    hidden = s.withColumn("gap", F.map_filter("gap", lambda k, v: k != "governor"))
    return ledger.audit_events(e, hidden).where("kind = 'gap_dishonest'")


POINTS = LEDGER.rstrip() + ", sg AS (SELECT session, seg, max(us) AS sealed_us FROM h GROUP BY session, seg), c AS (SELECT *, max(seg) OVER (PARTITION BY session) AS top FROM sg), cp AS (SELECT session, seg, sealed_us FROM c WHERE seg % 4 = 3 OR seg = top) "


@query("checkpoints", POINTS + "SELECT session, seg - seg % 4 AS seg_first, seg AS seg_last, sealed_us AS signed_us FROM cp")
def checkpoints(spark, d):
    return _sealed(spark, d)[2].select("session", "seg_first", "seg_last", "signed_us")


@query("ledger_chain", POINTS.rstrip() + """, o AS (SELECT session, seg, lag(session) OVER (ORDER BY lpad(CAST(sealed_us AS VARCHAR), 20,
   '0') || '/' || session || '/' || lpad(CAST(seg AS VARCHAR), 12, '0')) AS before FROM cp)
 SELECT 'checkpoint_chain_broken' AS kind, session, seg, '' AS detail FROM o WHERE session <> 's7' AND before = 's7'""")
def ledger_chain(spark, d):
    """A whole session is deleted; the next checkpoint of another one no longer links."""
    return ledger.audit_ledger_chain(_sealed(spark, d)[2].where("session != 's7'"))


@query("checkpoint_heads", POINTS + "SELECT 'archive_missing' AS kind, session, seg, '' AS detail FROM cp WHERE seg = 3")
def checkpoint_heads(spark, d):
    """Attested segments 3 are gone."""
    _, s, c = _sealed(spark, d)
    return ledger.audit_heads(c, s.where("seg != 3"))


@query("mirror_check", POINTS + "SELECT 'mirror_mismatch' AS kind, session, seg, '' AS detail FROM cp WHERE CAST(substr(session, 2) AS BIGINT) % 5 = 2")
def mirror_check(spark, d):
    """A mirror whose last line of each attested head counts; every fifth session's is forged."""
    c = _sealed(spark, d)[2]
    old = c.select("session", "seg_last", F.lit("old").alias("mirror_hash"), F.lit(1).alias("n"))
    forged = F.substring("session", 2, 20).cast("long") % 5 == 2
    now = c.select("session", "seg_last", F.when(forged, "forged").otherwise(F.col("chain_head")).alias("mirror_hash"), F.lit(2).alias("n"))
    return ledger.audit_mirror(c, old.unionByName(now))


@query("verdict", LEDGER + "SELECT session, CASE WHEN max(seg) >= 1 THEN 2 ELSE 0 END AS code, CAST(CASE WHEN max(seg) >= 2 THEN 2 WHEN max(seg) = 1 THEN 1 ELSE 0 END AS BIGINT) AS findings FROM h GROUP BY session")
def verdict(spark, d):
    _, s, _ = _sealed(spark, d, points=False)
    forged = s.withColumn("seg_hash", F.when(F.col("seg") == 1, F.sha2("seg_hash", 256)).otherwise(F.col("seg_hash")))
    return ledger.verdict(ledger.audit_links(forged), s)


@query("unattested", LEDGER + "SELECT session, seg FROM h GROUP BY session, seg HAVING seg > (SELECT max(x.seg) - max(x.seg) % 4 - 1 FROM h x WHERE x.session = h.session)")
def unattested(spark, d):
    """Segments after the last full checkpoint, once those made at a session's end are taken away."""
    _, s, c = _sealed(spark, d)
    last = s.groupBy("session").agg(F.max("seg").alias("top"))
    full = c.join(last, "session").where("seg_last < top - top % 4")
    return ledger.unattested(s, full).select("session", "seg")


@query("pending_segments", LEDGER + "SELECT session, max(seg) - max(seg) % 4 - 1 AS last_checkpointed, max(seg) % 4 + 1 AS pending FROM h GROUP BY session")
def pending_segments(spark, d):
    _, s, c = _sealed(spark, d)
    last = s.groupBy("session").agg(F.max("seg").alias("top"))
    return ledger.pending(s, c.join(last, "session").where("seg_last < top - top % 4")).select("session", "last_checkpointed", "pending")


@query("trust_card", LEDGER + "SELECT count(DISTINCT session) AS sessions, CAST(0 AS BIGINT) AS failing, count(DISTINCT session || '/' || seg) AS segments, CAST(0 AS BIGINT) AS unattested, 'pass' AS status FROM h")
def trust_card(spark, d):
    e, s, c = _sealed(spark, d)
    return ledger.trust_card(ledger.verdict(ledger.verify(e, s, c), s), s, c)


@query("export_verify", LEDGER + "SELECT session, seg, count(*) AS n FROM h GROUP BY session, seg")
def export_verify(spark, d):
    """Exported rows fall into their segments by place, and their roots agree."""
    e, s, _ = _sealed(spark, d, points=False)
    placed = ledger.export_leaves(e.drop("seg"), s)
    again = ledger.segment_table(placed).select("session", "seg", F.col("event_count").alias("n"), F.col("merkle_root").alias("root"))
    return again.join(s.select("session", "seg", "merkle_root"), ["session", "seg"]).where("root = merkle_root").select("session", "seg", "n")


@query("mutation_diff", LEDGER + "SELECT row_id, CASE row_id % 40 WHEN 1 THEN 'removed' ELSE 'changed' END AS change FROM h WHERE row_id % 40 IN (1, 2)")
def mutation_diff(spark, d):
    e = _ledger_events(spark, d)
    stored = e.where("row_id % 40 != 1").withColumn("row_hash", F.when(F.col("row_id") % 40 == 2, "x").otherwise(F.col("row_hash")))
    return tables.mutations(e, stored)


@query("retention_due", LEDGER.rstrip() + """, sg AS (SELECT session, seg, max(us) AS sealed_us FROM h GROUP BY session, seg), p AS (SELECT *, CAST(substr(session,
   2) AS BIGINT) % 3 AS profile FROM sg)
 SELECT session, seg FROM p WHERE sealed_us <= 1706745600000000 - (7 + profile * 7) * 86400000000 AND seg % 5 <> 0""")
def retention_due(spark, d):
    s = ledger.segment_table(_ledger_events(spark, d)).withColumn("profile", F.substring("session", 2, 20).cast("long") % 3).withColumn("archived_path", F.when(F.col("seg") % 5 == 0, "cold"))
    ttl = s.select("profile").distinct().withColumn("ttl_us", (7 + F.col("profile") * 7) * 86_400_000_000)
    return tables.retention_due(s, ttl, 1_706_745_600_000_000).select("session", "seg")


@query("manifest", "SELECT 1 AS format_version, 'sha256' AS hash, 'none' AS sig, 'json' AS encoding, session, count(*) AS event_count, 'ok' AS status FROM ev GROUP BY session UNION ALL SELECT 1, 'sha256', 'none', 'json', 'nobody', 0, 'unknown_session'")
def manifest(spark, d):
    e = ev(spark, d)
    return tables.manifest(e, e.select("session").distinct().unionByName(spark.createDataFrame([("nobody",)], "session string")))


@query("missing_files", "SELECT DISTINCT session, CASE WHEN CAST(substr(session, 2) AS BIGINT) % 2 = 0 THEN 'verdict' ELSE 'segments' END AS file FROM ev")
def missing_files(spark, d):
    s = ev(spark, d).select("session").distinct()
    files = s.select("session", F.explode(F.array(*map(F.lit, tables.EXPORT_FILES))).alias("file"))
    lost = F.when(F.substring("session", 2, 20).cast("long") % 2 == 0, "verdict").otherwise("segments")
    return tables.missing_files(files.where(F.col("file") != lost), s)


# loss accounting

def _offered(spark, d: str) -> DataFrame:
    t = F.col("type")
    return ev(spark, d).select("session", "row_id", "us", C.event_class(t).alias("class"), C.shed_tier(t).alias("tier"), (C.shed_tier(t).isNotNull() & (F.col("k") % 10 == 0)).alias("shed"))


LOST = "-- o AS (SELECT session, us, CASE type WHEN 'fs.write_open' THEN 'fs.write_open' ELSE 'flow_dns' END AS class FROM ev WHERE type IN ('fs.write_open', 'net.dns') AND k % 10 = 0) "


@query("gap_totals", LOST + "SELECT session, 'governor' AS reason, class, count(*) AS lost, min(f) AS from_us, max(t) AS to_us FROM (SELECT *, min(us) OVER w AS f, max(us) OVER w AS t FROM o WINDOW w AS (PARTITION BY session, floor(us / 5000000))) GROUP BY session, class")
def gap_totals(spark, d):
    return govern.loss_totals(govern.gap_rows(_offered(spark, d)))


@query("shed_gaps", LOST + "SELECT session, 'governor' AS reason, count(*) AS lost, min(us) AS from_us, max(us) AS to_us FROM o GROUP BY session, floor(us / 5000000)")
def shed_gaps(spark, d):
    g = govern.gap_rows(_offered(spark, d))
    return g.select("session", "reason", F.aggregate(F.map_values("counts"), F.lit(0).cast("long"), lambda a, x: a + x).alias("lost"), "from_us", "to_us")


@query("final_gap", LOST + "SELECT session, 'governor' AS reason, count(*) FILTER (class = 'fs.write_open') AS fs_write, count(*) FILTER (class = 'flow_dns') AS flow_dns, min(us) AS from_us, max(us) AS to_us FROM o GROUP BY session")
def final_gap(spark, d):
    g = govern.final_gap(govern.gap_rows(_offered(spark, d)))
    n = lambda c: F.coalesce(F.try_element_at("counts", F.lit(c)), F.lit(0).cast("long"))
    return g.select("session", "reason", n("fs.write_open").alias("fs_write"), n("flow_dns").alias("flow_dns"), "from_us", "to_us")


@query("conservation", LOST + "SELECT session, class, count(*) AS offered_lost, CAST(0 AS BIGINT) AS lost FROM o WHERE CAST(substr(session, 2) AS BIGINT) % 4 = 1 GROUP BY session, class")
def conservation(spark, d):
    """The gap rows of every fourth session were lost; its books don't balance, and all others do."""
    o = _offered(spark, d)
    kept = govern.gap_rows(o).where(F.substring("session", 2, 20).cast("long") % 4 != 1)
    return govern.conservation(o, kept).select("session", "class", (F.col("offered") - F.col("admitted")).alias("offered_lost"), "lost")


#: A bucket of 3 tokens in each of 4 tiers, refilled from the highest, row by row.
BUCKET_SQL = f"""WITH RECURSIVE {EV_SQL}, c AS (
  SELECT session, row_id, us, CASE type WHEN 'proc.exec' THEN 'exec' WHEN 'net.connect' THEN 'connect' WHEN 'fs.sensitive_read' THEN 'sensitive_read'
   WHEN 'net.dns' THEN 'flow_dns' ELSE type END AS class, CASE type WHEN 'fs.write_open' THEN 2 WHEN 'net.dns' THEN 3 END AS tier FROM ev),
n AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY us, row_id) AS rn FROM c WHERE tier IS NOT NULL),
b AS (
  SELECT session, row_id, us, rn, false AS shed, 3.0::DOUBLE AS t0, 3.0::DOUBLE AS t1, CASE tier WHEN 2 THEN 2.0::DOUBLE ELSE 3.0::DOUBLE END AS t2,
   CASE tier WHEN 3 THEN 2.0::DOUBLE ELSE 3.0::DOUBLE END AS t3 FROM n WHERE rn = 1
  UNION ALL
  SELECT session, row_id, us, rn, CASE tier WHEN 2 THEN t2 + a2 < 1 ELSE t3 + a3 < 1 END, t0 + a0, t1 + a1, t2 + a2 - CASE WHEN tier = 2
   AND t2 + a2 >= 1 THEN 1 ELSE 0 END, t3 + a3 - CASE WHEN tier = 3 AND t3 + a3 >= 1 THEN 1 ELSE 0 END
  FROM (SELECT *, least(3 - t0, f1) AS a0 FROM (SELECT *, least(3 - t1, f2) AS a1, f2 - least(3 - t1, f2) AS f1 FROM (SELECT *, least(3 - t2, f3) AS a2,
   f3 - least(3 - t2, f3) AS f2 FROM (
    SELECT *, least(3 - t3, f) AS a3, f - least(3 - t3, f) AS f3 FROM (
      SELECT n.session, n.row_id, n.us, n.rn, n.tier, b.t0, b.t1, b.t2, b.t3, greatest(n.us - b.us, 0)::DOUBLE * 0.00002::DOUBLE / 1e6::DOUBLE AS f
   FROM b JOIN n ON n.session = b.session AND n.rn = b.rn + 1))))))
SELECT c.session, c.row_id, c.us, c.class, c.tier, coalesce(b.shed, false) AS shed FROM c LEFT JOIN b USING (row_id)"""


@query("governor_replay", BUCKET_SQL, ev=False)
def governor_replay(spark, d):
    return govern.shed(_offered(spark, d).drop("shed"), rate=0.00002, burst=3)


#: A segment closes with its 20th event, or the first that is 5 days after its first.
AGE_SQL = f"""WITH RECURSIVE {EV_SQL}, n AS (SELECT session, row_id, us, type, row_number() OVER (PARTITION BY session ORDER BY us, row_id) AS rn FROM ev),
r AS (
  SELECT *, CAST(0 AS BIGINT) AS seg, 1 AS c, us AS start FROM n WHERE rn = 1
  UNION ALL
  SELECT n.session, n.row_id, n.us, n.type, n.rn, CASE WHEN done THEN seg + 1 ELSE seg END, CASE WHEN done THEN 1 ELSE c + 1 END, CASE WHEN done THEN n.us ELSE start END
  FROM (SELECT *, c >= 20 OR us - start >= {5 * 24 * HOUR} AS done FROM r) x JOIN n ON n.session = x.session AND n.rn = x.rn + 1)
SELECT session, row_id, us, type, seg FROM r"""


@query("segment_age", AGE_SQL, ev=False)
def segment_age(spark, d):
    return windows.segments(ev(spark, d).select("session", "row_id", "us", "type"), 20, 5 * 24 * HOUR)


@query("map_equality", "SELECT row_id, k % 2 = 0 AS same FROM ev")
def map_equality(spark, d):
    zero, k = F.lit(0).cast("long"), F.col("k")
    a = F.create_map(F.lit("a"), k, F.lit("b"), zero)
    b = F.create_map(F.lit("a"), F.when(k % 2 == 0, k).otherwise(k + 1))
    return ev(spark, d).select("row_id", text.same_counts(a, b).alias("same"))


# reports

@query("timeline_union", ALERTS_SQL.rstrip() + f""", t AS (SELECT session, 'e' || row_id AS row_id, us, type, {DESCRIBE} AS line FROM ev WHERE type <> 'fs.write_open')
 SELECT * FROM t UNION ALL SELECT session, 'e' || (row_id + 1000000000), us, 'alert.sensitive_read', 'alert: sensitive read of ' || path FROM ev
   WHERE type = 'fs.sensitive_read' AND k % 2 = 0
 UNION ALL SELECT session, 'a' || row_id || '.' || rule, us, type, CASE type WHEN 'alert.new_domain' THEN 'first contact with ' || coalesce(subject, '?')
   WHEN 'alert.sensitive_read' THEN 'alert: sensitive read of ' || coalesce(subject, '?') ELSE 'alert: ' || substr(type, 7) END FROM alerts
   WHERE type <> 'alert.sensitive_read' OR CAST(substr(subject, 8) AS BIGINT) % 2 = 1""")
def timeline_union(spark, d):
    """Half of the alerts of sensitive reads are stored among the events; they appear once."""
    e = ev(spark, d)
    stored = e.where("type = 'fs.sensitive_read' and k % 2 = 0").withColumn("row_id", F.col("row_id") + 1_000_000_000).withColumn("type", F.lit("alert.sensitive_read"))
    return detect.timeline(e.unionByName(stored), detect.all_alerts(e, 240 * HOUR, 5))


@query("incident_headers", PLANTED_SQL.rstrip() + """, a AS (SELECT session, count(*) AS alerts FROM alerts GROUP BY session),
 h AS (SELECT session, min(us) AS from_us, max(us) AS to_us, count(*) AS events, arg_min(path, row_id) FILTER (type = 'proc.exec') AS first_exec,
   min(us) FILTER (type = 'session.start') AS start_us FROM pe GROUP BY session)
 SELECT h.*, coalesce(a.alerts, 0) AS alerts FROM h LEFT JOIN a USING (session)""")
def incident_headers(spark, d):
    e = planted(spark, d)
    return detect.incident_headers(e, detect.all_alerts(e, 240 * HOUR, 5))


@query("causality_clusters", "SELECT 'c' || (conv_id % 50) AS session, CAST(conv_id AS VARCHAR) AS run_id, count(*) AS markers, min(turn) AS first_ord, max(turn) AS last_ord, arg_max(role, turn) AS last_status, string_agg(role, '>' ORDER BY turn, role) AS steps FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id", ev=False)
def causality_clusters(spark, d):
    c = table(spark, d, "conversations")
    return detect.causality_clusters(c.select(F.concat(F.lit("c"), F.col("conv_id") % 50).alias("session"), F.col("conv_id").cast("string").alias("run_id"), F.col("turn").alias("ord"), F.col("role").alias("status"), F.lit("").alias("agent")))


@query("run_effects", f"""-- r AS (SELECT session, us // {72 * HOUR} AS run, min(us) AS a, max(us) AS b FROM ev WHERE type = 'proc.exec' GROUP BY session,
   us // {72 * HOUR})
 SELECT r.session, r.run, count(*) AS effects FROM r JOIN ev ON ev.session = r.session AND ev.us BETWEEN r.a AND r.b AND ev.type LIKE 'fs.%' GROUP BY r.session, r.run""")
def run_effects(spark, d):
    e = ev(spark, d)
    execs = e.where("type = 'proc.exec'").select("session", F.expr(f"us div {72 * HOUR}").alias("run"), "us")
    runs = joins.run_intervals(execs.select("*", F.explode(F.array(F.lit("run.start"), F.lit("run.end"))).alias("event")))
    return joins.interval_members(e.where("type like 'fs.%'"), runs, 24 * HOUR).groupBy("session", "run").agg(F.count("*").alias("effects"))


@query("inferred_clusters", f"SELECT row_id, CAST(sum(g) OVER (PARTITION BY session ORDER BY us, row_id) AS BIGINT) AS cluster FROM (SELECT *, coalesce(CAST(us - lag(us) OVER (PARTITION BY session ORDER BY us, row_id) > {24 * HOUR} AS INTEGER), 0) AS g FROM ev)")
def inferred_clusters(spark, d):
    return windows.inferred_clusters(ev(spark, d), 24 * HOUR).select("row_id", "cluster")


RUNS_SQL = f"""p AS (SELECT session, k, us AS s, lead(us) OVER (PARTITION BY session, k ORDER BY us, row_id) AS f FROM ev WHERE type = 'proc.exec'),
 t AS (SELECT session, k, s, session || '|' || (k + 100) || '|' || s AS root FROM p WHERE k = 0 OR NOT EXISTS (SELECT 1 FROM p q WHERE q.session = p.session
   AND q.k = p.k // 2 AND q.s <= p.s AND (q.f IS NULL OR p.s < q.f))
   UNION ALL SELECT p.session, p.k, p.s, t.root FROM p JOIN p q ON q.session = p.session AND q.k = p.k // 2 AND p.k > 0 AND q.s <= p.s
   AND (q.f IS NULL OR p.s < q.f) JOIN t ON t.session = q.session AND t.k = q.k AND t.s = q.s),
 h AS (SELECT ev.session, ev.row_id, ev.us, coalesce(t.root, ev.session || '|' || ev.pid) AS root FROM ev LEFT JOIN p ON p.session = ev.session
   AND p.k = ev.k AND p.s <= ev.us AND (p.f IS NULL OR ev.us < p.f) LEFT JOIN t ON t.session = p.session AND t.k = p.k AND t.s = p.s)"""


@query("inferred_runs", f"WITH RECURSIVE {EV_SQL}, {RUNS_SQL} SELECT row_id, root, 'inferred' AS label, CAST(sum(g) OVER (PARTITION BY session, root ORDER BY us, row_id) AS BIGINT) AS cluster FROM (SELECT *, coalesce(CAST(us - lag(us) OVER (PARTITION BY session, root ORDER BY us, row_id) > {24 * HOUR} AS INTEGER), 0) AS g FROM h)", ev=False)
def inferred_runs(spark, d):
    """Events clustered by process tree and pauses. A program's process lasts until its pid comes again; its parent has half its number."""
    e = ev(spark, d)
    again = Window.partitionBy("session", "k").orderBy("us", "row_id")
    processes = e.where("type = 'proc.exec'").select("session", "pid", F.when(F.col("k") > 0, F.floor(F.col("k") / 2) + 100).alias("ppid"), F.col("us").alias("start_us"), F.lead("us").over(again).alias("end_us"))
    return windows.inferred_runs(e, processes, 24 * HOUR).select("row_id", "root", "label", "cluster")


@query("process_lineage", """WITH RECURSIVE t AS (SELECT o_orderkey AS pid, CASE WHEN o_orderkey % 8 <> 0 THEN o_orderkey // 2 END AS ppid FROM orders),
 r AS (SELECT pid, pid AS root, ppid AS up, 0 AS hops FROM t UNION ALL SELECT r.pid, t.pid, t.ppid, hops + 1 FROM r JOIN t ON r.up = t.pid
   AND t.pid <> r.root WHERE hops < 64)
 SELECT pid, arg_max(root, hops) AS root, max(hops) AS hops, false AS cycle FROM r GROUP BY pid""", ev=False)
def process_lineage(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("pid"), F.when(F.col("o_orderkey") % 8 != 0, F.expr("o_orderkey div 2")).alias("ppid"))
    return windows.lineage(o)


# files and texts

@query("file_changes", """WITH o AS (SELECT 'p' || (doc_id // 20) AS path, doc_id % 20 AS scan_no, doc_id // 60 AS mtime, (doc_id % 20) // 3 AS size,
   CAST((doc_id % 20) // 6 AS VARCHAR) AS digest FROM documents WHERE doc_id % 20 <> 11),
 n AS (SELECT *, CAST(coalesce(scan_no - lag(scan_no) OVER (PARTITION BY path ORDER BY scan_no) <> 1, true) AS INTEGER) AS f FROM o),
 i AS (SELECT *, sum(f) OVER (PARTITION BY path ORDER BY scan_no) AS isl FROM n),
 s AS (SELECT * FROM (SELECT *, lag(mtime) OVER w = mtime AND lag(size) OVER w = size AS still FROM i WINDOW w AS (PARTITION BY path, isl ORDER BY scan_no)) WHERE still),
 c AS (SELECT *, lag(digest) OVER w AS prev_digest, size - coalesce(lag(size) OVER w, 0) AS size_delta FROM s WINDOW w AS (PARTITION BY path, isl ORDER BY scan_no))
 SELECT path, scan_no, digest, prev_digest, size_delta FROM c WHERE prev_digest IS NULL OR prev_digest <> digest""", ev=False)
def file_changes(spark, d):
    i = F.col("doc_id") % 20
    o = table(spark, d, "documents").where(i != 11).select(F.concat(F.lit("p"), F.expr("doc_id div 20")).alias("path"), i.alias("scan_no"), F.expr("doc_id div 60").alias("mtime"), F.expr("(doc_id % 20) div 3").alias("size"), F.expr("(doc_id % 20) div 6").cast("string").alias("digest"))
    return windows.settled_changes(o).select("path", "scan_no", "digest", "prev_digest", "size_delta")


@query("digest_check", """SELECT doc_id, CASE doc_id % 7 WHEN 0 THEN 'missing' WHEN 1 THEN 'mismatch' WHEN 2 THEN 'not_regular' WHEN 3 THEN 'untranslatable'
   ELSE 'match' END AS note FROM documents""", ev=False)
def digest_check(spark, d):
    """Recorded digests of guest paths against the files that stand at the host's paths now."""
    m, name = F.col("doc_id") % 7, F.concat(F.lit("/d"), F.col("doc_id"))
    docs = table(spark, d, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("digest"))
    mounts = spark.createDataFrame([("t", "/home/u")], "tag string, host_root string")
    guest = docs.select("doc_id", F.col("digest").alias("new_digest"), F.concat(F.when(m == 3, "/elsewhere").otherwise("/mnt/host/t"), name).alias("guest_path"))
    settled = joins.guest_to_host(guest, joins.small(mounts), "guest_path").withColumnRenamed("host_path", "local_path")
    present = docs.where(m != 0).select(F.concat(F.lit("/home/u"), name).alias("path"), F.when(m == 2, "fifo").otherwise("file").alias("kind"), F.when(m == 1, F.sha2("digest", 256)).otherwise(F.col("digest")).alias("digest"))
    return files.check_digests(settled, present).select("doc_id", "note")


def _rule_counts_sql(source: str) -> str:
    """Counts of every rule; the patterns are read alike by Spark, DuckDB and Python."""
    return " UNION ALL ".join(f"""SELECT '{r.name}' AS rule, '{r.cls}' AS class, CAST(coalesce(sum(n), 0) AS BIGINT) AS hits,
   count(*) FILTER (n > 0) AS docs FROM (SELECT len(regexp_extract_all(coalesce(text, ''), '{r.pattern.replace("'", "''")}')) AS n FROM {source})""" for r in redact.RULES)


@query("redact_rule_counts", _rule_counts_sql("documents"), ev=False)
def redact_rule_counts(spark, d):
    return redact.rule_counts(table(spark, d, "documents"), "text")


@query("redact_rule_counts_all", "WITH t AS (SELECT text FROM documents UNION ALL SELECT html FROM pages UNION ALL SELECT text FROM conversations) " + _rule_counts_sql("t"), ev=False)
def redact_rule_counts_all(spark, d):
    """All rules over all tables of texts."""
    texts = [table(spark, d, t).select(F.col(c).alias("text")) for t, c in (("documents", "text"), ("pages", "html"), ("conversations", "text"))]
    return redact.rule_counts(texts[0].unionByName(texts[1]).unionByName(texts[2]), "text")


def _redacted(spark, d: str) -> DataFrame:
    return redact.redact(table(spark, d, "documents").select("doc_id", "text"), "text", "salt")


def _half_redacted(spark, d: str) -> DataFrame:
    """Redacted texts among which those of even ids were left as they are: what an audit must find."""
    raw = F.col("doc_id") % 2 == 0
    return _redacted(spark, d).withColumn("text_redacted", F.when(raw, F.col("text")).otherwise(F.col("text_redacted")))


@query("redact_findings")
def redact_findings(spark, d):
    return redact.findings(_redacted(spark, d), "doc_id")


@query("redact_leaks", r"""SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, 'token = "([0-9a-f]{40})"', 1)) AS secret FROM documents
   WHERE doc_id % 2 = 0""", ev=False)
def redact_leaks(spark, d):
    """40-digit tokens of the documents that are still there in a table whose even rows were not redacted."""
    docs = table(spark, d, "documents")
    secrets = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit('token = "([0-9a-f]{40})"'), F.lit(1))).alias("secret")).distinct()
    return redact.leaks(_half_redacted(spark, d), secrets, "doc_id", "text_redacted")


@query("secret_reuse")
def secret_reuse(spark, d):
    return redact.reuse(redact.findings(_redacted(spark, d), "doc_id"), "doc_id")


@query("redact_gates", """SELECT CASE WHEN count(*) FILTER (regexp_matches(text, 'token = "[0-9a-f]{40}"')) > 0 THEN 1.0 END AS recall, CASE
   WHEN (SELECT count(*) FROM benchmark) > 0 THEN 0.0 END AS false_positives, CAST(0 AS BIGINT) AS leaks FROM documents""", ev=False)
def redact_gates(spark, d):
    """Documents that hold a token must change and lose it; the items of the benchmark, plain prose, must not change."""
    docs = table(spark, d, "documents").select("text", F.regexp_extract("text", 'token = "([0-9a-f]{40})"', 1).alias("secret")).where("secret != ''")
    rows = docs.unionByName(table(spark, d, "benchmark").select("text", F.lit("").alias("secret")))
    done = redact.redact(rows, "text", "salt").select((F.col("secret") != "").alias("must_redact"), (F.size("findings") > 0).alias("changed"), ((F.col("secret") != "") & F.contains("text_redacted", F.col("secret"))).alias("leaked"))
    return redact.gates(done)


@query("argv_flags", """SELECT row_id, CASE WHEN k % 2 = 0 THEN 'run --token ⟦R:entropy:s:' || substr(sha256('v' || k || 'salt'), 1, 8) || '⟧'
   ELSE 'run --name v' || k END AS argv FROM ev""")
def argv_flags(spark, d):
    argv = F.array(F.lit("run"), F.when(F.col("k") % 2 == 0, "--token").otherwise("--name"), F.concat(F.lit("v"), F.col("k")))
    return ev(spark, d).select("row_id", F.array_join(redact.mark_operands(argv, "salt"), " ").alias("argv"))


@query("argv_redacted", """SELECT row_id, CASE k % 3 WHEN 0 THEN 'run --ApiKey ⟦R:entropy:s:' || substr(sha256('v' || k || 'salt'), 1, 8) || '⟧'
 WHEN 1 THEN 'run token=⟦R:entropy:l:' || substr(sha256(sha256('t' || row_id) || 'salt'), 1, 8) || '⟧ x' ELSE 'run --name v' || k END AS argv FROM ev""")
def argv_redacted(spark, d):
    """Argument lists: operands of flags, secrets inside an argument, and plain ones."""
    key, k = F.concat(F.lit("v"), F.col("k")), F.col("k") % 3
    argv = F.when(k == 0, F.array(F.lit("run"), F.lit("--ApiKey"), key)).when(k == 1, F.array(F.lit("run"), F.concat(F.lit("token="), F.sha2(F.concat(F.lit("t"), "row_id").cast("binary"), 256)), F.lit("x"))).otherwise(F.array(F.lit("run"), F.lit("--name"), key))
    return redact.redact_argv(ev(spark, d).select("row_id", argv.alias("argv")), "argv", "salt").select("row_id", F.array_join("argv_redacted", " ").alias("argv"))


@query("path_redacted", """WITH p AS (SELECT row_id, sha256('p' || row_id) AS h, k % 2 = 0 AS resolved, CASE k % 3 WHEN 0 THEN 'objects' WHEN 1 THEN 'commits'
   ELSE 'files' END AS dir FROM (SELECT event_id AS row_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events))
 SELECT row_id, '/repo/' || dir || '/ab/' || CASE WHEN resolved AND dir <> 'files' THEN h ELSE '⟦R:entropy:l:' || substr(sha256(h || 'salt'), 1,
   8) || '⟧' END || '/README' AS path FROM p""", ev=False)
def path_redacted(spark, d):
    """Object ids stay in paths that are known to exist, below a store; elsewhere they are marked."""
    k = F.get_json_object("props", "$.k").cast("long")
    store = F.when(k % 3 == 0, "objects").when(k % 3 == 1, "commits").otherwise("files")
    path = F.concat(F.lit("/repo/"), store, F.lit("/ab/"), F.sha2(F.concat(F.lit("p"), "event_id").cast("binary"), 256), F.lit("/README"))
    rows = table(spark, d, "events").select(F.col("event_id").alias("row_id"), path.alias("path"), (k % 2 == 0).alias("resolved"))
    return redact.redact_paths(rows, "path", F.col("resolved"), "salt").select("row_id", F.col("path_redacted").alias("path"))


@query("token_shapes", r"""SELECT item_id, w, length(w) AS n, regexp_matches(w, '^[0-9a-fA-F]+$') AS is_hex, regexp_matches(w, '^[A-Za-z0-9+/_-]+={0,2}$') AS is_base64,
  CASE WHEN strlen(w) <= 20 THEN 's' WHEN strlen(w) <= 40 THEN 'm' WHEN strlen(w) <= 80 THEN 'l' ELSE 'xl' END AS len_class, substr(sha256(w || 'salt'),
   1, 8) AS checksum,
  CASE WHEN length(w) <= 10 THEN w ELSE left(w, 6) || '…' || right(w, 4) END AS short_id FROM (SELECT DISTINCT item_id, unnest(string_split(text,
   ' ')) AS w FROM benchmark) WHERE w <> ''""", ev=False)
def token_shapes(spark, d):
    w = F.col("w")
    rows = table(spark, d, "benchmark").select("item_id", F.explode(F.split("text", " ")).alias("w")).where("w != ''").distinct()
    return rows.select("item_id", "w", F.length(w).cast("long").alias("n"), text.is_hex(w).alias("is_hex"), text.is_base64(w).alias("is_base64"), text.length_class(w).alias("len_class"), text.salted_checksum(w, "salt").alias("checksum"), text.short_id(w).alias("short_id"))


@query("token_entropy", r"""WITH w AS (SELECT DISTINCT unnest(string_split(text, ' ')) AS w FROM benchmark), p AS (SELECT w, list_sort(regexp_extract_all(hex(encode(w)),
   '..')) AS b FROM w WHERE w <> ''),
 c AS (SELECT w, len(b) AS n, unnest(list_distinct(b)) AS x, b FROM p) SELECT w, round(sum(-(len(list_filter(b, lambda y: y = x)) / n) * log2(len(list_filter(b,
   lambda y: y = x)) / n)), 6) + 0.0 AS bits FROM c GROUP BY w""", ev=False)
def token_entropy(spark, d):
    rows = table(spark, d, "benchmark").select(F.explode(F.split("text", " ")).alias("w")).where("w != ''").distinct()
    return rows.select("w", (F.round(text.entropy(F.col("w")), 6) + 0.0).alias("bits"))


@query("luhn_numbers", """SELECT o_orderkey, list_sum(list_transform(range(1, length(s) + 1), lambda i: CASE WHEN (length(s) - i) % 2 = 1 THEN CASE
   WHEN CAST(s[i] AS INTEGER) > 4 THEN CAST(s[i] AS INTEGER) * 2 - 9 ELSE CAST(s[i] AS INTEGER) * 2 END ELSE CAST(s[i] AS INTEGER) END)) % 10 = 0 AS luhn
 FROM (SELECT o_orderkey, '4' || lpad(CAST(o_orderkey AS VARCHAR), 12, '0') AS s FROM orders)""", ev=False)
def luhn_numbers(spark, d):
    return table(spark, d, "orders").select("o_orderkey", text.luhn(F.concat(F.lit("4"), F.lpad(F.col("o_orderkey").cast("string"), 12, "0"))).alias("luhn"))


@query("session_id_time", "SELECT row_id, us // 1000 AS millis FROM ev")
def session_id_time(spark, d):
    """ULIDs made of the events' times, and the times read back from them."""
    ms = F.expr("us div 1000")
    code = F.concat(*(F.substring(F.lit(text.CROCKFORD), (F.shiftright(ms, 45 - 5 * i).bitwiseAND(31) + 1).cast("int"), F.lit(1)) for i in range(10)), F.lit("0" * 16))
    return ev(spark, d).select("row_id", text.ulid_millis(code).alias("millis"))


@query("manifest_check", """SELECT session, CASE WHEN n % 3 = 1 THEN 'BROKEN(manifest)' WHEN n % 3 = 2 THEN 'INCOMPLETE' ELSE 'OK' END AS status
 FROM (SELECT DISTINCT session, CAST(substr(session, 2) AS BIGINT) AS n FROM ev)""")
def manifest_check(spark, d):
    """Exports whose manifest names another hash, or that lack a file."""
    e, n = ev(spark, d), F.substring("session", 2, 20).cast("long")
    made = tables.manifest(e, e.select("session").distinct()).withColumn("hash", F.when(n % 3 == 1, "md5").otherwise(F.col("hash")))
    files = made.select("session", F.explode(F.array(*map(F.lit, tables.EXPORT_FILES))).alias("file")).where(~((n % 3 == 2) & (F.col("file") == "segments")))
    return tables.check_exports(made, files)


@query("alert_headlines", ALERTS_SQL + """SELECT session, alert_idx, CASE type WHEN 'alert.new_domain' THEN 'first contact: ' || coalesce(subject, 'unknown')
   WHEN 'alert.sensitive_read' THEN 'sensitive read: ' || coalesce(subject, 'unknown')
 ELSE 'burst: ' || coalesce(subject, 'unknown') END AS headline, strftime(make_timestamp(us), '%H:%M:%S') AS at FROM alerts""")
def alert_headlines(spark, d):
    a = detect.all_alerts(ev(spark, d), 240 * HOUR, 5)
    return a.select("session", "alert_idx", C.headline(F.col("type"), F.col("subject")).alias("headline"), F.date_format(F.timestamp_micros("us"), "HH:mm:ss").alias("at"))


@query("raw_text_guard", " UNION ALL ".join(f"""SELECT doc_id, '{r.name}' AS rule FROM documents WHERE doc_id % 2 = 0 AND regexp_matches(text, '{r.pattern.replace("'",
   "''")}')""" for r in redact.RULES if not r.check), ev=False)
def raw_text_guard(spark, d):
    """Texts with a structural rule's match, which must not be hashed, in a table whose even rows were not redacted."""
    return redact.unredacted(_half_redacted(spark, d), "doc_id", "text_redacted")


@query("marker_runs", """SELECT e.row_id, c.conv_id FROM ev e JOIN (SELECT DISTINCT conv_id FROM conversations) c ON c.conv_id = e.k""")
def marker_runs(spark, d):
    """Events with the outside records that carry the same run id."""
    runs = table(spark, d, "conversations").select("conv_id").distinct()
    return joins.with_logs(ev(spark, d), runs.withColumn("run", F.col("conv_id")), "k", "run").select("row_id", "conv_id")


# sinks, written and read again

def _folder(spark, name: str) -> str:
    return f"{tables.scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query("append_round_trip", "SELECT CAST(make_timestamp(us) AS DATE) AS event_date, count(*) AS events, count(DISTINCT session) AS sessions FROM ev GROUP BY 1")
def append_round_trip(spark, d):
    """Events appended in two batches, by day."""
    path, rows = _folder(spark, "appended"), ev(spark, d).select("session", "row_id", "type", (F.col("us") * 1000).alias("ts_wall"))
    for half in (0, 1):
        tables.append_events(rows.where(F.col("row_id") % 2 == half), path)
    return spark.read.parquet(path).groupBy("event_date").agg(F.count("*").alias("events"), F.count_distinct("session").alias("sessions"))


@query("export_round_trip", "SELECT session, count(*) AS declared, count(*) - count(*) FILTER (row_id % 50 = 3 AND CAST(substr(session, 2) AS BIGINT) % 6 = 0) AS found, CASE WHEN CAST(substr(session, 2) AS BIGINT) % 6 = 0 AND count(*) FILTER (row_id % 50 = 3) > 0 THEN 'BROKEN(events)' ELSE 'OK' END AS status FROM ev WHERE CAST(substr(session, 2) AS BIGINT) % 3 = 0 GROUP BY session")
def export_round_trip(spark, d):
    """Every third session exported and read again; rows of half of them were taken out afterwards."""
    e, s, c = _sealed(spark, d)
    n, path = F.substring("session", 2, 20).cast("long"), _folder(spark, "exported")
    made = tables.export_sessions(e, s, c, e.where(n % 3 == 0).select("session"), path)
    read = tables.read_export(spark, path, "events", "session string, row_id long, us long, type string, row_hash string")
    return tables.verify_export(made, read.where((n % 6 != 0) | (F.col("row_id") % 50 != 3)))


@query("export_from_disk", LEDGER.rstrip() + """, x AS (SELECT session, CAST(substr(session, 2) AS BIGINT) % 9 AS m, count(*) AS n, max(row_id) AS last,
   max(seg) AS segs FROM h GROUP BY session)
 SELECT session, n AS declared, CASE m WHEN 6 THEN n - 1 ELSE n END AS found, CASE m WHEN 1 THEN 'INCOMPLETE(segments)' WHEN 2 THEN 'BROKEN(events)'
   WHEN 3 THEN 'BROKEN(merkle_mismatch)' WHEN 4 THEN 'BROKEN(chain_link_broken)' WHEN 5 THEN 'BROKEN(row_hash)' WHEN 6 THEN 'BROKEN(event_count)'
   WHEN 7 THEN 'BROKEN(checkpoint_head_mismatch)' ELSE 'OK' END AS status
 FROM x UNION ALL SELECT 'nobody', 0, 0, 'unknown_session'""")
def export_from_disk(spark, d):
    """Exported folders with faults: no segments, a torn line, a forged root in a chain sealed anew, a forged link, a changed event, a lost event, a forged head."""
    e, s, c = _sealed(spark, d)
    m, path = F.substring("session", 2, 20).try_cast("long") % 9, _folder(spark, "export-faults")  # nobody has no number
    forged = ledger.seal(s.drop("prev_seg_hash", "seg_hash").withColumn("merkle_root", F.when((m == 3) & (F.col("seg") == 0), F.sha2("merkle_root", 256)).otherwise(F.col("merkle_root"))))
    forged = forged.withColumn("prev_seg_hash", F.when((m == 4) & (F.col("seg") == 0), F.sha2("prev_seg_hash", 256)).otherwise(F.col("prev_seg_hash")))
    heads = c.drop("chain_head").join(forged.select("session", F.col("seg").alias("seg_last"), F.col("seg_hash").alias("chain_head")), ["session", "seg_last"])
    heads = heads.withColumn("chain_head", F.when(m == 7, F.sha2("chain_head", 256)).otherwise(F.col("chain_head")))
    last = e.groupBy("session").agg(F.max("row_id").alias("_last"))
    sessions = e.select("session").unionByName(spark.createDataFrame([("nobody",)], "session string"))
    # the files as they are after some were lost and changed; the manifest says what there was
    is_last = F.col("row_id") == F.col("_last")
    kept = e.join(last, "session").where(~((m == 6) & is_last)).withColumn("k", F.when((m == 5) & is_last, F.col("k") + 1).otherwise(F.col("k"))).drop("_last")
    tables.export_sessions(kept, forged.where(m != 1), heads, sessions, path)
    tables.manifest(e, sessions.distinct()).write.mode("overwrite").json(f"{path}/manifest")
    tables.write_folders(e.where(m == 2).select("session", F.lit('{"row_id": 12').alias("value")).distinct(), "session", ["value"], f"{path}/events", "append")
    return exports.verify_folder(spark, path, ["session", "row_id", "us", "type", "k"], "session string, row_id long, us long, type string, k long, gap_reason string")


@query("archive_round_trip", LEDGER + "SELECT session, count(*) FILTER (seg % 2 = 1) AS hot, count(*) FILTER (seg % 2 = 0) AS cold, count(DISTINCT seg) FILTER (seg % 2 = 0) AS archived FROM h GROUP BY session")
def archive_round_trip(spark, d):
    """Segments of even numbers are archived; what stays, what the archive holds, and what the segment table says."""
    e, s, _ = _sealed(spark, d, points=False)
    path = _folder(spark, "archived")
    hot, marked = tables.archive(e, s, s.where("seg % 2 = 0"), path)
    by = lambda rows, name: rows.groupBy("session").agg(F.count("*").alias(name))
    out = e.select("session").distinct().join(by(hot, "hot"), "session", "left").join(by(spark.read.parquet(path), "cold"), "session", "left").join(by(marked.where("archived_path is not null"), "archived"), "session", "left")
    return out.fillna(0)


@query("owner_sink", """-- o AS (SELECT last_value(CASE WHEN type = 'proc.exec' THEN 1000 + k % 3 END IGNORE NULLS) OVER (PARTITION BY session
   ORDER BY us, row_id ROWS UNBOUNDED PRECEDING) AS owner_uid FROM ev)
 SELECT owner_uid, count(*) AS events FROM o GROUP BY owner_uid""")
def owner_sink(spark, d):
    """Events routed to one folder an owner, those without an owner to the dead letters; both read again."""
    path, e = _folder(spark, "owners"), ev(spark, d).withColumn("uid", 1000 + F.col("k") % 3)
    tables.route_by_owner(windows.owners(e, F.col("type") == "proc.exec"), path)
    owned = spark.read.parquet(f"{path}/owners").select(F.col("owner_uid").cast("long").alias("owner_uid"))
    return owned.unionByName(spark.read.parquet(f"{path}/dead_letters").select("owner_uid")).groupBy("owner_uid").agg(F.count("*").alias("events"))


# tokens, profiles, files and reports

BLOBS = """WITH e AS (SELECT event_id AS row_id, md5('t' || event_id) AS h FROM events),
 t AS (SELECT row_id, CASE row_id % 6 WHEN 0 THEN h WHEN 1 THEN substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-4' || substr(h, 14, 3) || '-a' || substr(h,
   18, 3) || '-' || substr(h, 21, 12) WHEN 2 THEN to_base64(unhex(h || h)) WHEN 3 THEN repeat('ab', 12)
   WHEN 4 THEN 'install' ELSE substr(h, 1, 9) || '!#%qzXWvK' || substr(h, 20, 4) END AS token FROM e),
 p AS (SELECT *, list_sort(regexp_extract_all(hex(encode(token)), '..')) AS b FROM t),
 s AS (SELECT *, round(list_reduce(list_prepend(0.0::DOUBLE, list_transform(list_sort(list_distinct(b)), lambda x: len(list_filter(b,
   lambda y: y = x))::DOUBLE / len(b))), lambda a, q: a - q * log2(q)), 9) AS bits FROM p),
 f AS (SELECT *, (regexp_matches(token, '^[0-9a-fA-F]+$') AND length(token) >= 16 AND bits >= 3.0) OR (regexp_matches(token, '^[A-Za-z0-9+/_-]+={0,2}$')
   AND length(token) >= 24 AND bits >= 4.0) AS blob,
   regexp_matches(token, '^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-4[0-9a-fA-F]{3}-[89abAB][0-9a-fA-F]{3}-[0-9a-fA-F]{12}$') AS uuid FROM s)
 SELECT row_id, token, blob, uuid, token <> 'install' AND NOT uuid AND (blob OR (strlen(token) >= 20 AND bits >= 4.0)) AS secret FROM f"""


@query("token_blobs", BLOBS, ev=False)
def token_blobs(spark, d):
    """Hex, UUIDs, base64, repeats, a plain word and mixed tokens, by form and entropy."""
    m, h = F.col("row_id") % 6, F.md5(F.concat(F.lit("t"), F.col("row_id")))
    part = lambda a, n: F.substring(h, a, n)
    uuid4 = F.concat(part(1, 8), F.lit("-"), part(9, 4), F.lit("-4"), part(14, 3), F.lit("-a"), part(18, 3), F.lit("-"), part(21, 12))
    token = F.when(m == 0, h).when(m == 1, uuid4).when(m == 2, F.base64(F.unhex(F.concat(h, h)))).when(m == 3, F.repeat(F.lit("ab"), 12)).when(m == 4, "install").otherwise(F.concat(part(1, 9), F.lit("!#%qzXWvK"), part(20, 4)))
    rows = ev(spark, d).select("row_id", token.alias("token"))
    t = F.col("token")
    return rows.select("row_id", "token", text.high_entropy_blob(t).alias("blob"), text.is_uuid4(t).alias("uuid"), text.high_entropy_token(t, tuple(x.decode() for x in redact.COMMON_WORDS)).alias("secret"))


@query("restart_gaps", f"""-- b AS (SELECT us, lag(us) OVER (ORDER BY us) AS f FROM ev WHERE row_id % 40 = 0), p AS (SELECT * FROM b WHERE us - f > {2 * HOUR}),
 s AS (SELECT session, min(us) AS a, CASE WHEN CAST(substr(session, 2) AS BIGINT) % 3 = 0 THEN max(us) END AS z FROM ev GROUP BY session)
 SELECT session, 'daemon_restart' AS reason, f AS from_us, us AS to_us FROM s JOIN p ON s.a <= p.f AND (s.z IS NULL OR s.z >= p.us)""")
def restart_gaps(spark, d):
    """A gap for each session that is active over a pause between batches; every third session ends with its last event."""
    e = ev(spark, d)
    ended = F.when(F.substring("session", 2, 20).cast("long") % 3 == 0, F.max("us"))
    sessions = e.groupBy("session").agg(F.min("us").alias("start_us"), ended.alias("end_us"))
    return govern.restart_gaps(e.where("row_id % 40 = 0").select("us"), sessions, 2 * HOUR)


@query("head_mirror", """SELECT session AS session_id, count(*) AS seg_last, false AS error FROM ev GROUP BY session UNION ALL SELECT NULL, NULL, true
   UNION ALL SELECT 'late', 3, false""")
def head_mirror(spark, d):
    """Appended heads, and a second mirror with a bad line among others and a torn last one."""
    path = _folder(spark, "heads")
    heads = ev(spark, d).groupBy(F.col("session").alias("session_id")).agg(F.count("*").alias("seg_last"))
    zeros = F.array_repeat(F.lit(0), 32)
    tables.append_heads(heads.withColumns({"chain_head": zeros, "ckpt_hash": zeros, "at": F.lit(1)}), path)
    lines = ['{"session_id": 12', '{"session_id": "late", "seg_last": 3, "chain_head": [1], "ckpt_hash": [2], "at": 2}', '{"session_id": "to']
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.mode("append").text(path)
    return read_heads(spark, path).select("session_id", "seg_last", "error")


@query("profile_rejects", """SELECT p_partkey, CASE p_partkey % 9 WHEN 1 THEN 'name' WHEN 2 THEN 'capture_disabled' WHEN 3 THEN 'entropy_looser'
   WHEN 4 THEN 'bad_pattern' WHEN 5 THEN 'bad_lens' WHEN 6 THEN 'negative_ttl' WHEN 7 THEN 'forbidden_field' WHEN 8 THEN 'capture_disabled' END AS reject_reason
   FROM part""", ev=False)
def profile_rejects(spark, d):
    """A profile a part, eight of nine with one fault each."""
    m = F.col("p_partkey") % 9
    texts = lambda *x: F.array(*map(F.lit, x))
    rows = table(spark, d, "part").select(
        "p_partkey", F.when(m == 1, "").otherwise(F.col("p_brand")).alias("name"), (m != 2).alias("capture_exec"), (m != 8).alias("capture_connect"), F.when(m == 3, 4.5).otherwise(3.5).alias("entropy_bits"), F.lit(20).alias("entropy_length"),
        F.when(m == 4, texts("a+", "(")).otherwise(texts("a+")).alias("patterns"), texts("/x/**", "/y/[a-c]*").alias("scopes"), F.when(m == 5, "map").otherwise("tree").alias("lens"), F.when(m == 6, -1).otherwise(7).alias("ttl_days"),
        texts("runId").alias("carry_fields"), F.when(m == 7, texts("runId", "x")).otherwise(texts("x")).alias("forbid_fields"),
    )
    return files.validate_profiles(rows).select("p_partkey", "reject_reason")


@query("file_scan", """SELECT page_id, CAST(strlen(url) + 1 AS BIGINT) AS size, sha256(url || chr(10)) AS digest FROM pages
   WHERE NOT starts_with(CAST(page_id AS VARCHAR), '1')""", ev=False)
def file_scan(spark, d):
    """A file a page, all but those of numbers that begin with 1 in scope."""
    path = _folder(spark, "scanned")
    tables.write_folders(table(spark, d, "pages").select("page_id", F.col("url").alias("value")), "page_id", ["value"], path)
    bare = path.removeprefix("file://")
    found = files.scan(spark, [f"{bare}/page_id=*/**"], [f"{bare}/page_id=1*/**"], 1)
    found = found.where(F.col("path").rlike("/page_id=-?[0-9]+/")).select(F.regexp_extract("path", "/page_id=(-?[0-9]+)/", 1).cast("long").alias("page_id"), "size", "digest")
    return found.coalesce(4 * spark.sparkContext.defaultParallelism)  # a task reads 32 files at most, and these have a line each


@query("first_sessions", "SELECT session, started_us FROM (SELECT session, min(us) AS started_us FROM ev GROUP BY session) ORDER BY started_us LIMIT 7")
def first_sessions(spark, d):
    """The seven sessions that began first: what the read API's order puts on top."""
    return api.list_sessions(ev(spark, d)).limit(7).select("session", "started_us")


@query("api_verify", LEDGER + "SELECT session, CASE WHEN CAST(substr(session, 2) AS BIGINT) % 4 = 1 THEN 2 ELSE 0 END AS code FROM ev GROUP BY session")
def api_verify(spark, d):
    """The read API's verdicts where one event of every fourth session was changed."""
    e, s, c = _sealed(spark, d)
    first = e.groupBy("session").agg(F.min("row_id").alias("_first"))
    changed = (F.substring("session", 2, 20).cast("long") % 4 == 1) & (F.col("row_id") == F.col("_first"))
    forged = e.join(first, "session").withColumn("row_hash", F.when(changed, F.sha2("row_hash", 256)).otherwise(F.col("row_hash"))).drop("_first")
    return api.verify(forged, s, c).select("session", "code")


@query("incident_report", ALERTS_SQL.rstrip() + f""", t AS (SELECT session, 'e' || row_id AS row_id, us, {DESCRIBE} AS line FROM ev WHERE type <> 'fs.write_open'
   UNION ALL SELECT session, 'a' || row_id || '.' || rule, us, CASE type WHEN 'alert.new_domain' THEN 'first contact with ' || coalesce(subject, '?')
   WHEN 'alert.sensitive_read' THEN 'alert: sensitive read of ' || coalesce(subject, '?') ELSE 'alert: ' || substr(type, 7) END FROM alerts)
 SELECT CAST(0 AS BIGINT) AS us, '' AS row_id, 'incident report for s7: ' || (SELECT count(*) FROM ev WHERE session = 's7') || ' events, ' || (SELECT count(*)
   FROM alerts WHERE session = 's7') || ' alerts' AS line
 UNION ALL SELECT us, row_id, line FROM t WHERE session = 's7' UNION ALL SELECT 0, '', '{detect.FOOTER}'""")
def incident_report(spark, d):
    e = ev(spark, d)
    return api.incident_report(e, tables.materialize(detect.all_alerts(e, 240 * HOUR, 5), "report-alerts"), "s7")


@query("added_rules", """SELECT row_id, 'case CASE-⟦R:entropy:s:' || substr(sha256(row_id || 'salt'), 1, 8) || '⟧ is open' AS note FROM ev""")
def added_rules(spark, d):
    """A rule of the user's own beside the built-in ones."""
    rows = ev(spark, d).select("row_id", F.concat(F.lit("case CASE-"), F.col("row_id"), F.lit(" is open")).alias("note"))
    return redact.redact(rows, "note", "salt", (redact.Rule("case", "entropy", "CASE-([0-9]+)"),)).select("row_id", F.col("note_redacted").alias("note"))
