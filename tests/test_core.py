"""The library's operators against sequential models and the mutation matrix; every query against its SQL."""

import os
import pathlib
import random
import re
from collections import defaultdict, deque

import duckdb
import pytest
from pyspark.sql import functions as F

from tidewatch.functions import classify, net, text
from tidewatch.operators import govern, joins, ledger, redact, windows
from tidewatch.plans import api, detect, queries, tables
from tidewatch.sources import events, files

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
KINDS = ["proc.exec", "fs.write_open", "net.connect", "net.dns", "fs.sensitive_read"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        path = f"{SF}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def plain(v):
    return round(float(v), 6) if isinstance(v, float) or type(v).__name__ == "Decimal" else v


@pytest.mark.parametrize("name", list(queries.SQL))
def test_query_matches_sql(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    made = duck.execute(queries.SQL[name])
    names = [x[0] for x in made.description]
    assert sorted(names) == columns
    assert got == sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in made.fetchall()), key=repr)


def stream(seed, n=400, sessions=4):
    """Random events with ties in time."""
    r = random.Random(seed)
    us, rows = 0, []
    for i in range(n):
        us += r.choice([0, 0, 1, 3, 40])
        rows.append((i, f"s{r.randrange(sessions)}", us, r.choice(KINDS), r.randrange(6)))
    return rows


@pytest.fixture(scope="module")
def rows():
    return stream(1)


@pytest.fixture(scope="module")
def table(spark, rows):
    return spark.createDataFrame(rows, "row_id long, session string, us long, type string, k long").repartition(3)


def by_session(rows):
    out = defaultdict(list)
    for row in sorted(rows, key=lambda x: (x[2], x[0])):
        out[row[1]].append(row)
    return out


def test_bursts_match_a_deque(table, rows):
    want = set()
    for own in by_session(rows).values():
        held, armed = defaultdict(deque), defaultdict(lambda: True)
        for row in own:
            if row[3] in ("fs.write_open", "net.dns"):
                q = held[row[3]]
                q.append(row[2])
                while q and q[0] <= row[2] - 300:
                    q.popleft()
                if len(q) >= 3 and armed[row[3]]:
                    want.add(row[0])
                armed[row[3]] = len(q) < 3
    got = windows.bursts(table, classify.burst_class(F.col("type")), 300, 3)
    assert {r.row_id for r in got.collect()} == want and want


def test_segments_match_a_counter(table, rows):
    want = {}
    for own in by_session(rows).values():
        seg = n = start = 0
        for row in own:
            start = row[2] if n == 0 else start
            n += 1
            want[row[0]] = seg
            if n >= 7 or row[2] - start >= 100:
                seg, n = seg + 1, 0
    assert {r.row_id: r.seg for r in windows.segments(table, 7, 100).collect()} == want


def test_as_of_matches_a_cache(spark, table, rows):
    answers = table.where("type = 'net.dns'").select(F.col("k").cast("string").alias("addr"), "us", "row_id", F.concat(F.lit("q"), "row_id").alias("qname"), F.lit(50).cast("long").alias("ttl_us"))
    connects = table.where("type = 'net.connect'").select("row_id", "us", F.col("k").cast("string").alias("addr"))
    latest, want = {}, {}
    for row in sorted(rows, key=lambda x: (x[2], x[3] != "net.dns", x[0])):
        if row[3] == "net.dns":
            latest[row[4]] = (row[2], f"q{row[0]}")
        elif row[3] == "net.connect":
            seen = latest.get(row[4])
            want[row[0]] = seen[1] if seen and row[2] - seen[0] <= 30 else None
    got = joins.dns_join(connects, answers, 30)
    assert {r.row_id: r.qname for r in got.collect()} == want


def test_interval_pairs_once(table, rows):
    reads, conns = table.where("type = 'fs.sensitive_read'"), table.where("type = 'net.connect'")
    got = sorted((r.l.row_id, r.r.row_id) for r in joins.within(reads, conns, "session", "us", 60).collect())
    assert got == sorted((a[0], b[0]) for a in rows for b in rows if a[3] == "fs.sensitive_read" and b[3] == "net.connect" and a[1] == b[1] and abs(a[2] - b[2]) <= 60)


def test_shedding_matches_a_bucket_and_conserves(table, rows):
    offered = table.select("row_id", "session", "us", classify.event_class(F.col("type")).alias("class"), classify.shed_tier(F.col("type")).alias("tier"))
    done = govern.shed(offered, rate=20_000, burst=2)
    tiers = {"fs.write_open": 2, "net.dns": 3}
    want = set()
    for own in by_session(rows).values():
        tokens, last = [2.0] * 4, None
        for row in own:
            if row[3] in tiers:
                fresh = (row[2] - last) * 0.02 if last is not None else 0
                for k in (3, 2, 1, 0):
                    take = min(2 - tokens[k], fresh)
                    tokens[k], fresh = tokens[k] + take, fresh - take
                last = row[2]
                if tokens[tiers[row[3]]] >= 1:
                    tokens[tiers[row[3]]] -= 1
                else:
                    want.add(row[0])
    assert {r.row_id for r in done.where("shed").collect()} == want and want
    assert govern.conservation(done, govern.gap_rows(done, 50)).count() == 0


def test_chained_over_partitions(spark):
    rows = spark.createDataFrame([(f"{i:04d}", f"v{i}") for i in range(500)], "o string, v string")
    got = {r.o: r.before for r in windows.chained(rows, "o", "v", "before", "none").collect()}
    assert got == {f"{i:04d}": f"v{i - 1}" if i else "none" for i in range(500)}


# the mutation matrix


@pytest.fixture(scope="module")
def sealed(spark):
    rows = [(i, f"s{i % 2}" if i < 24 else "s0", i * 10, "gap" if i == 17 else "proc.exec", i, "governor" if i == 17 else None) for i in range(32)]
    e = spark.createDataFrame(rows, "row_id long, session string, us long, type string, k long, gap_reason string")
    e = ledger.row_hash(windows.count_segments(e, 4), ["session", "row_id", "us", "type", "k"])
    s = ledger.seal(ledger.segment_table(e))
    e, s = (spark.createDataFrame(x.collect(), x.schema) for x in (e, s))
    c = ledger.checkpoints(s, 2, 1 << 60)
    return e, s, spark.createDataFrame(c.collect(), c.schema)


def kinds(findings):
    return {r.kind for r in findings.collect()}


def test_clean_ledger(sealed):
    e, s, c = sealed
    heads = c.select("session", "seg_last", F.col("chain_head").alias("mirror_hash"), F.lit(1).alias("n"))
    assert kinds(ledger.verify(e, s, c, heads)) == set()
    assert {r.code for r in api.verify(e, s, c, heads).collect()} == {0}


MUTATIONS = {
    "flip": (lambda e, s, c: (ledger.row_hash(e.withColumn("k", F.when(F.col("row_id") == 3, 99).otherwise(F.col("k"))), ["session", "row_id", "us", "type", "k"]), s, c), "merkle_mismatch"),
    "delete_event": (lambda e, s, c: (e.where("row_id != 2"), s, c), "row_continuity_broken"),
    "swap": (lambda e, s, c: (e.withColumn("row_hash", F.when(F.col("row_id") == 0, e.where("row_id = 2").first().row_hash).when(F.col("row_id") == 2, e.where("row_id = 0").first().row_hash).otherwise(F.col("row_hash"))), s, c), "merkle_mismatch"),
    "delete_segment": (lambda e, s, c: (e, s.where("not (session = 's0' and seg = 1)"), c), "chain_link_broken"),
    "delete_session": (lambda e, s, c: (e.where("session != 's0'"), s.where("session != 's0'"), c.where("session != 's0'")), "checkpoint_chain_broken"),
    "delete_attested": (lambda e, s, c: (e, s.join(c.where("session = 's1'").selectExpr("session", "seg_last as seg"), ["session", "seg"], "left_anti"), c), "archive_missing"),
    "hide_gap": (lambda e, s, c: (e, s.withColumn("gap", F.map_filter("gap", lambda k, v: F.lit(False))), c), "gap_dishonest"),
    "forge_head": (lambda e, s, c: (e, s, c.withColumn("chain_head", F.sha2("chain_head", 256))), "checkpoint_head_mismatch"),
}


@pytest.mark.parametrize("name", list(MUTATIONS))
def test_mutation_is_found(sealed, name):
    change, kind = MUTATIONS[name]
    found = ledger.verify(*change(*sealed))
    assert kind in kinds(found)
    assert ledger.verdict(found, sealed[1]).where("code = 2").count() > 0


def test_mirror(sealed, spark):
    e, s, c = sealed
    forged = c.select("session", "seg_last", F.lit("x").alias("mirror_hash"), F.lit(1).alias("n"))
    assert kinds(ledger.audit_mirror(c, forged)) == {"mirror_mismatch"}
    assert kinds(ledger.audit_mirror(c, forged.limit(0))) == {"mirror_uncheckable"}
    assert ledger.verdict(ledger.audit_mirror(c, forged.limit(0)), spark.createDataFrame([("",)], "session string")).first().code == 3


def test_floats_have_no_canonical_form(spark):
    with pytest.raises(ValueError):
        ledger.row_hash(spark.createDataFrame([(1.5,)], "x double"), ["x"])


def test_raw_text_is_not_hashed(spark, tmp_path):
    rows = spark.createDataFrame([(1, "s", "exec", "token=abc", ["--pin", "1"], "/a", {"k": "v"})], "id long, session string, type string, text string, argv array<string>, path string, m map<string,string>")
    assert ledger.row_hash(rows, ["id", "session", "type"]).count() == 1
    for bad in ("text", "argv", "path", "m"):
        with pytest.raises(ValueError, match=bad):
            ledger.row_hash(rows, ["id", bad])
    with pytest.raises(ValueError, match="s"):
        ledger.row_hash(rows.select("id", F.struct("text").alias("s")), ["id", "s"])
    done = redact.redact_paths(redact.redact_argv(redact.redact(rows, "text", "salt"), "argv", "salt"), "path", F.lit(True), "salt")
    columns = ["id", "text_redacted", "argv_redacted", "path_redacted"]
    first = ledger.row_hash(done, columns).first().row_hash
    done.write.parquet(str(tmp_path / "t"))
    again = spark.read.parquet(str(tmp_path / "t")).join(rows.select("id", "session"), "id").where("id = 1")
    assert ledger.row_hash(again, columns).first().row_hash == first
    with pytest.raises(ValueError, match="text_redacted"):  # made anew, the column has lost its mark
        ledger.row_hash(again.withColumn("text_redacted", F.concat("text_redacted", F.lit("!"))), columns)


def test_export_check_of_odd_folders(spark, tmp_path):
    """A session whose name needs escapes, one without any file, and a manifest of another form."""
    from tidewatch.plans import exports, tables

    schema, columns = "session string, row_id long, us long, type string, gap_reason string", ["session", "row_id", "us", "type"]
    events = spark.createDataFrame([(s, i, i, "proc.exec", None) for s in ("a+b %/c", "plain", "7", "gone") for i in range(5)], schema)
    e = ledger.row_hash(windows.count_segments(events, 2), columns)
    segments = ledger.seal(ledger.segment_table(e))
    tables.export_sessions(e, segments, ledger.checkpoints(segments, 2, 1 << 60), events, str(tmp_path))
    got = lambda: {x.session: (x.declared, x.found, x.status) for x in exports.verify_folder(spark, f"file://{tmp_path}", columns, schema).collect()}
    assert got() == {s: (5, 5, "OK") for s in ("a+b %/c", "plain", "7", "gone")}
    import shutil

    for name in exports.TABLES:
        shutil.rmtree(tmp_path / name / "session=gone")
    shutil.rmtree(tmp_path / "checkpoints" / "session=7")
    assert got() == {"a+b %/c": (5, 5, "OK"), "plain": (5, 5, "OK"), "7": (5, 5, "INCOMPLETE(checkpoints)"), "gone": (5, 0, "INCOMPLETE(segments)")}


def test_export_has_few_files(spark, tmp_path):
    """Scattered events give a session one file, or as many as the ranges it fills; files of any size are read alike."""
    from tidewatch.plans import exports, tables

    schema, columns = "session string, row_id long, us long, type string, gap_reason string", ["session", "row_id", "us", "type"]
    names = [f"s{i}" for i in range(20)] + ["a+b %/c=é", "x\ty[1]"]
    events = spark.createDataFrame([(s, 50 * k + i, i, "proc.exec", None) for k, s in enumerate(names) for i in range(50)], schema)
    e = ledger.row_hash(windows.count_segments(events, 8), columns).repartition(16)
    segments = ledger.seal(ledger.segment_table(e))
    path = f"file://{tmp_path}"
    for _ in range(2):  # the second takes the first's place
        tables.export_sessions(e, segments, ledger.checkpoints(segments, 2, 1 << 60), events, path)
    for name in exports.TABLES:
        assert len(names) <= len([x for x in (tmp_path / name).rglob("part-*")]) <= len(names) + 4
        assert spark.read.schema("session string, x string").json(f"{path}/{name}").select("session").distinct().count() == len(names)
    (tmp_path / "events" / "session=s3" / "part-odd").write_text('\n{"row_id": 1\nnull\r\n[1]\n')
    (tmp_path / "segments" / "session=s4" / "part-none").write_text(" \n\n")
    want = {s: (50, 50, "OK") for s in names} | {"s3": (50, 50, "BROKEN(events)")}
    held = exports.SMALL
    for size in (held, 0, 100):  # small ones, large ones, both
        exports.SMALL = size
        try:
            got = {x.session: (x.declared, x.found, x.status) for x in exports.verify_folder(spark, path, columns, schema).collect()}
        finally:
            exports.SMALL = held
        assert got == want


def test_archive_files_follow_rows(spark, tmp_path):
    """An archive of many sessions has a few files, each of few sessions; it holds what is due, names as they are."""
    schema = "session string, seg long, row_id long"
    names = [f"{i:03d}" for i in range(200)] + ["a+b %/c"]
    events = spark.createDataFrame([(s, seg, 4 * k + seg) for k, s in enumerate(names) for seg in range(4)], schema).repartition(8)
    segments = events.select("session", "seg")
    path = str(tmp_path / "archived")
    for seg in (0, 2):
        hot, marked = tables.archive(events, segments, segments.where(F.col("seg") == seg), path)
        assert hot.count() == 3 * len(names) and marked.where("archived_path is not null").count() == len(names)
    files = list((tmp_path / "archived").rglob("part-*"))
    assert 1 <= len(files) <= 2 * 4
    got = spark.read.parquet(path)
    assert sorted(map(tuple, got.select("session", "seg", "row_id").collect())) == sorted((s, seg, 4 * k + seg) for k, s in enumerate(names) for seg in (0, 2))
    tables.archive(events, segments, segments.where("false"), str(tmp_path / "none"))
    assert spark.read.parquet(str(tmp_path / "none")).count() == 0


def test_lineage_of_long_chains_and_cycles(spark):
    chain = [(i, i - 1) for i in range(1, 200)] + [(0, None)]
    odd = [(1000, 1001), (1001, 1000), (1002, 1001), (1003, 1003), (1004, 9999), (1005, None), (1006, 1002)]
    got = {x.pid: (x.root, x.hops, x.cycle) for x in windows.lineage(spark.createDataFrame(chain + odd, "pid long, ppid long")).collect()}
    want = {i: (0, i, False) for i in range(200)} | {p: (None, None, True) for p in (1000, 1001, 1002, 1006)} | {1003: (1003, 0, False), 1004: (1004, 0, False), 1005: (1005, 0, False)}
    assert got == want
    assert windows.lineage(spark.createDataFrame([], "pid long, ppid long")).count() == 0


def test_sessions_prune_days(spark, tmp_path):
    from datetime import UTC, datetime

    from tidewatch import schema as S
    from tidewatch.functions.text import CROCKFORD
    from tidewatch.plans import tables
    from tidewatch.sources import events as source

    day = lambda n: int(datetime(2024, 1, n, 12, tzinfo=UTC).timestamp() * 1000)
    ulid = lambda ms: "".join(CROCKFORD[(ms >> 5 * (9 - i)) & 31] for i in range(10)) + "0" * 16
    session = ulid(day(5))
    assert source.session_start(session).isoformat() == "2024-01-05T12:00:00+00:00" and source.session_start("s7") is None and source.session_start("Z" * 26) is None
    blank = dict.fromkeys(f.name for f in S.EVENT.fields)
    rows = [blank | {"v": 1, "type": "proc.exec", "session": s, "ts_wall": day(n) * 1_000_000} for n in (2, 5, 6, 9) for s in (session, "other")]
    tables.append_events(spark.createDataFrame([tuple(r[f.name] for f in S.EVENT.fields) for r in rows], S.EVENT), str(tmp_path))
    read = source.read_events(spark, str(tmp_path), session)
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(event_date" in plan and "2024-01-04" in plan and "PushedFilters: [IsNotNull(session), EqualTo(session" in plan
    assert sorted(str(x.event_date) for x in read.collect()) == ["2024-01-05", "2024-01-06", "2024-01-09"]
    assert source.read_events(spark, str(tmp_path), session, until=datetime(2024, 1, 6).date()).count() == 2
    assert source.read_events(spark, str(tmp_path)).count() == 8 and source.read_events(spark, str(tmp_path), "other").count() == 4


# redaction


B62 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
HEX = "0123456789abcdef"


def makers(r):
    """Texts with a secret by rule, as (rule, text before, secret, text after). Secrets are put together here, so that none is written down."""
    p = lambda a, k: "".join(r.choice(a) for _ in range(k))
    digits = p(B62[52:], 15)
    card = next(digits + c for c in "0123456789" if redact._luhn((digits + c).encode()))
    shapes = [(name, "", r.choice(prefixes) + p(B62 if "a-z" in letters else B62[:26], least), "") for name, _, prefixes, letters, least in redact.SHAPES]
    return shapes + [
        ("field", r.choice(["DISCORD_TOKEN=", "passphrase: ", "\"client_secret\":\"", "passcode => ", "my.api-key='", "access_token=", "private_key: ", "credentials=", "access_code=", "xAuthKey: "]), p(B62, r.randrange(1, 61)), " "),
        ("short_field", r.choice(["pin=", "otp: ", " pwd=", "user_pin="]), p(B62[52:], r.randrange(1, 9)), ""),
        ("loose_field", r.choice(["(pass:", "\"pw\": \""]), p(B62[52:], 5), ""),
        ("authorization_header", r.choice(["Authorization: Bearer ", "authorization: token "]), p(B62, r.randrange(1, 15)), ""),
        ("authorization", r.choice(["Bearer ", "Authorization: Basic "]), p(B62, 24), ""),
        ("aws_secret", "aws_secret_access_key = ", p(B62, 40), ""),
        ("azure_key", r.choice(["AccountKey=", "SharedAccessKey="]), p(B62, 44), ";x"),
        ("card", "", card[:4] + "-" + card[4:8] + " " + card[8:], ""),
        ("digits", "", p(B62[52:], 22), ""),
        ("jwt", "", "ey" + "J" + p(B62, 20) + "." + p(B62, 30) + "." + p(B62, 40), ""),
        ("pem", "", "-----BEGIN RSA PRIVATE " + "KEY-----\n" + p(B62, 64) + "\n-----END RSA PRIVATE " + "KEY-----", ""),
        ("pem", "cut ", "-----BEGIN PRIVATE " + "KEY-----\n" + p(B62, 64), ""),
        ("signed_url", "https://h.net/c?sv=1&sig=", p(B62, 20) + "%2F" + p(B62, 8), "&se=2"),
        ("slack_hook", "", "https://hooks.sl" + "ack.com/services/" + p(B62, 9) + "/" + p(B62, 9), ""),
        ("url_password", "postgres://me:", p(B62, 6) + "@" + p(B62, 5), "@host:5432/db"),
        ("entropy", "", p(HEX, 40), ""), ("entropy", "x~", p(B62, 32), ""),
    ]


BENIGN = [
    "the build ran in 12.5 s", "src/app/main.py", "fünf Äpfel", "version 1.2.3", "2024-01-05T10:00:00", "connect to host", "the token is short", "pin it to the wall", "spinning: wheel", "a secret garden", "pass: no",
    "0f8fad5b-d9cb-469f-a165-70867728950e", "https://example.org/a/b?c=d", "key: value", "sk-learn pipelines", "Bearer of bad news", "-----BEGIN CERTIFICATE-----", "internationalization", "user@example.org", "+49 30 1234567",
]


def labelled(seed=3, n=40):
    """(id, text, secret, rule): every rule n times, and as many rows without a secret."""
    r, rows = random.Random(seed), []
    words = lambda: "; ".join(r.choice(BENIGN) for _ in range(8))
    for _ in range(n):
        for rule, before, secret, after in makers(r):
            rows.append((len(rows), f"{words()}, {before}{secret}{after} {words()}", secret, rule))
            rows.append((len(rows), words(), None, None))
    return rows


def test_every_rule_marks_its_secret(spark):
    rows = labelled(seed=4, n=3)
    assert {x[3] for x in rows if x[3]} == {r.name for r in redact.RULES} | {"entropy"}
    work = redact.Redactor("salt")
    for _, t, secret, rule in rows:
        found = work.redact(t)[1]
        if secret:
            marked = [t.encode()[f["start"] : f["end"]].decode() for f in found if f["rule"] == rule]
            assert any(x in secret or secret in x for x in marked), (rule, t, found)
        else:
            assert not found, (t, found)
    assert {r.cls for r in redact.RULES} | {"entropy"} == set(redact.CLASSES)


def test_redaction_gates(spark):
    rows = labelled(n=12)
    assert len(rows) >= 520
    done = redact.redact(spark.createDataFrame(rows, "id long, text string, secret string, rule string"), "text", "salt").collect()
    must = [r for r in done if r.secret]
    assert sum(bool(r.findings) for r in must) >= 0.99 * len(must)
    assert sum(bool(r.findings) for r in done if not r.secret) <= 0.05 * (len(done) - len(must))
    bare = lambda t: re.sub(redact.MARKER, "", t)  # noqa: E731  short secrets may also be parts of words
    assert all(bare(r.text_redacted).count(r.secret) < r.text.count(r.secret) for r in must)
    assert not any(r.secret in r.text_redacted for r in must if len(r.secret) >= 8)
    again = redact.Redactor("salt")
    assert all(again.redact(r.text_redacted)[0] == r.text_redacted for r in done)
    odd = redact.redact(spark.createDataFrame([(1, None, ""), (2, "", "")], "id long, text string, secret string"), "text", "salt").collect()
    assert [(r.text, r.text_redacted, r.findings or []) for r in sorted(odd)] == [(None, None, []), ("", "", [])]


def test_values_of_any_form(spark):
    """(text, what must be gone, what must stay)."""
    cases = [
        ("password=hunter2 x", "hunter2", " x"), ("token=abc1234", "abc1234", "token="), ("pin=123", "123", "pin"), ("Authorization: Bearer abcd1234", "abcd1234", "Bearer"), ("access_code=12345678", "12345678", "access_code"),
        ('{"password": "p\\"assw0rd123", "host": "h1"}', "assw0rd123", '"host": "h1"'), ('{\\"password\\": \\"p w 1\\", \\"x\\": 1}', "p w 1", "x"), ("MyPassword='a b c' d", "a b c", " d"), ("Password=p1;Host=h", "p1", ";Host=h"), ("token=abc&next=/home", "abc", "&next=/home"),
        ('secret="unclosed value', "unclosed", "value"), ("see hooks.sl" + "ack.com/services/T0/B1/x2", "T0/B1", "see "), ("otpauth_secret=JB", "JB", "otpauth_secret"), ('password="ends in a backslash \\\\" and more', "backslash", " and more"), ("api key: 7", "7", "api key"), ('"token": "a\nb"', '"a', "b"),
    ]
    got = redact.redact(spark.createDataFrame([(i, t) for i, (t, *_) in enumerate(cases)], "id long, text string"), "text", "salt").orderBy("id").collect()
    bare = lambda t: re.sub(redact.MARKER, "", t)
    for (text, gone, stays), row in zip(cases, got):
        if text.startswith("api key"):
            continue  # two words are prose
        assert gone not in bare(row.text_redacted) and stays in row.text_redacted and row.findings, (text, row.text_redacted)
        assert redact.Redactor("salt").redact(row.text_redacted)[0] == row.text_redacted
    spared = ["spin=fast", "crypto: pinned", "pass: no", "the token is short", "token: ''", "secret=", "passwords are dull", "keys: values"]
    assert not any(redact.Redactor("salt").redact(t)[1] for t in spared)


def test_stricter_thresholds(spark):
    df = spark.createDataFrame([(i, t) for i, t, *_ in labelled(seed=6, n=6)], "id long, text string")
    strict = redact.redact(df, "text", "salt", min_length=8, min_bits=2.5)
    assert strict.where(F.size("findings") > 0).count() > redact.redact(df, "text", "salt").where(F.size("findings") > 0).count()


def test_the_automaton_calls_every_rule_that_matches():
    work, r = redact.Redactor("salt"), random.Random(12)
    texts = [x + y + z for k in range(20) for _, x, y, z in makers(random.Random(k))]
    pool = [*"aZ09 =:\"'\\;&-_./@\n", "token", "PASSWORD", "pin", "sk-", "eyJ", "ghp_", "Bearer ", "authorization", "://", "1234567890123"]
    texts += ["".join(r.choices(pool, k=r.randrange(1, 40))) for _ in range(4000)]
    for text in texts:
        raw = text.encode()
        found = {(start, -end, name) for start, _, end, _, _, name in work._structural(raw)}
        for rule in redact.RULES:
            for m in re.finditer(rule.pattern.encode(), raw):
                group = 1 if re.compile(rule.pattern).groups else 0
                if rule.check == "luhn" and not redact._luhn(m.group(group)):
                    continue
                if not m.group(group).strip(b"\\"):
                    continue  # the backslashes of an escaped quote
                # a name's value may be read further than its pattern goes
                hit = any(a <= m.start(group) and m.end(group) <= b for a, b, name in found if name == rule.name) if rule.name in redact.GENERAL else (*m.span(group), rule.name) in found
                assert hit or rule.name in redact.GENERAL and any(a < m.end(group) and m.start(group) < b for a, b, _ in found), (text, rule.name)


def test_added_rules(spark):
    mine = redact.Rule("ticket", "entropy", r"TICKET-([0-9]{4})")
    df = spark.createDataFrame([(1, "see TICKET-1234")], "id long, text string")
    assert "1234" not in redact.redact(df, "text", "salt", (mine,)).first().text_redacted
    for bad in (redact.Rule("x", "jwt", "x"), redact.Rule("x", "entropy", "(")):
        with pytest.raises((ValueError, re.error)):
            redact.redact(df, "text", "salt", (bad,))


def test_secret_reuse_counts_places(spark):
    r = random.Random(9)
    a, b = ("".join(r.choice(HEX) for _ in range(40)) for _ in range(2))
    rows = [(1, f"x {a} y {a}"), (2, f"{a}"), (3, f"{b} {b}"), (4, None)]
    got = redact.reuse(redact.findings(redact.redact(spark.createDataFrame(rows, "id long, text string"), "text", "salt"), "id"), "id").collect()
    assert [(x.hits, x.places) for x in got] == [(3, 2)]


def test_paths_and_arguments(spark):
    r = random.Random(10)
    h40, h38, uuid = "".join(r.choice(HEX) for _ in range(40)), "".join(r.choice(HEX) for _ in range(38)), "0f8fad5b-d9cb-469f-a165-70867728950e"
    aws = "AK" + "IA" + "Q7Z2" * 4
    paths = [f"/r/objects/ab/{h38}", f"/r/commits/x/y/{h40}", f"/r/files/{h40}", f"/r/{uuid}/f", f"/r/objects/{aws}", "", None]
    df = spark.createDataFrame([(i, p, ok) for i, p in enumerate(paths) for ok in (True, False)], "id long, path string, ok boolean")
    got = {(x.id, x.ok): x.path_redacted for x in redact.redact_paths(df, "path", F.col("ok"), "salt").collect()}
    assert [got[i, True] == p for i, p in enumerate(paths)] == [True, True, False, True, False, True, True]
    assert [got[i, False] == p for i, p in enumerate(paths)] == [False, False, False, True, False, True, True]
    argv = [["x", "--Client-Secret", "abc", "--pin", "-5", "--token", "⟦R:entropy:s:00000000⟧", "-p", "80", "--otp", "", f"--key={h40}"], [], None]
    got = [x.a_redacted for x in redact.redact_argv(spark.createDataFrame([(i, a) for i, a in enumerate(argv)], "i int, a array<string>"), "a", "salt").orderBy("i").collect()]
    assert got[1:] == [[], None] and [x == y for x, y in zip(got[0], argv[0])] == [True, True, False] + [True] * 8 + [False]


def test_entropy_finds_what_the_reference_does(spark):
    r = random.Random(5)
    hexes = "".join(r.choice("0123456789abcdef") for _ in range(40))
    letters, signs, b64 = "qXvBnMzKtRwPyLdHgFsJcAeU", "k7!mQ2#xZ9$wL4%vB8&nT5*", "Zk9-Qw3_Er7Ty1Ui5Op8As2D"
    cjk = "龍鳳麒麟龜鶴蘭竹菊梅"
    texts = {f"a {signs} b": [signs], f"a {letters} b": [letters], f"{hexes}!gz": [hexes], f"{hexes}!aaaaaaaaaaaaaaaaaaaa!{hexes[::-1]}": [hexes, hexes[::-1]], f"~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~{b64}~~~": [b64]}
    work = redact.Redactor("salt")
    for t, secrets in texts.items():
        done, found = work.redact(t)
        assert found and not any(x in done for x in secrets) and work.redact(done)[0] == done
    # a rule at a token's start does not hide the rest of it
    done = work.redact("AK" + "IA" + "Q7Z2" * 4 + "!" + hexes)[0]
    assert hexes not in done and work.redact(done)[0] == done
    spared = ["0f8fad5b-d9cb-469f-a165-70867728950e", "x 0f8fad5b-d9cb-469f-a165-70867728950e y", "aaaaaaaaaaaaaaaaaaaaaaaaaaaa", "internationalization", "", cjk[:3]]
    assert not any(work.redact(t)[1] for t in spared) and not redact.Redactor("s", min_length=8, min_bits=3.0).redact("Configuration")[1]
    # in Spark as in Python
    pool = "abcdefXYZ0123456789!#$%^&*+_-~ \t\n=:/.,;@|\"'()<>éß龍鳳麒麟龜鶴蘭竹菊梅🐉"
    rows = [*texts, *spared, cjk, cjk * 3, *("".join(r.choices(pool, k=r.randint(1, 60))) for _ in range(3000)), *("".join(r.sample(pool[:20] + pool[-12:], r.randint(5, 24))) for _ in range(2000))]
    df = spark.createDataFrame(list(enumerate(rows)), "id long, text string")
    got = {x.id: (x.text_redacted, [f.asDict() for f in x.findings or []]) for x in redact.redact(df, "text", "salt").collect()}
    assert sum(bool(f) for _, f in got.values()) > 100
    assert got == {i: work.redact(t) for i, t in enumerate(rows)}


def test_all_rules_are_counted(spark):
    hits = [x + y + z for _, x, y, z in makers(random.Random(11))]
    texts = [*hits, " ".join(hits), "\n".join(hits * 2), "nothing here", "", None]
    got = {x.rule: (x["class"], x.hits, x.docs) for x in redact.rule_counts(spark.createDataFrame([(t,) for t in texts], "text string"), "text").collect()}
    want = {}
    for rule in redact.RULES:
        per_text = [sum(1 for _ in re.finditer(rule.pattern.encode(), (t or "").encode())) for t in texts]
        want[rule.name] = (rule.cls, sum(per_text), sum(n > 0 for n in per_text))
    assert got == want and all(n for _, n, _ in got.values())


def test_thresholds_only_tighten():
    with pytest.raises(ValueError):
        redact.Redactor("s", min_length=30)


# functions and sources


def test_addresses(spark):
    import ipaddress

    cases = {"127.0.0.1": "loopback", "169.254.1.1": "link_local", "224.0.0.5": "link_local", "100.64.0.1": "cgnat", "172.31.0.1": "private", "172.32.0.1": "public", "::1": "loopback", "fe80::1": "link_local", "fd00::1": "private", "2001:db8::1": "public", "300.1.1.1": None, "x": None}
    cases |= {"::ffff:127.0.0.1": "loopback", "0:0:0:0:0:ffff:a00:1": "private", "0:0::1": "loopback", "::FFFF:100.64.1.1": "cgnat", "fe80::1%eth0": "link_local", "::": "public", "ff12::1": "link_local", "ff05::1": "public", "": None, None: None}
    got = spark.createDataFrame([(k,) for k in cases], "a string").select("a", net.ip_class(F.col("a")).alias("c")).collect()
    assert {r.a: r.c for r in got} == cases
    r, texts = random.Random(4), [":", ":::", "1:2:3:4:5:6:7", "1:2:3:4:5:6:7:8:9", "::1::", "12345::", "g::", "1.2.3.4::", "::1.2.3", "::1.2.3.256", "1::2:3:4:5:6:7:8", "::ffff:1.2.3.4", "1:2:3:4:5:6:7::", ":1:2:3:4:5:6:7", "1.2.3.4", "1:2:3:4:5:6:1.2.3.4"]
    for _ in range(300):
        a = ipaddress.IPv6Address(bytes(r.choice([0, 0, 0, r.randrange(256)]) for _ in range(16)))
        texts += [str(a), a.exploded, str(a).upper()]
        texts += ["".join(r.choices(["0", "f", "1a", ":", "::", ":", "1.2.3.4"], k=r.randrange(1, 12))) for _ in range(3)]

    def parsed(text):
        try:
            a = ipaddress.ip_address(text)
        except ValueError:
            return None
        return a.packed if a.version == 6 else bytes(10) + b"\xff\xff" + a.packed

    got = spark.createDataFrame([(t,) for t in texts], "a string").select("a", net.address_bytes(F.col("a")).alias("b")).collect()
    assert all((None if x.b is None else bytes(x.b)) == parsed(x.a) for x in got), [(x.a, x.b, parsed(x.a)) for x in got if (None if x.b is None else bytes(x.b)) != parsed(x.a)][:5]


def test_globs():
    import re

    matches = lambda g, p: bool(re.search(joins.glob_regex(g), p))
    assert matches("/a/**", "/a") and matches("/a/**", "/a/b/c") and not matches("/a/**", "/b/a")
    assert matches("/a/*/c", "/a/b/c") and not matches("/a/*/c", "/a/b/x/c") and matches("/a/**/c", "/a/c") and matches("/a/[!b]?", "/a/cx") and not matches("/a/[!b]?", "/a/bx")


def test_luhn_agrees_with_the_builtin(spark):
    r = random.Random(0)
    rows = spark.createDataFrame([("".join(r.choice("0123456789") for _ in range(16)),) for _ in range(200)], "d string")
    assert rows.where(text.luhn(F.col("d")) != F.expr("luhn_check(d)")).count() == 0


def test_heads_skip_a_torn_last_line(spark, tmp_path):
    good = '{"session_id": "a", "seg_last": 1, "chain_head": [1], "ckpt_hash": [2], "at": 3}'
    (tmp_path / "one").write_text(good + "\n{torn")
    (tmp_path / "two").write_text("bad\n" + good + "\n")
    got = events.read_heads(spark, str(tmp_path)).collect()
    assert sorted(bool(r.error) for r in got) == [False, False, True]


def test_validation_splits(spark):
    e = queries.ev(spark, SF)
    cols = {"v": F.lit(1), "session": F.col("session"), "type": F.col("type"), "origin": F.when(F.col("k") == 1, "user").otherwise("kernel"), "state": F.lit("observed"), "path_source": F.lit(None), "reason": F.lit(None), "daddr_length": F.lit(16)}
    good, bad = events.validate(e, cols)
    assert good.count() + bad.count() == e.count() and bad.count() == e.where("k = 1").count()


def test_file_scan_finds_changes(spark, tmp_path):
    import shutil

    root = tmp_path / "scope"
    root.mkdir()
    (root / "a.txt").write_text("one")
    (root / "b.log").write_text("two")
    scans = [files.scan(spark, [f"{root}/**"], [f"{root}/*.log"], n) for n in (1, 2)]
    observed = spark.createDataFrame([r for s in scans for r in s.collect()], scans[0].schema)
    got = windows.settled_changes(observed).collect()
    assert [(r.path.rsplit("/", 1)[-1], r.scan_no, r.prev_digest, r.size_delta) for r in got] == [("a.txt", 2, None, 3)]
    shutil.rmtree(root)


def test_many_small_files_spread(spark, tmp_path):
    """Files of a line each are written by all tasks, however few bytes they are, and read in a few."""
    import hashlib
    import time

    pages = [(i, f"http://h{i}/ä?{i}") for i in range(-2, 900)] + [(None, "http://none/")]
    spark.createDataFrame(pages, "page_id long, url string").coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    began = time.time()
    out = queries.QUERIES["file_scan"](spark, str(tmp_path))
    got = sorted(map(tuple, out.select("page_id", "size", "digest").collect()))
    text = lambda url: (url + "\n").encode()
    assert got == sorted((i, len(text(url)), hashlib.sha256(text(url)).hexdigest()) for i, url in pages if i is not None and not str(i).startswith("1"))
    assert out.rdd.getNumPartitions() <= 4 * spark.sparkContext.defaultParallelism
    root = max(pathlib.Path(tables.scratch_dir(spark).removeprefix("file://")).glob("scanned-*"), key=lambda x: x.stat().st_mtime)
    files = [x.name for x in root.rglob("part-*")]
    assert root.stat().st_mtime >= began - 1 and len(files) == len(pages) and len({x[:10] for x in files}) == 4


def test_profiles_are_rejected(spark):
    schema = "name string, capture_exec boolean, capture_connect boolean, entropy_bits double, entropy_length int, patterns array<string>, scopes array<string>, lens string, ttl_days int, carry_fields array<string>, forbid_fields array<string>"
    base = ["p", True, True, 4.0, 20, ["a+"], ["/x/**"], "tree", 7, ["a"], ["b"]]
    change = lambda i, v: [v if k == i else x for k, x in enumerate(base)]
    rows = [base, change(0, ""), change(1, False), change(3, 5.0), change(5, ["("]), change(7, "map"), change(8, -1), change(10, ["a"])]
    got = [r.reject_reason for r in files.validate_profiles(spark.createDataFrame([tuple(r) for r in rows], schema)).collect()]
    assert got == [None, "name", "capture_disabled", "entropy_looser", "bad_pattern", "bad_lens", "negative_ttl", "forbidden_field"]


def test_sessions_never_mix(spark):
    e = queries.ev(spark, SF)
    page = api.get_events(e, "s3").collect()
    assert page and {r.session for r in page} == {"s3"} and page[0].idx == 0
    alerts = detect.all_alerts(e, 240 * queries.HOUR, 5)
    assert {r.session for r in api.get_alerts(alerts, "s3").collect()} == {"s3"}
    assert api.incident_report(e, alerts, "s3").first().line.startswith("incident report for s3")
    with pytest.raises(ValueError):
        api.incident_report(e, alerts, "nobody")


def test_merkle_root_of_any_number_of_leaves(spark):
    import hashlib

    def root(nodes):
        if not nodes:
            return ledger.ZERO
        while len(nodes) > 1:
            nodes = [hashlib.sha256(b"\x01" + bytes.fromhex(nodes[i]) + bytes.fromhex(nodes[min(i + 1, len(nodes) - 1)])).hexdigest() for i in range(0, len(nodes), 2)]
        return nodes[0]

    leaves = [hashlib.sha256(str(i).encode()).hexdigest() for i in range(8193)]
    rows = [(n, leaves[:n]) for n in (0, 1, 2, 3, 5, 8, 4097, 8193)]
    got = spark.createDataFrame(rows, "n int, x array<string>").select("n", ledger.merkle_root(F.col("x")).alias("r")).collect()
    assert {r.n: r.r for r in got} == {n: root(x) for n, x in rows}


def test_markers_keep_their_types(spark):
    lines = ['{"event":"a","n":"1.5","m":"-3","l":"[x","b":true,"i":7,"z":null}', '{"event":"a","n":-3}', '{"event":"a","n":{"x":1}}', '{"event":5}', "{torn", "", None, '{"event":"a","other":[1]}', '{"event":"a","n":"token=abcdefgh1234"}']
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "id int, value string")
    got = {r.id: (r.reject_reason, r.fields) for r in events.parse_markers(df, ["a"], ["n", "m", "l", "b", "i", "z"], [], salt="s").collect()}
    assert got[0] == (None, {"n": "1.5", "m": "-3", "l": "[x", "b": "true", "i": "7"})
    assert [got[i][0] for i in range(1, 8)] == ["not_a_scalar", "not_a_scalar", "undeclared", "not_an_object", "not_an_object", "not_an_object", None]
    assert got[8][1]["n"].startswith("token=⟦R:entropy:")


def test_as_of_carries_over_buckets(spark, rows, table):
    answers = table.where("type = 'net.dns'").withColumn("v", F.col("row_id"))
    asked = table.where("type = 'net.connect'").unionByName(spark.createDataFrame([(9999, "s0", 5, "net.connect", None)], table.schema))
    whole, cut = ({r.row_id: (r._seen, r.r_v) for r in joins.as_of(asked, answers, "k", "us", ["v"], width=w).collect()} for w in (1 << 40, 7))
    assert whole == cut and whole[9999] == (None, None) and any(x[0] is not None for x in cut.values())


def test_attribution_ends_with_the_binding(spark):
    b = spark.createDataFrame([(1, "a", 10, 20), (1, "b", 20, None), (2, "c", 0, 5)], "cgid long, session string, bind_us long, unbind_us long")
    r = spark.createDataFrame([(i, c, us) for i, (c, us) in enumerate([(1, 9), (1, 10), (1, 19), (1, 20), (1, 99), (2, 5), (3, 1)])], "row_id long, cgid long, us long")
    held, lost = joins.attribute(r, b)
    assert {x.row_id: x.session for x in held.collect()} == {1: "a", 2: "a", 3: "b", 4: "b"} and {x.row_id for x in lost.collect()} == {0, 5, 6}


def test_small_tables_are_counted(spark):
    df = spark.range(10)
    hinted = lambda x: "isBroadcast" in x._jdf.queryExecution().analyzed().toString() or "ResolvedHint" in x._jdf.queryExecution().analyzed().toString()
    assert hinted(joins.small(df, 10)) and not hinted(joins.small(df, 9))


def test_reports_have_all_parts(spark):
    e = queries.ev(spark, SF)
    markers = spark.createDataFrame([("s3", "r1", 1, "started", ""), ("s3", "r1", 2, "ok", ""), ("s4", "r2", 1, "x", "")], "session string, run_id string, ord long, status string, agent string")
    lines = [r.line for r in api.incident_report(e, detect.all_alerts(e, 240 * queries.HOUR, 5), "s3", markers).collect()]
    assert lines[0].startswith("incident report for s3") and lines[-2:] == ["run r1: 2 markers, last status ok", detect.FOOTER] and len(lines) > 4
    quiet = spark.createDataFrame([(1, "q", 1, "fs.meta", None, None, None)], "row_id long, session string, us long, type string, path string, addr string, qname string")
    none = detect.all_alerts(e, 240 * queries.HOUR, 5).where("false")
    assert [r.line for r in api.incident_report(quiet, none, "q").collect()][1] == "no load-bearing events"
    assert [r.session for r in api.list_sessions(e).collect()] == [r.session for r in sorted(detect.session_list(e).collect(), key=lambda r: r.started_us)]


def test_stored_events_and_head_mirrors(spark, tmp_path):
    from tidewatch import schema

    path = str(tmp_path / "ev")
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "session string, ts_wall long").select(*(F.col(f.name) if f.name in ("session", "ts_wall") else F.lit(None).cast(f.dataType).alias(f.name) for f in schema.EVENT.fields))
    tables.append_events(rows, path)
    got = events.read_events(spark, path, "a")
    assert [r.session for r in got.collect()] == ["a"] and "EqualTo(session,a)" in got._jdf.queryExecution().executedPlan().toString()
    heads = spark.createDataFrame([("a", 1, [1], [2], 3)], "session_id string, seg_last long, chain_head array<int>, ckpt_hash array<int>, at long")
    for _ in range(2):
        tables.append_heads(heads, str(tmp_path / "heads"))
    assert [(r.session_id, r.error) for r in events.read_heads(spark, str(tmp_path / "heads")).collect()] == [("a", False)] * 2


def test_restart_gaps(spark):
    batches = spark.createDataFrame([(0,), (10,), (100,), (105,)], "us long")
    sessions = spark.createDataFrame([("open", 5, None), ("over", 0, 50), ("late", 101, None)], "session string, start_us long, end_us long")
    got = [(r.session, r.reason, r.from_us, r.to_us) for r in govern.restart_gaps(batches, sessions, 50).collect()]
    assert got == [("open", "daemon_restart", 10, 100)]


def test_cards_and_tokens(spark):
    rows = [("4111111111111111", True), ("4111111111111112", False), ("0000000000", False)]
    got = spark.createDataFrame(rows, "d string, want boolean").select(text.is_card(F.col("d")).alias("got"), "want").collect()
    assert all(r.got == r.want for r in got)
    r = random.Random(4)
    work = redact.Redactor("s")
    words = ["".join(r.choice(B62 + "-_") for _ in range(r.randrange(1, 40))) for _ in range(300)] + ["".join(r.choice(HEX) for _ in range(r.randrange(14, 40))) for _ in range(100)] + ["0f8fad5b-d9cb-469f-a165-70867728950e", "configuration"]
    known = tuple(x.decode() for x in redact.COMMON_WORDS)
    got = spark.createDataFrame([(w,) for w in words], "w string").select("w", text.high_entropy_token(F.col("w"), known).alias("hit")).collect()
    assert {x.w: x.hit for x in got} == {w: work._secret(w.encode()) for w in words}


def test_entry_lists_every_query():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
