"""Streams that replay a table give what the batch operators give."""

import pytest
from pyspark.sql import functions as F

from tidewatch.functions import classify
from tidewatch.operators import govern, joins, windows
from tidewatch.plans import detect, queries
from tidewatch.streaming import live

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def source(spark, tmp_path_factory):
    """The events in time order as three files, and as a batch."""
    path = str(tmp_path_factory.mktemp("stream") / "events")
    e = queries.ev(spark, SF).withColumn("ts", F.timestamp_micros("us"))
    for i in range(3):
        e.where((F.col("row_id") / 334).cast("int") == i).coalesce(1).write.mode("append").parquet(path)
    return path, spark.read.parquet(path)


def run(df, tmp_path, mode="append"):
    out = str(tmp_path / "out")
    df.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "log")).outputMode(mode).trigger(availableNow=True).start().awaitTermination(120)
    return df.sparkSession.read.schema(df.schema).parquet(out)


def test_bursts(spark, source, tmp_path):
    path, batch = source
    cls = classify.burst_class(F.col("type"))
    got = run(live.bursts(live.watch(live.tail(spark, path, batch.schema, files=1), "1 hour"), cls, 240 * queries.HOUR, 5), tmp_path)
    want = windows.bursts(batch, cls, 240 * queries.HOUR, 5)
    assert {r.row_id for r in got.collect()} == {r.row_id for r in want.collect()} != set()


def test_segments(spark, source, tmp_path):
    path, batch = source
    got = run(live.segments(live.tail(spark, path, batch.schema, files=1), 20, 120 * queries.HOUR), tmp_path)
    want = windows.segments(batch.select("session", "row_id", "us", "type"), 20, 120 * queries.HOUR)
    assert {(r.row_id, r.seg) for r in got.collect()} == {(r.row_id, r.seg) for r in want.collect()}


def test_first_contacts(spark, source, tmp_path):
    """The watermark moves past contacts that come again; they are not new."""
    path, batch = source
    contact = F.when(F.col("type") == "net.dns", F.col("qname")).when(F.col("type") == "net.connect", F.col("addr"))
    got = run(live.first_contacts(live.watch(live.tail(spark, path, batch.schema, files=1), "1 hour"), contact, 60 * 86_400_000_000), tmp_path)
    want = windows.first_contacts(batch, contact)
    key = lambda rows: sorted((r.session, r.contact, r.row_id) for r in rows)
    assert key(got.collect()) == key(want.collect())


def test_shedding(spark, source, tmp_path):
    path, batch = source
    tiered = lambda rows: rows.withColumn("tier", classify.shed_tier(F.col("type")))
    got = run(live.shed(tiered(live.watch(live.tail(spark, path, batch.schema, files=1), "1 hour")), rate=0.00002, burst=1), tmp_path)
    want = govern.shed(tiered(batch).select("session", "row_id", "us", "tier"), rate=0.00002, burst=1)
    assert {(r.row_id, r.shed) for r in got.collect()} == {(r.row_id, r.shed) for r in want.collect()}
    assert want.where("shed").count() > 0


def test_resumed_sources_and_loss_windows(spark, source, tmp_path):
    path, batch = source
    twice = live.tail(spark, path, batch.schema, files=1)
    got = run(live.once_each(live.watch(twice.withColumn("again", F.explode(F.array(F.lit(0), F.lit(1)))), "60 days")), tmp_path / "a")
    assert got.count() == batch.count()
    lost = live.watch(twice, "1 hour").withColumn("class", classify.event_class(F.col("type")))
    rows = run(live.loss_windows(lost, "5 seconds").select("session", "class", "count"), tmp_path / "b").collect()
    assert rows and {r["class"] for r in rows} <= {r["class"] for r in batch.select(classify.event_class(F.col("type")).alias("class")).collect()}
    live.append_batches(live.tail(spark, path, batch.schema, session="s3"), str(tmp_path / "c"), str(tmp_path / "log_c")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "c")).count() == batch.where("session = 's3'").count()


def test_correlation(spark, source, tmp_path):
    path, batch = source
    stream = lambda: live.watch(live.tail(spark, path, batch.schema, files=1), "60 days")
    reads = stream().where("type = 'fs.sensitive_read'")
    domains = stream().where("type = 'net.dns'").withColumn("contact", F.col("qname"))
    got = run(live.correlate(reads, domains, 6 * 3600), tmp_path)
    want = joins.within(detect.sensitive_alerts(batch), batch.where("type = 'net.dns'"), "session", "us", 6 * queries.HOUR)
    assert {(r.read_id, r.contact_id) for r in got.collect()} == {(r.l.row_id, r.r.row_id) for r in want.collect()}


def test_answers_expire(spark, tmp_path):
    """Within an answer's time to live, after it, and once its state has gone with the watermark."""
    S = 1_000_000
    rows = [("a", 1 * S, 1, "answer", "x", 10 * S), ("a", 5 * S, 2, "connect", None, None), ("a", 12 * S, 3, "connect", None, None), ("b", 5 * S, 4, "connect", None, None)]
    later = [("c", 9000 * S, 5, "connect", None, None)], [("a", 9001 * S, 6, "connect", None, None), ("a", 9002 * S, 7, "answer", "y", 5 * S), ("a", 9003 * S, 8, "connect", None, None)]
    path = str(tmp_path / "in")
    for part in (rows, *later):
        df = spark.createDataFrame(part, "addr string, us long, row_id long, kind string, qname string, ttl_us long").withColumn("ts", F.timestamp_micros("us"))
        df.coalesce(1).write.mode("append").parquet(path)
    got = run(live.latest_answers(live.watch(live.tail(spark, path, df.schema, files=1), "10 seconds")), tmp_path)
    assert {(r.row_id, r.qname) for r in got.collect()} == {(2, "x"), (3, None), (4, None), (5, None), (6, None), (8, "y")}


def test_late_rows_are_kept_aside(source):
    _, batch = source
    newest = batch.agg(F.max("us")).first()[0]
    fine, late = live.split_late(batch, newest, 24 * queries.HOUR)
    assert fine.count() + late.count() == batch.count() and late.count() > 0


@pytest.fixture
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", live.STATE_STORE)
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


SECOND = 1_000_000
ROWS = "session string, row_id long, us long, type string, contact string, cls string, tier int"


def stepped(spark, tmp_path, made, batches):
    """What a stream gives for each batch of rows, written as a file one after another."""
    source = tmp_path / "in"
    source.mkdir()
    got = {}

    def keep(df, number):
        got[number] = sorted(tuple(r) for r in df.collect())

    rows = spark.readStream.schema(ROWS).option("maxFilesPerTrigger", 1).json(str(source)).withColumn("ts", F.timestamp_micros("us"))
    stream = made(live.watch(rows, "0 seconds")).writeStream.foreachBatch(keep).outputMode("append").option("checkpointLocation", str(tmp_path / "log"))
    out, seen = [], set()
    for i, batch in enumerate(batches):
        staged = tmp_path / f"b{i}"
        spark.createDataFrame(batch, ROWS).coalesce(1).write.json(str(staged))
        next(staged.glob("part-*")).rename(source / f"{i}.json")
        stream.trigger(availableNow=True).start().awaitTermination(120)
        out.append([r for n in sorted(set(got) - seen) for r in got[n]])
        seen = set(got)
    return out


def test_segments_close_by_timer(spark, rocks, tmp_path):
    """Another session's events move the watermark on; nothing of the first one comes."""
    at = lambda s, i, sec, kind="x": (s, i, sec * SECOND, kind, None, None, None)
    batches = [[at("a", i, i) for i in range(1, 4)], [at("b", 9, 30)], [at("b", 10, 100)], [at("a", 11, 101), at("a", 12, 170), at("a", 13, 171, "session.end"), at("a", 14, 172)]]
    got = stepped(spark, tmp_path, lambda e: live.closed_segments(e, 5, 60 * SECOND), batches)
    assert got[0] == got[1] == []
    assert ("a", 0, 3, SECOND, 3 * SECOND, "timer") in got[2] and ("b", 0, 1, 30 * SECOND, 30 * SECOND, "age") in got[2]
    assert [r for r in got[3] if r[0] == "a"] == [("a", 1, 1, 101 * SECOND, 101 * SECOND, "age"), ("a", 2, 2, 170 * SECOND, 171 * SECOND, "end")]


def test_session_end_clears_everything(spark, rocks, tmp_path):
    col = F.col
    at = lambda i, sec, kind="x", contact=None, cls=None, tier=None, s="a": (s, i, sec * SECOND, kind, contact, cls, tier)
    first = [at(1, 1, contact="h1"), at(2, 2, contact="h1"), at(3, 3, cls="c"), at(4, 4, cls="c"), at(5, 5, cls="c"), at(6, 6, tier=0), at(7, 6, tier=0)]
    again = [at(11, 11, contact="h1"), at(12, 12, cls="c"), at(13, 13, tier=0)]
    ended = [at(20, 20, "session.end")]
    anew = [at(31, 21, contact="h1"), at(32, 22, cls="c"), at(33, 23, cls="c"), at(34, 24, tier=0)]
    idle = [at(40, 5000, s="b")]
    later = [at(51, 5001, contact="h1")]
    made = lambda e: live.session_watch(e, col("contact"), col("cls"), col("tier"), 60 * SECOND, 2, rate=0.001, burst=1, idle_us=1000 * SECOND)
    got = [[(r[1], r[3]) for r in rows if r[0] == "a"] for rows in stepped(spark, tmp_path, made, [first, again, ended, anew, idle, later])]
    assert got == [[(1, "first_contact"), (4, "burst"), (7, "shed")], [(13, "shed")], [], [(31, "first_contact"), (33, "burst")], [], [(51, "first_contact")]]
