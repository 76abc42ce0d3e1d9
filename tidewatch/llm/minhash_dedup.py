"""MinHash near-dedup with sequential Bayesian verification.

1. One scan gives each text the number of its distinct word shingles, a 128-bit digest of the
   shingle set and a MinHash signature. Texts of one set form a class; its smallest id stands for
   it, so thousands of copies are one row from here on.
2. Banded signatures give buckets of class representatives.
3. Candidates are compared batch by batch: after each batch of signature rows the posterior of
   the similarity (uniform prior) is bounded, and a pair is pruned when the chance that it still
   reaches the threshold is below ``MISS``. Survivors are verified exactly on their full sets.
   Before, candidates with too many shingles that no other candidate holds are set aside: they
   cannot reach the threshold with any partner, which empties large groups of texts that are
   alike but not alike enough.
4. Links become connected components by alternating large-star and small-star steps.

No bucket is expanded to all its pairs. In rounds, each member is compared with one hub of its
buckets, other hubs each round; members that are then in one component need no more comparisons. What is
left, each bucket's members outside its largest component, is compared with all members of that
bucket in other components, so no link is lost: this costs (left over) x (bucket) rather than the
square of the bucket. Such comparisons run on longer signatures, block by block inside tasks.

With ``BANDS`` bands of ``ROWS`` rows a pair at the threshold t shares no bucket with probability
(1 - t^ROWS)^BANDS: 2e-10 at 0.85, 1.4e-7 at 0.8.

Edge cases: null or empty texts, or texts without words, have no shingles, link with nothing and
are kept; shorter texts than a shingle are one shingle; rows with a null id are kept, with a null
component; rows of one id are one document and are taken to hold one text; empty tables give empty
tables. Shingles are held as 64-bit hashes.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunked, lean, materialize, text_bytes, whole

BANDS, ROWS = 30, 4
BATCH = 16  # signature rows compared at a time
MISS = 1e-7
LONG = 1024  # rows of the longer signature of members that are left over and those they meet, a byte each
LONG_BATCH = 64
HUB_ROUNDS = 2
BLOCK = 1024  # members of a bucket in a block of the last comparison
TOGETHER = 512  # members of smaller buckets that are compared in one call, on average
PAIRS = 100_000  # pairs at a time there
#: Odd multipliers and offsets of the signature's hash functions, from a fixed seed.
_RNG = np.random.default_rng(20240607)
_MULTIPLY = _RNG.integers(1, 1 << 63, BANDS * ROWS + LONG, np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _RNG.integers(0, 1 << 63, BANDS * ROWS + LONG, np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    """A fixed bijection of 64-bit numbers that spreads every input bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Sets of 64-bit shingle hashes of texts. Keeps the hashes of the words it has met, up to a bound."""

    WORDS = 250_000

    def __init__(self, size: int):
        self.size, self.known = size, {}

    def sets(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All texts' sorted distinct hashes in a row, and how many each has."""
        split = [t.lower().split() for t in texts]
        if len(self.known) > self.WORDS:
            self.known = {}
        known = self.known
        for w in {w for words in split for w in words if w not in known}:
            known[w] = int.from_bytes(hashlib.blake2b(w, digest_size=8).digest(), "little")
        lengths = np.fromiter(map(len, split), np.int64, len(split))
        words = np.fromiter((known[w] for own in split for w in own), np.uint64, int(lengths.sum()))
        width = np.minimum(lengths, self.size)  # words in a shingle
        count = np.maximum(lengths - self.size + 1, (lengths > 0).astype(np.int64))
        first, at = np.cumsum(lengths) - lengths, np.cumsum(count) - count
        place = np.repeat(first - at, count) + np.arange(int(count.sum()))
        wide = np.repeat(width, count)
        mixed = wide.astype(np.uint64)
        for k in range(self.size):
            use = wide > k
            mixed[use] = _mix(mixed[use] * np.uint64(0x9E3779B97F4A7C15) + words[place[use] + k])
        out = [np.unique(mixed[a : a + n]) for a, n in zip(at, count)]
        return (np.concatenate(out) if out else mixed), np.fromiter(map(len, out), np.int64, len(out))


def _signatures(flat: np.ndarray, counts: np.ndarray, first: int = 0, rows: int = BANDS * ROWS) -> np.ndarray:
    """[document, row] of uint32 for some of the hash functions; every document has shingles."""
    out = np.empty((len(counts), rows), np.uint32)
    ends = np.cumsum(counts)
    at = 0
    while at < len(counts):  # about 32k hashes at a time stay in cache
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + (1 << 15), side="right")))
        begin = int(ends[at - 1]) if at else 0
        part, starts = flat[begin : ends[to - 1]], (ends[at:to] - counts[at:to] - begin)
        for j in range(rows):
            out[at:to, j] = np.minimum.reduceat(((part * _MULTIPLY[first + j] + _ADD[first + j]) >> np.uint64(32)).astype(np.uint32), starts)
        at = to
    return out


def _long_signatures(sets: DataFrame) -> DataFrame:
    """(id, long): the low byte of each of the LONG further rows."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                own = part.column(1).to_pylist()
                made = _signatures(np.frombuffer(b"".join(own), np.uint64), np.array([len(x) // 8 for x in own]), BANDS * ROWS, LONG)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([x.tobytes() for x in made.astype(np.uint8)], pa.binary())], ["id", "long"])

    return sets.select("id", "shingles").mapInArrow(lean(task), "id long, long binary")


def _parts(docs: DataFrame) -> DataFrame:
    """doc_id and text as ``whole`` takes them."""
    return docs.select("doc_id", F.posexplode(chunked(F.col("text"))).alias("number", "part"))


def _sketches(docs: DataFrame, shingle: int) -> DataFrame:
    """doc_id, n_shingles, digest (two longs), signature of every row with an id."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(shingle)
        for ids, texts in whole(batches):
            for at in range(0, len(texts), 512):
                flat, counts = shingler.sets(texts.slice(at, 512).to_pylist())
                some = counts > 0
                marks = np.zeros((len(counts), 2), np.int64)
                for i, (e, n) in enumerate(zip(np.cumsum(counts), counts)):
                    marks[i] = np.frombuffer(hashlib.blake2b(flat[e - n : e].tobytes(), digest_size=16).digest(), "<i8")
                made = iter(_signatures(flat, counts[some]))
                rows = [next(made).tobytes() if x else None for x in some]
                yield pa.RecordBatch.from_arrays([ids.slice(at, 512), pa.array(counts), pa.array(marks[:, 0].copy()), pa.array(marks[:, 1].copy()), pa.array(rows, pa.binary())], ["doc_id", "n_shingles", "d1", "d2", "signature"])

    return _parts(docs).mapInArrow(lean(task), "doc_id long, n_shingles long, d1 long, d2 long, signature binary")


def _band_keys(signatures: np.ndarray) -> np.ndarray:
    """[document, band] of 64-bit keys of uint32 signatures."""
    rows = signatures.reshape(-1, BANDS, ROWS).astype(np.uint64)
    key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), rows.shape[:2])
    for k in range(ROWS):
        key = _mix(key * np.uint64(0x9E3779B97F4A7C15) + rows[:, :, k])
    return key


def _stacked(cells, kind, width: int) -> np.ndarray:
    """Rows of a binary column as a matrix."""
    return np.frombuffer(b"".join(cells), kind).reshape(-1, width)


def _buckets(classes: DataFrame) -> DataFrame:
    """(bucket, band, id) of class representatives."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = _band_keys(_stacked(batch.column(1).to_pylist(), np.uint32, BANDS * ROWS))
            band = np.tile(np.arange(BANDS, dtype=np.int32), len(key))
            yield pa.RecordBatch.from_arrays([pa.array(key.reshape(-1).view(np.int64)), pa.array(band), pa.array(np.repeat(batch.column(0).to_numpy(), BANDS))], ["bucket", "band", "id"])

    return materialize(classes.select("id", "signature").mapInArrow(lean(task), "bucket long, band int, id long"), "minhash-bands")


def prune_bounds(threshold: float, length: int = BANDS * ROWS, batch: int = BATCH, miss: float = MISS) -> list[tuple[int, int]]:
    """(rows compared, fewest matches that go on): below it, P(similarity >= threshold) < miss.

    With a uniform prior the posterior after m matches in n rows is Beta(m + 1, n - m + 1), whose
    upper tail at t is the binomial P(X <= m | n + 1, t).
    """
    out = []
    for n in [*range(batch, length, batch), length]:
        tail, m = 0.0, -1
        while tail < miss:
            m += 1
            tail += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out.append((n, m))
    return out


def _prune(pairs: DataFrame, signatures: DataFrame, threshold: float) -> DataFrame:
    """(a, b) that the sequential comparison does not rule out."""
    left = signatures.select(F.col("id").alias("a"), F.col("signature").alias("sa"))
    right = signatures.select(F.col("id").alias("b"), F.col("signature").alias("sb"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "sa", "sb")
    bounds = prune_bounds(threshold)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint32).reshape(-1, BANDS * ROWS) for i in (2, 3))
            going, matched, done = np.arange(len(x)), np.zeros(len(x), np.int64), 0
            for n, least in bounds:
                matched[going] += (x[going, done:n] == y[going, done:n]).sum(1)
                going, done = going[matched[going] >= least], n
            yield pa.RecordBatch.from_arrays([batch.column(i).take(pa.array(going)) for i in (0, 1)] + [pa.array(matched[going])], ["a", "b", "matched"])

    return both.mapInArrow(lean(task), "a long, b long, matched long")


def _verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b) whose sets reach the similarity."""
    left = sets.select(F.col("id").alias("a"), F.col("shingles").alias("xa"))
    right = sets.select(F.col("id").alias("b"), F.col("shingles").alias("xb"))
    both = pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "xa", "xb")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                least, most = sorted((len(x), len(y)))
                common = 0 if 100 * least < percent * most else len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * common >= percent * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(pa.array(keep, pa.bool_())) for i in (0, 1)], ["a", "b"])

    return both.mapInArrow(lean(task), "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id reachable, for every id with an edge (columns a, b).

    Large-star and small-star steps in turn until nothing changes. A hub's edges are combined
    before each shuffle by taking minima, never gathered.
    """
    now = materialize(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct(), "cc-edges")
    mark = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        now = materialize(small.select("e.u", "e.v").where("u > v").distinct(), "cc-edges")
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == mark:
            return now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
        mark = seen


def _lonely(sets: DataFrame) -> DataFrame:
    """(id, r): the shingles that no other candidate holds, over those that some other holds.

    Two sets A and B with u_A and u_B such shingles have a similarity of m / (m + u_A + u_B) at
    most, m being the fewer of their other shingles; so a similarity of t needs
    r_A + r_B <= (1 - t) / t.
    """
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                own = part.column(1).to_pylist()
                ids = np.repeat(part.column(0).to_numpy(), [len(x) // 8 for x in own])
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(b"".join(own), "<i8")), pa.array(ids)], ["h", "id"])

    held = sets.mapInArrow(lean(task), "h long, id long").groupBy("h").agg(F.count("*").alias("n"), F.min("id").alias("id"))
    lonely = held.where("n = 1").groupBy("id").agg(F.count("*").alias("u"))
    sizes = sets.groupBy("id").agg(F.max(F.octet_length("shingles") / 8).alias("n"))
    u = F.coalesce("u", F.lit(0))
    return sizes.join(lonely, "id", "left").select("id", (u / F.greatest(F.col("n") - u, F.lit(1e-9))).alias("r"))


def _hub_pairs(members: DataFrame, turn: int, most: float) -> DataFrame:
    """(a, b): each member of a bucket of several components with one hub of its buckets, of another component.

    members: bucket, id, r, component. A bucket's hub is the member with the fewest lonely
    shingles, in later turns any that has few; of its buckets' hubs a member takes the one that
    it meets most often: one pair a member.
    """
    rank = F.struct("r", "id") if turn == 0 else F.struct((F.col("r") > most / 2).cast("double"), F.xxhash64("id", F.lit(turn)))
    hub = members.groupBy("bucket").agg(F.min_by(F.struct("id", "component", "r"), rank).alias("hub"), F.min("component").alias("lo"), F.max("component").alias("hi"))
    hub = hub.where("lo < hi").select("bucket", F.col("hub.id").alias("b"), F.col("hub.component").alias("cb"), F.col("hub.r").alias("rb"))
    met = members.join(hub, "bucket").where((F.col("component") != F.col("cb")) & (F.col("r") + F.col("rb") <= most)).groupBy("id", "b").agg(F.count("*").alias("n"))
    best = met.groupBy("id").agg(F.max_by("b", F.struct("n", -F.col("b"))).alias("b"))
    return best.select(F.least("id", "b").alias("a"), F.greatest("id", "b").alias("b")).distinct()


def _left_over_pairs(members: DataFrame, sets: DataFrame, signatures: DataFrame, most: float, threshold: float) -> DataFrame:
    """(a, b): members outside their bucket's largest component with the bucket's members of other
    components, unless their longer signatures rule the link out.

    Buckets are compared block by block inside tasks, small ones many in a call, a pair in the first
    band that it shares; only what may be linked leaves them.
    """
    by = members.groupBy("bucket", "component").agg(F.count("*").alias("n"))
    main = by.groupBy("bucket").agg(F.max_by("component", F.struct("n", "component")).alias("main"), F.count("*").alias("parts"), F.sum("n").alias("size"))
    split = materialize(members.join(main.where("parts > 1"), "bucket").withColumn("left", F.col("component") != F.col("main")), "minhash-split")
    contested = split.select("id").distinct()
    marks = _long_signatures(sets.join(contested, "id", "left_semi").dropDuplicates(["id"]))
    marks = materialize(marks.join(signatures.dropDuplicates(["id"]), "id"), "minhash-long")
    blocks = F.ceil(F.col("size") / BLOCK)
    own = F.pmod(F.xxhash64("id"), blocks)
    # a call costs more than the few pairs of a small bucket: many of these share one
    groups = max(1, math.ceil(split.where(F.col("size") <= BLOCK).count() / TOGETHER))
    group = F.when(F.col("size") <= BLOCK, F.pmod(F.xxhash64("bucket"), F.lit(groups))).otherwise(F.col("bucket")).alias("group")
    # right members meet every block of left ones
    every = F.explode(F.sequence(F.lit(0), blocks - 1))
    left = split.where("left").select(group, "bucket", own.alias("lb"), every.alias("rb"), "band", "id", "r", "component")
    right = split.select(group, "bucket", every.alias("lb"), own.alias("rb"), "id", "r", "component", "left")
    left, right = (x.join(marks, "id") for x in (left, right))
    left = left.toDF(*(f"{c}_a" for c in left.columns))
    bounds = prune_bounds(threshold + (1 - threshold) / 256, LONG, LONG_BATCH)

    def compare(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = [np.zeros((0, 2), np.int64)]
        if len(a) and len(b):
            b = b.sort_values("bucket")
            # a batch of rows is 8 words of 8 bytes
            x, y = (_stacked(s, np.uint64, LONG // 8).reshape(-1, LONG // LONG_BATCH, LONG_BATCH // 8) for s in (a.long_a, b.long))
            kx, ky = (_band_keys(_stacked(s, np.uint32, BANDS * ROWS)) for s in (a.signature_a, b.signature))
            band, ids_a, ra, ca = (a[c].to_numpy() for c in ("band_a", "id_a", "r_a", "component_a"))
            bucket, ids_b, rb, cb = (b[c].to_numpy() for c in ("bucket", "id", "r", "component"))
            left_b = b.left.to_numpy(bool)
            first = np.searchsorted(bucket, a.bucket_a.to_numpy(), "left")
            count = np.searchsorted(bucket, a.bucket_a.to_numpy(), "right") - first
            ends, at = np.cumsum(count), 0
            while at < len(count):
                to = max(at + 1, int(np.searchsorted(ends, ends[at] - count[at] + PAIRS, side="right")))
                some, n = count[at:to], int(count[at:to].sum())
                p = np.repeat(np.arange(at, to), some)
                q = np.arange(n) + np.repeat(first[at:to] - np.cumsum(some) + some, some)
                # two left-over members meet once
                fine = (ra[p] + rb[q] <= most) & (ca[p] != cb[q]) & (~left_b[q] | (ids_a[p] < ids_b[q]))
                p, q = p[fine], q[fine]
                matched = np.zeros(len(p), np.int64)
                for k, (_, least) in enumerate(bounds):
                    same = (x[p, k].view(np.uint8) == y[q, k].view(np.uint8)).view(np.uint64).sum(1)  # each byte a count up to 8
                    matched += ((same * np.uint64(0x0101010101010101)) >> np.uint64(56)).astype(np.int64)
                    go = matched >= least
                    if k == 0:  # few are left for the dearer look at the bands that they met in before
                        go[go] = (kx[p[go]] == ky[q[go]]).argmax(1) == band[p[go]]
                    p, q, matched = p[go], q[go], matched[go]
                    if not len(p):
                        break
                out.append(np.sort(np.column_stack([ids_a[p], ids_b[q]]), 1))
                at = to
        return pd.DataFrame(np.unique(np.concatenate(out), axis=0), columns=["a", "b"])

    met = left.groupBy("group_a", "lb_a", "rb_a").cogroup(right.groupBy("group", "lb", "rb"))
    return met.applyInPandas(compare, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row.

    Documents whose sets reach ``percent`` in 100 of Jaccard similarity are linked; the smallest
    id of each connected component is kept.
    """
    read = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_bytes(text_col).alias("text"))
    sketches = materialize(_sketches(read, shingle), "minhash-sketches")
    withs = sketches.where("signature is not null and doc_id is not null")
    classes = withs.groupBy("d1", "d2").agg(F.min_by(F.struct(F.col("doc_id").alias("id"), "signature"), "doc_id").alias("r")).select("d1", "d2", "r.id", "r.signature")
    classes = materialize(classes, "minhash-classes")
    # rows of one id stand for one document: its classes are linked below
    bands = _buckets(classes)
    shared = bands.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").select("bucket")
    members = materialize(bands.join(shared, "bucket", "left_semi").distinct(), "minhash-members")
    ids = materialize(members.select("id").distinct(), "minhash-ids")
    signatures = materialize(classes.select("id", "signature").join(ids, "id", "left_semi"), "minhash-signatures")
    sets = materialize(_shingle_sets(read.join(ids, read.doc_id == ids.id, "left_semi"), shingle), "minhash-sets")

    threshold = percent / 100
    most = (1 - threshold) / threshold + 1e-9
    members = materialize(members.join(_lonely(sets).where(F.col("r") <= most), "id").select("bucket", "band", "id", "r"), "minhash-members")
    links, component = None, members.withColumn("component", F.col("id"))
    for turn in range(HUB_ROUNDS + 1):
        if turn < HUB_ROUNDS:
            likely = _prune(_hub_pairs(component, turn, most), signatures, threshold)
        else:
            likely = _left_over_pairs(component, sets, signatures, most, threshold)
        found = materialize(_verify(likely, sets, percent), "minhash-links")
        links = found if links is None else links.unionByName(found)
        if turn < HUB_ROUNDS:
            now = components(links)
            component = members.join(now, "id", "left").select("bucket", "band", "id", "r", F.coalesce("component", "id").alias("component"))
            component = materialize(component, "minhash-members")
    # a class is a star around its representative, which also ties the classes of one id together
    member = withs.join(classes.select("d1", "d2", "id"), ["d1", "d2"]).where("doc_id != id").select(F.col("doc_id").alias("a"), F.col("id").alias("b"))
    final = components(links.unionByName(member))
    out = sketches.join(final.select(F.col("id").alias("doc_id"), "component"), "doc_id", "left")
    component_id = F.coalesce("component", "doc_id")
    return out.select("doc_id", "n_shingles", component_id.alias("component_id"), F.coalesce(F.col("doc_id") == component_id, F.lit(True)).alias("kept"))


def _shingle_sets(docs: DataFrame, shingle: int) -> DataFrame:
    """(id, shingles): little-endian sorted hashes."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(shingle)
        for ids, texts in whole(batches):
            for at in range(0, len(texts), 512):
                flat, counts = shingler.sets(texts.slice(at, 512).to_pylist())
                ends = np.cumsum(counts)
                yield pa.RecordBatch.from_arrays([ids.slice(at, 512), pa.array([flat[e - n : e].tobytes() for e, n in zip(ends, counts)], pa.binary())], ["id", "shingles"])

    return _parts(docs).mapInArrow(lean(task), "id long, shingles binary")


def op8_minhash_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), shingle=3, percent=85)


OP8_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
                                 ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS g
  FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
l AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d JOIN c USING (doc_id) LEFT JOIN n USING (doc_id)
"""
