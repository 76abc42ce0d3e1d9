"""Line dedup: sharded cuckoo filters over exact reference-count tables.

An index holds three tables in the shared folder:

* ``refs``    (k1, k2, doc_id): one row for each document that holds a line key,
* ``counts``  (k1, k2, n_docs, keep_doc): exact reference counts,
* ``filters`` (shard, n_keys, blob): a cuckoo filter for each shard, over the keys found in at
  least ``min_docs`` documents.

To clean documents, their keys are routed to their shard's filter, which drops nearly all keys
that no other text shares; only what it lets through is joined with the exact counts, so a false
positive costs a row and never a line. New documents raise counts and deleted ones lower them. A
key that crosses ``min_docs`` enters or leaves its shard's filter, so ``delete`` after ``insert``
restores the tables. Such a change writes only rows of the keys and shards that it touches; the
tables read older rows beside them, and ``compact`` writes them anew.

Scale: there is a shard for each ``SHARD_KEYS`` shared keys; when an index outgrows its shards
fourfold its filters are built anew. Counts are combined before the shuffle, so a line in a third
of all documents is one row a task. Probing deals a shard's rows over as many groups as it has
``GROUP_ROWS``, each with a copy of the shard's filter, so a hot line's rows spread. Keys are
128-bit hashes of the normalized line.

Edge cases: a null or empty text is one empty line; rows with a null id hold no references and
keep all lines; repeated rows of one id count as one document and each is cleaned; a line as
often as it occurs in its keeping document stays as often; empty tables give empty tables.
Columns besides id and text are carried through, but for those named like the outputs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunked, lean, materialize, text_bytes, whole

MIN_CHARS = 20
MIN_DOCS = 3
SHARD_KEYS = 1 << 16  # keys that one filter holds, on average, when it is built
GROUP_ROWS = 1 << 14  # rows that one probing group holds at most, on average
LOST, LOST_ID = "__line_lost", "__line_lost_id"


class CuckooFilter:
    """Buckets of four 16-bit fingerprints over 64-bit hashes; supports deletion.

    Lookups, insertions and the moves that insertions cause are vectorized. When an insertion
    finds no room the table doubles and refills from the exact keys, so membership never has a
    false negative.
    """

    SLOTS = 4
    ROUNDS = 500

    def __init__(self, n_keys: int):
        self.bits = max(2, int(np.ceil(np.log2(max(1, n_keys) / (self.SLOTS * 0.85)))))
        self.table = np.zeros((1 << self.bits, self.SLOTS), np.uint16)

    @classmethod
    def build(cls, keys: np.ndarray) -> CuckooFilter:
        size = len(keys)
        while True:
            made = cls(size)
            if made.insert(keys):
                return made
            size = max(2 * size, 8)

    def _places(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        h = hashes.astype(np.uint64, copy=False)
        mark = (h & np.uint64(0xFFFF)).astype(np.uint16)
        mark[mark == 0] = 1
        mask = np.uint64((1 << self.bits) - 1)
        first = (h >> np.uint64(16)) & mask
        return mark, first.astype(np.int64), self._other(first, mark, mask)

    def _other(self, place, mark, mask) -> np.ndarray:
        return ((place ^ (mark.astype(np.uint64) * np.uint64(0x5BD1E995))) & mask).astype(np.int64)

    def contains(self, hashes: np.ndarray) -> np.ndarray:
        mark, a, b = self._places(hashes)
        return (self.table[a] == mark[:, None]).any(1) | (self.table[b] == mark[:, None]).any(1)

    def insert(self, keys) -> bool:
        """Add keys; false if some find no room, and then the table is not to be used."""
        mark, place, other = self._places(np.atleast_1d(np.asarray(keys, np.uint64)))
        mask = np.uint64((1 << self.bits) - 1)
        for turn in range(self.ROUNDS):
            if not len(mark):
                return True
            # marks of one bucket take its free slots in turn
            order = np.argsort(place, kind="stable")
            mark, place, other = mark[order], place[order], other[order]
            nth = np.arange(len(place)) - np.searchsorted(place, place)
            free = self.table[place] == 0
            fits = nth < free.sum(1)
            slot = np.argmax(np.cumsum(free[fits], 1) > nth[fits, None], 1)
            self.table[place[fits], slot] = mark[fits]
            mark, place, other, nth = mark[~fits], place[~fits], other[~fits], nth[~fits]
            if turn == 0:
                place, other = other, place
                continue
            # one mark of each full bucket changes places with one that waits for it
            first = np.unique(place, return_index=True)[1]
            at, slot = place[first], (turn * 7 + place[first]) % self.SLOTS
            out = self.table[at, slot]
            self.table[at, slot] = mark[first]
            mark = mark.copy()
            mark[first] = out
            place = place.copy()
            place[first] = self._other(at.astype(np.uint64), out, mask)
        return not len(mark)

    def delete(self, keys) -> bool:
        """Remove keys that are held, once each; false if one is not found."""
        mark, place, other = self._places(np.atleast_1d(np.asarray(keys, np.uint64)))
        for _ in range(2):
            # equal marks of one bucket take its slots in turn
            order = np.lexsort([mark, place])
            mark, place, other = mark[order], place[order], other[order]
            both = place.astype(np.int64) << 16 | mark
            nth = np.arange(len(both)) - np.searchsorted(both, both)
            held = self.table[place] == mark[:, None]
            fits = nth < held.sum(1)
            self.table[place[fits], np.argmax(np.cumsum(held[fits], 1) > nth[fits, None], 1)] = 0
            mark, place, other = mark[~fits], other[~fits], place[~fits]
        return not len(mark)

    def dump(self) -> bytes:
        return bytes([self.bits]) + self.table.tobytes()

    @classmethod
    def load(cls, blob: bytes) -> CuckooFilter:
        made = cls.__new__(cls)
        made.bits = blob[0]
        made.table = np.frombuffer(blob[1:], np.uint16).reshape(1 << made.bits, cls.SLOTS).copy()
        return made


def line_key(line: bytes, min_chars: int) -> bytes | None:
    """16 bytes for a line whose stripped form has ``min_chars`` code points; else None."""
    key = line.strip().lower()
    if len(key) < min_chars or (len(key) < 4 * min_chars and len(key.decode()) < min_chars):
        return None
    return hashlib.blake2b(key, digest_size=16).digest()


def _line_keys(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """(k1, k2, doc_id), one row for each distinct key of a row."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in whole(batches):
            found, owner = [], []
            for doc, text in zip(ids.to_pylist(), texts.to_pylist()):
                own = {k for line in text.split(b"\n") if (k := line_key(line, min_chars))}
                found += own
                owner += [doc] * len(own)
            halves = np.frombuffer(b"".join(found), "<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(halves[:, 0]), pa.array(halves[:, 1]), pa.array(owner, pa.int64())], ["k1", "k2", "doc_id"])

    held = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), text_bytes(text_col).alias("text"))
    held = held.select("doc_id", F.posexplode(chunked(F.col("text"))).alias("number", "part"))
    return held.mapInArrow(lean(task), "k1 long, k2 long, doc_id long")


def _shard(shards: int):
    return F.pmod(F.col("k1"), F.lit(shards)).cast("int")


def _counted(refs: DataFrame) -> DataFrame:
    return refs.groupBy("k1", "k2").agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("keep_doc"))


def _filters(shared: DataFrame, shards: int) -> DataFrame:
    def build(group: pd.DataFrame) -> pd.DataFrame:
        made = CuckooFilter.build(group.k2.to_numpy().view(np.uint64))
        return pd.DataFrame({"shard": [group.shard.iloc[0]], "n_keys": [len(group)], "blob": [made.dump()]})

    return shared.select(_shard(shards).alias("shard"), "k2").groupBy("shard").applyInPandas(build, "shard int, n_keys long, blob binary")


@dataclass
class LineIndex:
    refs: DataFrame
    counts: DataFrame
    filters: DataFrame
    shards: int
    min_chars: int = MIN_CHARS
    min_docs: int = MIN_DOCS

    @classmethod
    def build(cls, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, shard_keys: int = SHARD_KEYS) -> LineIndex:
        # distinct, for repeated rows of one id are one document
        refs = materialize(_line_keys(docs, id_col, text_col, min_chars).distinct(), "line-refs")
        counts = materialize(_counted(refs), "line-counts")
        shared = counts.where(F.col("n_docs") >= min_docs)
        shards = shared.count() // shard_keys + 1
        return cls(refs, counts, materialize(_filters(shared, shards), "line-filters"), shards, min_chars, min_docs)

    def compact(self) -> LineIndex:
        """The same index with each table in one piece."""
        parts = (materialize(x, f"line-{name}") for x, name in ((self.refs, "refs"), (self.counts, "counts"), (self.filters, "filters")))
        return LineIndex(*parts, self.shards, self.min_chars, self.min_docs)

    def probe(self, keys: DataFrame) -> DataFrame:
        """The rows of ``keys`` (k1, k2, doc_id) that their shard's filter lets through."""
        keys = keys.withColumn("shard", _shard(self.shards))
        load = self.counts.groupBy(_shard(self.shards).alias("shard")).agg(F.sum("n_docs").alias("n"))
        load = load.select("shard", F.ceil(F.col("n") / GROUP_ROWS).cast("int").alias("groups"))
        dealt = keys.join(load, "shard", "left").withColumn("part", F.pmod(F.xxhash64("doc_id"), F.coalesce("groups", F.lit(1))).cast("int"))
        copies = self.filters.join(load, "shard").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)))

        def passed(rows: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
            if not len(rows) or not len(held):
                return rows.iloc[:0][["k1", "k2", "doc_id"]]
            maybe = CuckooFilter.load(held.blob.iloc[0]).contains(rows.k2.to_numpy().view(np.uint64))
            return rows.loc[maybe, ["k1", "k2", "doc_id"]]

        left = dealt.select("shard", "part", "k1", "k2", "doc_id").groupBy("shard", "part")
        return left.cogroup(copies.select("shard", "part", "blob").groupBy("shard", "part")).applyInPandas(passed, "k1 long, k2 long, doc_id long")

    def dropped(self, keys: DataFrame | None = None) -> DataFrame:
        """(k1, k2, doc_id): the lines that a document loses. ``keys``: the index's own by default."""
        shared = self.counts.where(F.col("n_docs") >= self.min_docs).select("k1", "k2", "keep_doc")
        maybe = self.probe(self.refs if keys is None else keys)
        return maybe.join(shared, ["k1", "k2"]).where("doc_id < keep_doc").select("k1", "k2", "doc_id")

    def insert(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> LineIndex:
        """The index with new documents. Of an id that the index has, only keys that it lacks are added, so inserting twice changes nothing."""
        keys = _line_keys(docs, id_col, text_col, self.min_chars).distinct()
        delta = materialize(keys.join(self.refs, ["k1", "k2", "doc_id"], "left_anti"), "line-new")
        more = _counted(delta).withColumnsRenamed({"n_docs": "more", "keep_doc": "newest"})
        was = self.counts.join(more, ["k1", "k2"], "right")
        touched = was.select("k1", "k2", F.coalesce("n_docs", F.lit(0)).alias("before"), (F.coalesce("n_docs", F.lit(0)) + F.col("more")).alias("n_docs"), F.greatest("keep_doc", "newest").alias("keep_doc"))
        return self._changed(self.refs.unionByName(delta), touched)

    def delete(self, doc_ids: DataFrame) -> LineIndex:
        """The index without the documents of ``doc_ids`` (column doc_id)."""
        gone = self.refs.join(doc_ids.select(F.col("doc_id").cast("long")).distinct(), "doc_id", "left_semi")
        gone = materialize(gone.select("k1", "k2", "doc_id"), "line-gone")
        refs = self.refs.join(gone, ["k1", "k2", "doc_id"], "left_anti").select("k1", "k2", "doc_id")
        less = gone.groupBy("k1", "k2").agg(F.count("*").alias("less"), F.max("doc_id").alias("lost_doc"))
        was = self.counts.join(less, ["k1", "k2"])
        # only keys that lose the document that keeps their line look for the next one
        orphans = was.where(F.col("keep_doc") == F.col("lost_doc")).select("k1", "k2")
        heirs = refs.join(orphans, ["k1", "k2"], "left_semi").groupBy("k1", "k2").agg(F.max("doc_id").alias("heir"))
        keep = F.when(F.col("keep_doc") == F.col("lost_doc"), F.col("heir")).otherwise(F.col("keep_doc"))
        return self._changed(refs, was.join(heirs, ["k1", "k2"], "left").select("k1", "k2", F.col("n_docs").alias("before"), (F.col("n_docs") - F.col("less")).alias("n_docs"), keep.alias("keep_doc")))

    def _changed(self, refs: DataFrame, touched: DataFrame) -> LineIndex:
        """``touched``: k1, k2, the count before, n_docs and keep_doc of the keys that change."""
        touched = materialize(touched, "line-touched")
        old = self.counts.join(touched.select("k1", "k2"), ["k1", "k2"], "left_anti")
        counts = old.unionByName(touched.where("n_docs > 0").select("k1", "k2", "n_docs", "keep_doc"))
        shared = counts.where(F.col("n_docs") >= self.min_docs)
        enters, leaves = (F.col("before") < self.min_docs) & (F.col("n_docs") >= self.min_docs), (F.col("before") >= self.min_docs) & (F.col("n_docs") < self.min_docs)
        change = touched.where(enters | leaves).select(_shard(self.shards).alias("shard"), "k2", enters.alias("enters"))
        crossed = change.groupBy("shard").agg(F.count("*").alias("n_changes"))
        n_keys = self.filters.agg(F.sum("n_keys")).first()[0] or 0
        if n_keys + touched.where(enters).count() > 4 * self.shards * SHARD_KEYS:
            shards = shared.count() // SHARD_KEYS + 1
            return LineIndex(refs, counts, materialize(_filters(shared, shards), "line-filters"), shards, self.min_chars, self.min_docs)
        full = shared.select(_shard(self.shards).alias("shard"), "k2", F.lit(None).cast("boolean").alias("enters")).join(crossed, "shard", "left_semi")

        def update(rows: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
            if not len(rows):
                return held.iloc[:0][["shard", "n_keys", "blob"]]
            change, exact = rows[rows.enters.notna()], rows[rows.enters.isna()]
            if not len(exact):
                return held.iloc[:0][["shard", "n_keys", "blob"]]
            table = CuckooFilter.load(held.blob.iloc[0]) if len(held) else CuckooFilter(len(exact))
            keys = change.k2.to_numpy().view(np.uint64)
            enters = change.enters.to_numpy(bool)
            if not (table.delete(keys[~enters]) and table.insert(keys[enters])):  # full: refill from the exact keys
                table = CuckooFilter.build(exact.k2.to_numpy().view(np.uint64))
            return pd.DataFrame({"shard": [rows.shard.iloc[0]], "n_keys": [len(exact)], "blob": [table.dump()]})

        rows = change.unionByName(full)
        made = rows.groupBy("shard").cogroup(self.filters.groupBy("shard")).applyInPandas(update, "shard int, n_keys long, blob binary")
        filters = self.filters.join(crossed, "shard", "left_anti").unionByName(materialize(made, "line-filters"))
        return LineIndex(refs, counts, filters, self.shards, self.min_chars, self.min_docs)

    def clean(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """``docs`` with the text cut to its kept lines, and n_lines and n_dropped (long)."""
        lost = self.dropped().groupBy("doc_id").agg(F.collect_list(F.struct("k1", "k2")).alias(LOST))
        lost = lost.withColumnRenamed("doc_id", LOST_ID)
        joined = docs.drop("n_lines", "n_dropped").join(lost, F.col(id_col).cast("long") == F.col(LOST_ID), "left").drop(LOST_ID)
        return _cut(joined, text_col, self.min_chars)


def _cut(joined: DataFrame, text_col: str, min_chars: int) -> DataFrame:
    """Rows without lost keys keep their text as it is; the others lose those keys' lines."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            texts, losts = batch.column(names.index(text_col)).to_pylist(), batch.column(names.index(LOST))
            k1, k2 = (losts.flatten().field(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            lengths = losts.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            pairs, at = np.column_stack([k1, k2]).astype("<i8").tobytes(), 0
            kept, n_lines, n_dropped = [], [], []
            for text, n in zip(texts, lengths):
                gone = {pairs[16 * i : 16 * i + 16] for i in range(at, at + n)}
                at += n
                lines = (text or "").encode().split(b"\n")
                stay = [x for x in lines if line_key(x, min_chars) not in gone] if gone else lines
                kept.append(b"\n".join(stay).decode() if gone else text)
                n_lines.append(len(lines))
                n_dropped.append(len(lines) - len(stay))
            columns = [pa.array(kept, batch.schema.field(c).type) if c == text_col else batch.column(c) for c in names if c != LOST]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())], [c for c in names if c != LOST] + ["n_lines", "n_dropped"])

    from pyspark.sql.types import LongType, StructField, StructType

    out = StructType([f for f in joined.schema.fields if f.name != LOST] + [StructField(n, LongType()) for n in ("n_lines", "n_dropped")])
    return joined.mapInArrow(lean(task), out)


def op3_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    cleaned = LineIndex.build(docs).clean(docs)
    return cleaned.select("doc_id", "n_lines", "n_dropped", F.sha2(text_bytes(), 256).alias("kept_sha256"))


OP3_SQL = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS p
  FROM documents),
k AS (
  SELECT doc_id, p, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM l),
c AS (SELECT key, max(doc_id) AS keep_doc FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
m AS (SELECT k.doc_id, k.p, k.line, coalesce(k.doc_id < c.keep_doc, false) AS gone FROM k LEFT JOIN c USING (key))
SELECT doc_id, count(*) AS n_lines, CAST(sum(CAST(gone AS INTEGER)) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY p) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
