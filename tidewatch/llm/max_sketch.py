"""Ranked lexical search by hashed max-sketches of documents.

A term's impact in a document is its tf part of the score. A document's impacts fold into a row of
hashed coordinates that keep their maxima, so a term's coordinate is never below its impact, and
the weighted sum over a query's coordinates bounds its score from above. Queries are looked up in
batches: one matrix product gives the bounds of all of a block's queries for many documents. Then
each query rescores documents exactly in descending order of their bounds, until the next bound is
below the score of the k-th best that the task has found so far.

Two passes over the texts, none of which shuffles them: the first counts documents, terms and the
documents of each query term; the second scores. A task sends k rows a query at most; those meet
in two steps, first of groups of tasks, then of all. Queries go through in blocks of ``BLOCK``
items, so what is sent to the tasks is bounded however many items there are.

Edge cases: a null or empty text has no terms and is never found; a null or empty query finds
nothing; repeated documents are ranked as often as they occur, and equal items each get their
rows; a null document id comes after the others of its score; terms that no document holds count
with df 0; empty tables give an empty result. Only the ids and the texts are read. Ids of
documents are integers.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import slices, text_bytes

TOP = 50
BLOCK = 256  # items a pass
WIDTH = 4  # coordinates a distinct term of a document, at least
AT_ONCE = 256  # documents whose bounds are taken in one product
SLICE = 2 << 20  # bytes of text at a time
SPREAD = 64  # groups of tasks that meet first
LAST = np.iinfo(np.int64).max  # stands for a null id in the order

_KEPT = np.zeros(256, np.uint8) + 32
for _low, _high in ((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF)):
    _KEPT[_low : _high + 1] = np.arange(_low, _high + 1)
_KEPT[0x41 : 0x5B] += 32


def terms(texts: pa.Array) -> pa.ListArray:
    """Terms of UTF-8 texts: runs of letters, digits and all beyond ASCII; A-Z lower-cased."""
    texts = texts.cast(pa.binary())
    _, offsets, data = texts.buffers()
    ends = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int32)
    plain = _KEPT[np.frombuffer(data, np.uint8)[ends[0] : ends[-1]]] if ends[-1] > ends[0] else np.zeros(0, np.uint8)
    return pc.ascii_split_whitespace(pa.Array.from_buffers(pa.string(), len(texts), [None, pa.py_buffer(ends - ends[0]), pa.py_buffer(plain)]))


def term_hashes(words: list[str]) -> np.ndarray:
    """Well mixed 64-bit numbers of the words."""
    from hashlib import blake2b

    return np.frombuffer(b"".join(blake2b(w.encode(), digest_size=8).digest() for w in words), np.int64)


class Counted:
    """Distinct terms of each text of a slice: ``doc``, ``code``, ``tf``, ordered by document and code; ``n`` and ``distinct`` a text."""

    def __init__(self, texts: pa.Array):
        lists = terms(texts)
        doc = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False))
        each = lists.flatten()
        some = pc.not_equal(each, "")  # empty ones come from white space at an end
        doc, coded = doc[some.to_numpy(zero_copy_only=False)], each.filter(some).dictionary_encode()
        self.words, self.n = coded.dictionary, np.bincount(doc, minlength=len(lists))
        self.size = max(1, len(self.words))
        pairs = doc * self.size + coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.pairs, self.tf = np.unique(pairs, return_counts=True)
        self.doc, self.code = np.divmod(self.pairs, self.size)
        self.distinct = np.bincount(self.doc, minlength=len(lists))


class Queries:
    """A block of items: their distinct terms, and for each item the places of its own."""

    def __init__(self, texts: list[bytes]):
        lists = terms(pa.array(texts, pa.binary())).to_pylist()
        own = [sorted({w for w in words if w}) for words in lists]
        self.terms = sorted(set().union(*own))
        place = {w: i for i, w in enumerate(self.terms)}
        self.own = [np.array([place[w] for w in words], np.int64) for words in own]


class Sketches:
    """Coordinatewise maxima of the impacts of a slice's texts, a row of a power of two each, at least ``width`` times its distinct terms."""

    def __init__(self, counted: Counted, impacts: np.ndarray, hashes: np.ndarray, width: int = WIDTH):
        self.mask = (1 << np.ceil(np.log2(np.maximum(1, width * counted.distinct))).astype(np.int64)) - 1
        self.start = np.cumsum(self.mask + 1) - (self.mask + 1)
        self.flat = np.zeros(int((self.mask + 1).sum()), np.int32)
        np.maximum.at(self.flat, self.start[counted.doc] + (hashes[counted.code] & self.mask[counted.doc]), impacts.astype(np.int32))

    def bounds(self, at: np.ndarray, hashes: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Upper bounds of texts ``at`` for all queries: weights has a row a query, a column a term. Sums stay exact in doubles."""
        looked_up = self.flat[self.start[at, None] + (hashes[None, :] & self.mask[at, None])]
        return looked_up.astype(np.float64) @ weights.T


class Best:
    """The k best (score, id) of each query of a task so far."""

    def __init__(self, queries: int, k: int):
        self.k = k
        self.score = [np.zeros(0, np.int64)] * queries
        self.id = [np.zeros(0, np.int64)] * queries
        self.floor = np.ones(queries)  # the score that a document must reach

    def add(self, q: int, score: np.ndarray, ids: np.ndarray) -> None:
        some = score > 0
        score, ids = np.concatenate([self.score[q], score[some]]), np.concatenate([self.id[q], ids[some]])
        order = np.lexsort([ids, -score])[: self.k]
        self.score[q], self.id[q] = score[order], ids[order]
        if len(order) == self.k:
            self.floor[q] = self.score[q][-1]


def weight(n: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


def rescore(counted: Counted, impacts: np.ndarray, docs: np.ndarray, codes: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Exact scores of texts ``docs`` for one query, whose terms have these codes in the slice and these weights."""
    wanted = docs[:, None] * counted.size + codes[None, :]
    at = np.minimum(np.searchsorted(counted.pairs, wanted), len(counted.pairs) - 1)
    return np.where(counted.pairs[at] == wanted, impacts[at], 0) @ weights


def _statistics(docs: DataFrame, wanted: list[str]) -> tuple[int, int, np.ndarray]:
    """Documents with a term, all their terms, and the documents of each wanted term."""
    value_set = pa.array(wanted, pa.string())

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n, length = np.zeros(len(wanted), np.int64), 0, 0
        for batch in batches:
            for at, to in slices(batch.column(1), SLICE):
                counted = Counted(batch.column(1).slice(at, to - at))
                n, length = n + int((counted.n > 0).sum()), length + int(counted.n.sum())
                place = pc.index_in(counted.words, value_set=value_set).fill_null(-1).to_numpy(zero_copy_only=False)
                held = np.bincount(counted.code, minlength=counted.size)[: len(place)]
                df[place[place >= 0]] += held[place >= 0]
        some = np.flatnonzero(df)
        places, values = [-2, -1, *some.tolist()], [n, length, *df[some].tolist()]
        yield pa.RecordBatch.from_arrays([pa.array(places, pa.int64()), pa.array(values, pa.int64())], ["place", "value"])

    rows = docs.mapInArrow(task, "place long, value long").groupBy("place").agg(F.sum("value").alias("value")).collect()  # two, and one a wanted term
    found, df = {r.place: r.value for r in rows}, np.zeros(len(wanted), np.int64)
    for place, value in found.items():
        if place >= 0:
            df[place] = value
    return found.get(-2, 0), found.get(-1, 0), df


def _search_block(docs: DataFrame, queries: Queries, k: int) -> DataFrame:
    """(item, task, doc_id, score): each task's k best documents of each item; ``item`` is its place in the block."""
    n_docs, length, df = _statistics(docs, queries.terms)
    weights = np.array([weight(n_docs, int(x)) if x else 0 for x in df], np.int64)
    asked = term_hashes(queries.terms)
    value_set = pa.array(queries.terms, pa.string())
    own = queries.own

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        best = Best(len(own), k)
        table = np.zeros((len(own), len(weights)))
        for q, places in enumerate(own):
            table[q, places] = weights[places]
        for batch in batches:
            for at, to in slices(batch.column(1), SLICE):
                ids = batch.column(0).slice(at, to - at).fill_null(int(LAST)).to_numpy(zero_copy_only=False)
                counted = Counted(batch.column(1).slice(at, to - at))
                if not len(counted.pairs):
                    continue
                m = 50 + np.array([50 * n * n_docs // length for n in counted.n.tolist()], np.int64)
                impacts = (1_000_000_000 * counted.tf) // (1000 * counted.tf + 20 * m[counted.doc])
                sketches = Sketches(counted, impacts, term_hashes(counted.words.to_pylist()))
                codes = pc.index_in(value_set, value_set=counted.words).fill_null(counted.size).to_numpy(zero_copy_only=False).astype(np.int64)
                known = codes < counted.size  # a code beyond the table would be the next document's
                for first in range(0, len(ids), AT_ONCE):
                    part = np.arange(first, min(len(ids), first + AT_ONCE))
                    bounds = sketches.bounds(part, asked, table)
                    for q in np.flatnonzero((bounds >= best.floor).any(0)).tolist():
                        order = np.argsort(-bounds[:, q], kind="stable")
                        places = own[q][known[own[q]]]
                        done = 0
                        while done < len(order) and bounds[order[done], q] >= best.floor[q]:
                            chosen = order[done : done + k]
                            chosen = chosen[bounds[chosen, q] >= best.floor[q]]
                            best.add(q, rescore(counted, impacts, part[chosen], codes[places], weights[places]), ids[part[chosen]])
                            done += len(chosen)
        found = [(q, i, s) for q in range(len(own)) for i, s in zip(best.id[q].tolist(), best.score[q].tolist())]
        columns = [[x[c] for x in found] for c in range(3)]
        columns[1] = [None if i == LAST else i for i in columns[1]]
        group = TaskContext.get().partitionId() % SPREAD
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array([group] * len(found), pa.int64()), *(pa.array(x, pa.int64()) for x in columns[1:])], ["item", "task", "doc_id", "score"])

    return docs.mapInArrow(task, "item long, task long, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, k: int = TOP, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", query_col: str = "text", block: int = BLOCK) -> DataFrame:
    """item_id, rank, doc_id, score: each item's k best documents with a score above 0."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_bytes(text_col).alias("text"))
    kind = items.schema[item_col].dataType.simpleString()
    spark, out = docs.sparkSession, None
    asked, waiting = items.select(F.col(item_col).alias("item_id"), text_bytes(query_col).alias("text")).toLocalIterator(), []

    def found(block_items: list[tuple]) -> DataFrame:
        top = _search_block(rows, Queries([bytes(text) for _, text in block_items]), k)
        for keys in (("item", "task"), ("item",)):
            order = Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
            top = top.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        names = spark.createDataFrame([(i, key) for i, (key, _) in enumerate(block_items)], f"item long, item_id {kind}")  # BLOCK rows at most
        return top.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")

    for item in asked:
        waiting.append((item.item_id, item.text))
        if len(waiting) == block:
            out, waiting = (found(waiting) if out is None else out.unionByName(found(waiting))), []
    if waiting or out is None:
        last = found(waiting) if waiting else spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
        out = last if out is None else out.unionByName(last)
    return out


def op11_max_sketch(spark, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


OP11_SQL = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t
  FROM documents),
s AS (SELECT count(*) AS nd, CAST(sum(len(t)) AS BIGINT) AS l FROM d WHERE len(t) > 0),
q AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark),
f AS (SELECT doc_id, r, n, term, CAST(count(*) AS BIGINT) AS tf FROM (SELECT doc_id, r, CAST(len(t) AS BIGINT) AS n, unnest(t) AS term FROM d) GROUP BY ALL),
w AS (
  SELECT term, CAST(floor(1000 * ln((2 * (SELECT nd FROM s) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w
  FROM f WHERE term IN (SELECT term FROM q) GROUP BY term),
x AS (
  SELECT item_id, r, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + ((50 * n * (SELECT nd FROM s)) // (SELECT l FROM s)))))) AS BIGINT) AS score
  FROM q JOIN w USING (term) JOIN f USING (term) GROUP BY item_id, r, doc_id)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank, doc_id, score
FROM x WHERE score > 0
QUALIFY rank <= 50
"""
