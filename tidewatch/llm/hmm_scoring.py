"""LM scoring: a hidden Markov language model trained by Baum-Welch, scored by the scaled forward recursion.

Model. A text is its words, ASCII letters lower-cased, then one end token. State k emits word w
with probability P(class(w) | k) * P(w | class(w)). The class is a hash of the word in a fixed
number of classes, so a state's table is bounded whatever the vocabulary; P(w | class) comes from
add-one counts over the whole training corpus, so the vocabulary itself is open and exact. With
p0 the add-one unigram model this factors into

    log P(text) = sum of log p0(token)  +  log of the forward sum over ratios r[k, class]

where r[k, c] = P(c | k) / p0(c): the first term needs exact corpus counts, the second a bounded
table. A word never seen in training is one more symbol, as in p0; the model gives it the share of
training tokens whose word occurs once (Good-Turing) in every state.

Plan.
1. ``encode``: one scan turns documents into chunks, each with a dictionary of its distinct words;
   a task holds one chunk. Chunks (word numbers, classes) and dictionaries are written once.
2. Word counts are summed over dictionaries, in each task before the shuffle, and joined back to
   the chunks' words; Spark splits a join's partition that a frequent word makes too large.
3. Each Baum-Welch iteration maps over the chunks, sums a task's expected counts locally, and
   adds the tasks' tables up in Spark by class; transitions and starts are a few numbers a task.
4. In scoring each chunk meets the counts of its own words only.

Edge cases: a null or empty text is the end token alone; a null id counts as training text and is
scored; repeated rows count and score each; an empty table gives no rows. Without training texts
every token has p0 = 1 / (V + 1) with V = 0 and the states' ratios are 1.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, text_bytes

STATES = 6
CLASSES = 1 << 15
ITERATIONS = 6  # at most; fewer when the likelihood settles
SETTLED = 0.01  # gain of a token's log-likelihood, in nats, at which iterations end
PRIOR = 20.0  # pseudo-tokens of p0 in each state's emissions
CHUNK_TOKENS = 4_000_000
PART_TOKENS = 250_000  # tokens in a row of encoded documents, or those of one document
BATCH_TOKENS = 600_000  # tokens that are in memory as state vectors at a time
END = b""  # no word is empty


def word_class(word: bytes) -> int:
    return zlib.crc32(word) % CLASSES


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7 == 2, F.lit(False))


class _Numbers(dict):
    """Numbers words as they are first asked for."""

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        return number


class _Chunk:
    def __init__(self, key: int):
        self.key, self.words = key, _Numbers()
        self.ids, self.held, self.lengths, self.codes, self.n = [], [], [], [], 0

    def add(self, doc, held: bool, text: bytes) -> None:
        words = text.lower().split()
        words.append(END)
        codes = np.fromiter(map(self.words.__getitem__, words), np.int32, len(words))
        self.ids.append(doc)
        self.held.append(held)
        self.lengths.append(len(codes))
        self.codes.append(codes)
        self.n += len(codes)

    def counts(self) -> np.ndarray:
        """Of each word in training texts."""
        own = [c for c, held in zip(self.codes, self.held) if not held]
        return np.bincount(np.concatenate(own), minlength=len(self.words)) if own else np.zeros(len(self.words), np.int64)


#: kind 0: a word of a chunk's dictionary; kind 1: some of the chunk's documents.
ENCODED = "kind int, chunk long, word binary, number int, n_train long, ids array<long>, held array<boolean>, lengths array<int>, codes binary, classes binary"


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunk_tokens: int = CHUNK_TOKENS) -> DataFrame:
    """Chunks and their dictionaries, written once; see ``ENCODED``."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 32
        kinds = {"kind": pa.int32(), "chunk": pa.int64(), "word": pa.binary(), "number": pa.int32(), "n_train": pa.int64(), "ids": pa.list_(pa.int64()), "held": pa.list_(pa.bool_()), "lengths": pa.list_(pa.int32()), "codes": pa.binary(), "classes": pa.binary()}

        def rows(n: int, **columns) -> pa.RecordBatch:
            made = [pa.array(columns[k], kind) if k in columns else pa.nulls(n, kind) for k, kind in kinds.items()]
            return pa.RecordBatch.from_arrays(made, list(kinds))

        def taken(chunk: _Chunk) -> Iterator[pa.RecordBatch]:
            words, counts = list(chunk.words), chunk.counts()
            for at in range(0, len(words), 50_000):
                part = words[at : at + 50_000]
                yield rows(len(part), kind=[0] * len(part), chunk=[chunk.key] * len(part), word=part, number=np.arange(at, at + len(part), dtype=np.int32), n_train=counts[at : at + len(part)])
            classes = np.fromiter(map(word_class, words), "<u2", len(words))
            at = 0
            while at < len(chunk.ids):
                to, total = at, 0
                while to < len(chunk.ids) and total < PART_TOKENS:
                    total, to = total + chunk.lengths[to], to + 1
                codes = np.concatenate(chunk.codes[at:to])
                yield rows(1, kind=[1], chunk=[chunk.key], ids=[chunk.ids[at:to]], held=[chunk.held[at:to]], lengths=[chunk.lengths[at:to]], codes=[codes.astype("<i4").tobytes()], classes=[classes[codes].tobytes()])
                at = to

        chunk, made = None, 0
        for batch in batches:
            for doc, held, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if chunk is None:
                    chunk, made = _Chunk(first + made), made + 1
                chunk.add(doc, held, text)
                if chunk.n >= chunk_tokens:
                    yield from taken(chunk)
                    chunk = None
        if chunk is not None:
            yield from taken(chunk)

    read = docs.select(F.col(id_col).cast("long"), held_out(F.col(id_col)), text_bytes(text_col))
    return materialize(read.mapInArrow(task, ENCODED), "hmm-encoded")


def sequences(row_lengths: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Batches of documents by falling length: (their numbers, lengths, first tokens)."""
    starts = np.cumsum(row_lengths) - row_lengths
    order = np.argsort(-row_lengths, kind="stable")
    at = 0
    while at < len(order):
        taken, total = at, 0
        while taken < len(order) and (total == 0 or total + row_lengths[order[taken]] <= BATCH_TOKENS):
            total += row_lengths[order[taken]]
            taken += 1
        docs = order[at:taken]
        yield docs, row_lengths[docs], starts[docs]
        at = taken


def time_major(lengths: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Token places by time, and where each time begins. Falling lengths need no padding: those
    documents that are longer than t are the first ones."""
    active = np.searchsorted(-lengths, -np.arange(lengths[0]), side="left")  # documents longer than t
    begins = np.concatenate([[0], np.cumsum(active)])
    t = np.repeat(np.arange(lengths[0]), active)
    d = np.arange(begins[-1]) - begins[t]
    return starts[d] + t, begins


@dataclass
class Model:
    """Bounded: STATES x STATES transitions and STATES x (CLASSES + 1) ratios."""

    start: np.ndarray
    move: np.ndarray
    ratio: np.ndarray  # [class, state]; the last class is that of unseen words

    def forward(self, classes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """log of each document's forward sum of ratios, by the scaled recursion in double precision."""
        out = np.zeros(len(lengths))
        for docs, own, starts in sequences(lengths):
            place, begins = time_major(own, starts)
            emit = self.ratio[classes[place]]
            alpha, total = None, np.zeros(len(docs))
            for t in range(own[0]):
                e = emit[begins[t] : begins[t + 1]]
                alpha = (self.start if alpha is None else alpha[: len(e)] @ self.move) * e
                scale = alpha.sum(1)
                alpha /= scale[:, None]
                total[: len(e)] += np.log(scale)
            out[docs] = total
        return out

    def expect(self, classes: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
        """Expected starts, transitions and [class, state] emissions, and the log of the forward sums."""
        k = len(self.start)
        starts_n, moves_n, emits_n, log = np.zeros(k), np.zeros((k, k)), np.zeros((len(self.ratio), k)), 0.0
        move, ratio = self.move.astype(np.float32), self.ratio.astype(np.float32)
        for docs, own, starts in sequences(lengths):
            place, begins = time_major(own, starts)
            cls = classes[place]
            emit = ratio[cls]
            alpha, scales = np.empty_like(emit), np.empty(len(emit), np.float32)
            last = None
            for t in range(own[0]):
                at = slice(begins[t], begins[t + 1])
                a = (self.start.astype(np.float32) if last is None else last[: at.stop - at.start] @ move) * emit[at]
                s = a.sum(1)
                a /= s[:, None]
                alpha[at], scales[at], last = a, s, a
            log += float(np.log(scales, dtype=np.float64).sum())
            # emit becomes emit * beta / scale, what the step before multiplies by
            gamma = alpha
            ahead = np.ones((0, k), np.float32)
            for t in range(own[0] - 1, -1, -1):
                at = slice(begins[t], begins[t + 1])
                n = at.stop - at.start
                beta = np.ones((n, k), np.float32)
                if len(ahead):
                    beta[: len(ahead)] = ahead @ move.T
                    moves_n += alpha[at][: len(ahead)].T @ ahead
                gamma_t = alpha[at] * beta
                ahead = emit[at] * beta / scales[at][:, None]
                gamma[at] = gamma_t
            starts_n += gamma[: begins[1]].sum(0)
            for j in range(k):
                emits_n[:, j] += np.bincount(cls, weights=gamma[:, j], minlength=len(emits_n))
        return starts_n, moves_n * self.move, emits_n, log


def first_model(states: int) -> Model:
    """Sticky states whose ratios differ by a fixed pattern of the class number."""
    spread = np.random.default_rng(7).gamma(2.0, 0.5, (CLASSES + 1, states))
    spread[-1] = 1
    return Model(np.full(states, 1 / states), np.full((states, states), 0.1 / states) + 0.9 * np.eye(states), spread)


def baum_welch(chunks: DataFrame, p0: np.ndarray, unseen: float, states: int = STATES, iterations: int = ITERATIONS) -> Model:
    """Train on the documents that are not held out.

    ``p0``: the unigram probability of each class, that of an unseen word last. ``unseen``: the
    model's own probability of an unseen word, in every state.
    """
    model = first_model(states)
    shared = chunks.sparkSession.sparkContext.broadcast
    rows = chunks.select("held", "lengths", "classes")
    before = -math.inf
    for _ in range(iterations):
        sent = shared(model)

        def task(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            own, sums, some = sent.value, None, False
            for batch in batches:
                # all rows at once, so that documents of like length meet
                keep = ~batch.column(0).flatten().to_numpy(zero_copy_only=False)
                lengths = batch.column(1).flatten().to_numpy().astype(np.int64)
                if not keep.any():
                    continue
                cls = np.frombuffer(b"".join(batch.column(2).to_pylist()), "<u2").astype(np.int32)[np.repeat(keep, lengths)]
                made = own.expect(cls, lengths[keep])
                sums = made if sums is None else [a + b for a, b in zip(sums, made)]
                some = True
            if some:
                starts, moves, emits, log = sums
                used = np.flatnonzero(emits.sum(1))
                table = np.concatenate([starts[None], moves, np.full((1, len(starts)), log), emits[used]])
                numbers = np.concatenate([-1 - np.arange(2 + len(moves)), used])
                yield pa.RecordBatch.from_arrays([pa.array(numbers.astype(np.int32)), *(pa.array(np.ascontiguousarray(table[:, j])) for j in range(table.shape[1]))], ["row", *(f"s{j}" for j in range(table.shape[1]))])

        columns = [f"s{j}" for j in range(states)]
        parts = rows.mapInArrow(task, "row int, " + ", ".join(f"{c} double" for c in columns))
        # at most CLASSES + STATES + 3 rows whatever the input
        sums = parts.groupBy("row").agg(*(F.sum(c).alias(c) for c in columns)).toPandas()
        sent.unpersist()
        if not len(sums):
            return Model(model.start, model.move, np.ones_like(model.ratio))
        seen = p0[:-1] / (1 - p0[-1])  # of a class, given that the word was seen
        at, table = sums["row"].to_numpy(), sums[columns].to_numpy()
        starts = table[at == -1][0] + 1
        moves = np.ones((states, states))
        for i in range(states):
            moves[i] += table[at == -2 - i][0]
        emits = np.zeros((CLASSES + 1, states))
        emits[at[at >= 0]] = table[at >= 0]
        log = float(table[at == -2 - states][0, 0] / max(emits.sum(), 1))  # a token's
        ratio = np.ones_like(emits)
        ratio[:-1] = (emits[:-1] / np.maximum(seen, 1e-300)[:, None] + PRIOR) / (emits.sum(0) + PRIOR)
        ratio[:-1] *= (1 - unseen) / (1 - p0[-1])
        ratio[-1] = unseen / p0[-1]
        model = Model(starts / starts.sum(), moves / moves.sum(1, keepdims=True), ratio)
        if log - before < SETTLED:
            break
        before = log
    return model


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", states: int = STATES, iterations: int = ITERATIONS, chunk_tokens: int = CHUNK_TOKENS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row."""
    encoded = encode(docs, id_col, text_col, chunk_tokens)
    chunks = encoded.where("kind = 1")
    words = encoded.where("kind = 0").select("chunk", "number", "word", "n_train")
    # summed in each task before the shuffle; the join back splits a frequent word's chunks
    totals = materialize(words.groupBy("word").agg(F.sum("n_train").alias("c")).where("c > 0").withColumn("class", F.pmod(F.crc32("word"), F.lit(CLASSES)).cast("int")), "hmm-totals")
    counted = materialize(words.join(totals, "word").select("chunk", "number", "class", "c"), "hmm-counts")
    # CLASSES rows at most
    by_class = totals.groupBy("class").agg(F.sum("c").alias("c"), F.count("*").alias("v"), F.count_if(F.col("c") == 1).alias("once")).toPandas()
    n, v, once = (int(by_class[x].sum()) for x in ("c", "v", "once"))
    p0 = np.zeros(CLASSES + 1)
    p0[by_class["class"].to_numpy(int)] = (by_class.c + by_class.v).to_numpy() / (n + v + 1)
    p0[-1] = 1 / (n + v + 1)
    unseen = min(max(once / max(n, 1), p0[-1]), 0.5)  # Good-Turing: the share of words found once
    model = baum_welch(chunks, p0, unseen, states, iterations)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    floor = np.log10(n + 1 * (v + 1))

    empty = pd.DataFrame({c: [] for c in ("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")})

    def task(rows: pd.DataFrame, dictionary: pd.DataFrame) -> pd.DataFrame:
        if not len(rows):
            return empty
        c = np.zeros(1 + max(int(np.frombuffer(x, "<i4").max()) for x in rows.codes))
        c[dictionary.number.to_numpy()] = dictionary.c.to_numpy()
        classes = np.full(len(c), CLASSES)  # unseen words keep the last
        classes[dictionary.number.to_numpy()] = dictionary["class"].to_numpy()
        codes = np.frombuffer(b"".join(rows.codes), "<i4")
        lengths, held = np.concatenate(list(rows.lengths)).astype(np.int64), np.concatenate(list(rows.held)).astype(bool)
        starts = np.cumsum(lengths) - lengths
        base = np.add.reduceat(np.log10(c + 1)[codes], starts) - lengths * floor
        known = np.add.reduceat((c > 0)[codes], starts, dtype=np.int64)
        extra = sent.value.forward(classes[codes], lengths) / np.log(10)
        ids = pd.array([i for own in rows.ids for i in own], "Int64")
        return pd.DataFrame({"doc_id": ids, "held_out": held, "n_tokens": lengths, "n_known": known, "train_tokens": n, "base_score": base, "score": base + extra})

    dictionary = counted.select(F.col("chunk").alias("of_chunk"), "number", "c", "class")
    scored = chunks.select("chunk", "ids", "held", "lengths", "codes").groupBy("chunk").cogroup(dictionary.groupBy("of_chunk"))
    return scored.applyInPandas(task, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op1_hmm_scoring(spark, sf_dir: str) -> DataFrame:
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"))
