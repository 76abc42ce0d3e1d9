"""Quality classifier by co-training on two views of a document.

The content view sees the words: hashed lower-case words, word shapes (letter case, digits and
signs, runs collapsed) and how often a word repeats the one before, each as a share of the words.
The page view sees the page's own columns and layout: language, source, length, lines and line
length. Both are logistic models.

1. One scan writes every document's features. A bounded sample of labelled documents
   (``LABELLED``, by checksum of the id) goes to the driver; two thirds of it fit the first models,
   a third calibrates (Platt scaling).
2. In each round a view's calibrated model labels all other documents that it is sure of
   (``CONFIDENT``) for the other view; no number of them is fixed. ``PASSES`` gradient steps on
   labelled and taught documents follow: tasks sum the gradients of what they hold by class, Spark
   adds them up by slot, and both kinds of documents and both classes weigh alike.
3. The combined score adds the two calibrated log odds and takes the prior's off once. All
   documents are scored, in one scan, by two bounded weight tables.

Edge cases: null or empty texts score by the page view and the content view's intercept; null
columns are a value of their own; a label that is null is no label, and a document with several
labels has the lowest; repeated rows score alike, teach as often as they occur, and are one
labelled document; without labels, or with labels of one class only, every document is kept with
that class's prior; an empty table gives no rows. Input columns named like the outputs are
replaced; others of any name are carried through.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .common import chunked, give_back, lean, materialize, slices, text_bytes, whole

LABELLED = 3000  # labelled documents that models are fitted to and calibrated on
ROUNDS = 3
PASSES = 3  # gradient steps of a round
CONFIDENT = 0.95
TAUGHT = 0.5  # share of taught documents in a step; labelled ones have the rest
KEEP = 0.5
ROWS = 1024  # documents whose vectors a task holds at a time
SLICE = 1 << 20  # bytes of text whose words a task holds at a time
WORD_SLOTS, SHAPE_SLOTS, PAGE_SLOTS = 1 << 14, 1 << 10, 1 << 10
_SHAPES = [(re.compile(p), r) for p, r in ((r"[A-ZÀ-ÖØ-Þ]+", "A"), (r"[a-zß-öø-ÿ]+", "a"), (r"[0-9]+", "0"), (r"([^Aa0])\1*", r"\1"))]
OUTPUTS = ("p_content", "p_page", "p_quality")


def _shape(word: str) -> str:
    for pattern, to in _SHAPES:
        word = pattern.sub(to, word)
    return word


class ContentFeatures:
    """Shares of a text's words: hashed words, shapes, and repeats (the last slot).

    Keeps the slots of words it has met, ``KNOWN`` at most.
    """

    SLOTS = WORD_SLOTS + SHAPE_SLOTS + 1
    KNOWN = 300_000

    def __init__(self):
        self.known, self.slots = pa.array([], pa.string()), np.zeros((0, 2), np.int32)

    def _slots_of(self, words: pa.Array) -> np.ndarray:
        """[word, 2]: the slots of distinct words and of their shapes."""
        if len(self.known) > self.KNOWN:
            self.__init__()
        place = pc.index_in(words, value_set=self.known).fill_null(-1).to_numpy().astype(np.int64)
        new = np.flatnonzero(place < 0)
        if len(new):
            fresh = words.take(pa.array(new))
            made = [(zlib.crc32(low.encode()) % WORD_SLOTS, WORD_SLOTS + zlib.crc32(_shape(w).encode()) % SHAPE_SLOTS) for w, low in zip(fresh.to_pylist(), pc.ascii_lower(fresh).to_pylist())]
            place[new] = len(self.known) + np.arange(len(new))
            self.known, self.slots = pa.concat_arrays([self.known, fresh]), np.concatenate([self.slots, np.array(made, np.int32)])
        return self.slots[place]

    def words(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Words of each text; each word's two slots, text by text; and how many words of a text repeat the one before."""
        split = pc.ascii_split_whitespace(texts.cast(pa.string()))
        each = split.flatten().dictionary_encode()
        code = each.indices.to_numpy().astype(np.int64)
        # white space at a text's ends gives an empty word
        filled = pc.not_equal(each.dictionary, "").to_numpy(zero_copy_only=False)[code]
        text = np.repeat(np.arange(len(texts)), split.value_lengths().to_numpy(zero_copy_only=False))[filled]
        code = code[filled]
        again = (code[1:] == code[:-1]) & (text[1:] == text[:-1])
        count = lambda x: np.bincount(x, minlength=len(texts))
        return count(text), self._slots_of(each.dictionary)[code], count(text[1:][again])

    def rows(self, texts: pa.Array) -> list[tuple[bytes, bytes, int]]:
        """(slots as uint16, counts as uint32, words) of each text."""
        n, pairs, repeats = self.words(texts)
        text = np.repeat(np.arange(len(n)), n)
        key = np.sort((text[:, None] * self.SLOTS + pairs).reshape(-1))
        some = np.flatnonzero(repeats)
        first = np.flatnonzero(np.diff(key, prepend=-1))
        counts = np.diff(np.append(first, len(key)))
        key, counts = np.concatenate([key[first], some * self.SLOTS + self.SLOTS - 1]), np.concatenate([counts, repeats[some]])
        order = np.argsort(key, kind="stable")
        owner, slot = np.divmod(key[order], self.SLOTS)
        ends = np.searchsorted(owner, np.arange(len(n)), side="right")
        slots, sizes = slot.astype("<u2").tobytes(), counts[order].astype("<u4").tobytes()
        return [(slots[2 * a : 2 * b], sizes[4 * a : 4 * b], int(k)) for a, b, k in zip(np.append(0, ends[:-1]), ends, n)]

    def scores(self, texts: pa.Array, weights: np.ndarray) -> np.ndarray:
        """The products of the texts' vectors with the weights, without building the vectors."""
        n, pairs, repeats = self.words(texts)
        total = np.bincount(np.repeat(np.arange(len(n)), n), weights[pairs].sum(1), len(n)) + weights[-1] * repeats
        return total / np.maximum(n, 1)


def page_slots(lang, source, n_chars, text: bytes) -> list[int]:
    """Hashed language, source, and buckets of length, lines and line length."""
    lines = text.count(b"\n") + 1
    size = len(text) if n_chars is None else max(int(n_chars), 0)
    names = (f"l:{lang}", f"s:{source}", f"n:{int(np.log2(size + 1))}", f"k:{int(np.log2(lines))}", f"w:{int(np.log2(size / lines + 1))}")
    return [zlib.crc32(x.encode()) % PAGE_SLOTS for x in names]


@dataclass
class Sparse:
    """Rows of (slots, values)."""

    row: np.ndarray
    slot: np.ndarray
    value: np.ndarray
    n: int

    @classmethod
    def content(cls, slots: list[bytes], counts: list[bytes], words: np.ndarray) -> Sparse:
        row = np.repeat(np.arange(len(slots)), [len(x) // 2 for x in slots])
        return cls(row, np.frombuffer(b"".join(slots), "<u2").astype(np.int32), np.frombuffer(b"".join(counts), "<u4") / np.maximum(words, 1)[row], len(slots))

    @classmethod
    def page(cls, slots: list[bytes]) -> Sparse:
        row = np.repeat(np.arange(len(slots)), [len(x) // 2 for x in slots])
        return cls(row, np.frombuffer(b"".join(slots), "<u2").astype(np.int32), np.ones(len(row)), len(slots))

    def take(self, rows: np.ndarray) -> Sparse:
        place = np.full(self.n, -1)
        place[rows] = np.arange(len(rows))
        own = place[self.row] >= 0
        return Sparse(place[self.row[own]], self.slot[own], self.value[own], len(rows))

    def times(self, weights: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.value * weights[self.slot], self.n)


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Logistic:
    """A logistic model that AdaGrad steps move."""

    w: np.ndarray
    seen: np.ndarray
    b: float = 0.0
    seen_b: float = 1e-8

    @classmethod
    def zero(cls, slots: int) -> Logistic:
        return cls(np.zeros(slots), np.full(slots, 1e-8))

    def score(self, x: Sparse) -> np.ndarray:
        return x.times(self.w) + self.b

    def gradient(self, x: Sparse, y: np.ndarray) -> tuple[np.ndarray, float]:
        """Of the mean loss, both classes weighted alike."""
        weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
        off = weight * (_sigmoid(self.score(x)) - y)
        return np.bincount(x.slot, x.value * off[x.row], len(self.w)), float(off.sum())

    def step(self, g: np.ndarray, gb: float, ridge: float = 1e-4) -> None:
        g = g + ridge * self.w
        self.seen, self.seen_b = self.seen + g * g, self.seen_b + gb**2
        self.w, self.b = self.w - g / np.sqrt(self.seen), self.b - 0.3 * gb / np.sqrt(self.seen_b)


def fit(x: Sparse, y: np.ndarray, slots: int, steps: int = 80) -> Logistic:
    model = Logistic.zero(slots)
    for _ in range(steps):
        model.step(*model.gradient(x, y))
    return model


def platt(score: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and intercept that make the scores log odds; the slope never turns the order round."""
    scale = max(float(np.abs(score).mean()), 1e-9)
    s, a, b = score / scale, 1.0, 0.0
    n1, n0 = (y == 1).sum(), (y == 0).sum()
    t = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    for _ in range(400):
        off = _sigmoid(a * s + b) - t
        a, b = max(a - 0.5 * float((off * s).mean()), 0.0), b - 0.5 * float(off.mean())
    return a / scale, b


@dataclass
class CoModel:
    """Weights of both views, with calibration folded in; the prior's log odds."""

    content: np.ndarray
    content_bias: float
    page: np.ndarray
    page_bias: float
    prior: float

    def outputs(self, content: np.ndarray, page: np.ndarray) -> list[pa.Array]:
        return [pa.array(_sigmoid(x)) for x in (content, page, content + page - self.prior)]


def _sampled(docs: DataFrame, labels: DataFrame, id_col: str, labelled: int) -> DataFrame:
    """doc_id and y of the sample: at most ``labelled`` rows."""
    known = labels.select("doc_id", F.col("quality").cast("int").alias("quality")).where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("y"))
    ids = docs.select(F.col(id_col).alias("doc_id")).where("doc_id is not null").distinct()
    mark = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    return ids.join(known, "doc_id").withColumn("mark", mark).orderBy("mark", "doc_id").limit(labelled).select("doc_id", "y")


FEATURES = {"_cs": "binary", "_cc": "binary", "_cn": "long", "_ps": "binary"}


def featured(docs: DataFrame, sample: DataFrame, id_col: str = "doc_id", text_col: str = "text", columns: tuple[str, ...] = ()) -> DataFrame:
    """Written once: _id, _y (null beside the sample), ``FEATURES``, and some columns of ``docs``.

    A text goes to Python once, in parts; the columns go along with the first of them.
    """
    sample = sample.select(F.col("doc_id").alias("_sample_id"), F.col("y").alias("_y"))
    text_at = columns.index(text_col) if text_col in columns and isinstance(docs.schema[text_col].dataType, StringType) else None
    keep = [F.col(f"`{c}`").alias(f"_own_{i}") for i, c in enumerate(columns)]
    read = docs.select(F.col(id_col).alias("_id"), *keep, *_page_columns(docs), text_bytes(text_col).alias("_text"))
    read = read.join(F.broadcast(sample), F.col("_id") == F.col("_sample_id"), "left").drop("_sample_id")
    plain = [c for c in read.columns if c not in ("lang", "source", "n_chars", "_text")]
    copied = None if text_at is None else f"_own_{text_at}"
    read = read.withColumn("_absent", F.col(copied).isNull() if copied else F.lit(False))
    names = [c for c in read.columns if c not in ("_text", copied)]
    parts = read.select(F.struct(*names).alias("row"), chunked(F.col("_text")).alias("parts"))
    parts = parts.select("row", F.posexplode("parts").alias("number", "part")).select(F.when(F.col("number") == 0, F.col("row")).alias("row"), "number", "part")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = ContentFeatures()
        for held, all_texts in whole(batches):
            for at, to in slices(all_texts, SLICE):
                own, texts = dict(zip(names, held.slice(at, to - at).flatten())), all_texts.slice(at, to - at)
                if copied:
                    own[copied] = texts.cast(pa.string()).take(pa.array(np.arange(len(texts)), mask=own["_absent"].to_numpy(zero_copy_only=False)))
                rows = features.rows(texts)
                pages = [np.array(page_slots(*x), "<u2").tobytes() for x in zip(*(own[c].to_pylist() for c in ("lang", "source", "n_chars")), texts.to_pylist())]
                made = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.binary(), pa.binary(), pa.int64()))]
                yield pa.RecordBatch.from_arrays([*(own[c] for c in plain), *made, pa.array(pages, pa.binary())], [*plain, *FEATURES])
            held = all_texts = own = texts = rows = pages = made = None  # not held while the next batch comes

    schema = StructType([read.schema[c] for c in plain])
    for name, kind in FEATURES.items():
        schema = schema.add(name, kind)
    return materialize(parts.mapInArrow(lean(task), schema), "cotrain-features")


def _views(cs, cc, cn, ps) -> list[Sparse]:
    return [Sparse.content(cs, cc, np.asarray(cn, np.int64)), Sparse.page(ps)]


@dataclass
class Teacher:
    """Both views' models, and the calibration that they teach by."""

    models: list[Logistic]
    teaching: list[Logistic]
    platts: list[tuple[float, float]]

    def taught(self, views: list[Sparse], free: np.ndarray) -> list[list[np.ndarray]]:
        """[view][class]: the rows of ``free`` ones that the other view is sure of."""
        out: list[list[np.ndarray]] = [[], []]
        for view, x in enumerate(views):
            slope, shift = self.platts[view]
            p = _sigmoid(slope * self.teaching[view].score(x) + shift)
            out[1 - view] = [np.flatnonzero(free & (1 - p >= CONFIDENT)), np.flatnonzero(free & (p >= CONFIDENT))]
        return out

    def sums(self, views: list[Sparse], free: np.ndarray) -> list[list[np.ndarray]]:
        """[view][class]: summed gradient by slot, then that of the intercept, then the number of documents."""
        out = []
        for x, model, rows in zip(views, self.models, self.taught(views, free)):
            own = []
            for y, held in enumerate(rows):
                part = x.take(held)
                off = _sigmoid(model.score(part)) - y
                own.append(np.concatenate([np.bincount(part.slot, part.value * off[part.row], len(model.w)), [off.sum(), len(held)]]))
            out.append(own)
        return out


def _taught_sums(features: DataFrame, teacher: Teacher) -> list[list[np.ndarray]]:
    """``Teacher.sums`` over all documents beside the sample: tasks sum, Spark adds up by slot."""
    sent = features.sparkSession.sparkContext.broadcast(teacher)  # a few tables of fixed size
    sizes = [len(m.w) + 2 for m in teacher.models]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, total = sent.value, None
        for part in (batch.slice(at, ROWS) for batch in batches for at in range(0, batch.num_rows, ROWS)):
            made = own.sums(_views(*(part.column(i).to_pylist() for i in range(1, 5))), np.array(part.column(0).is_null()))
            total = made if total is None else [[a + b for a, b in zip(x, y)] for x, y in zip(total, made)]
        for view, classes in enumerate(total or []):
            for y, sums in enumerate(classes):
                some = np.flatnonzero(sums)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), 2 * view + y, np.int32)), pa.array(some.astype(np.int32)), pa.array(sums[some])], ["part", "slot", "g"])

    parts = features.select("_y", *FEATURES).mapInArrow(lean(task), "part int, slot int, g double")
    # at most twice the slots of both views
    got = parts.groupBy("part", "slot").agg(F.sum("g").alias("g")).toPandas()
    sent.unpersist()
    out = [[np.zeros(n), np.zeros(n)] for n in sizes]
    for part in range(4):
        own = got[got.part == part]
        out[part // 2][part % 2][own.slot.to_numpy()] = own.g.to_numpy()
    return out


def train(features: DataFrame, rounds: int = ROUNDS, passes: int = PASSES) -> CoModel | float:
    """The model, or the log odds of the only class there is. ``features``: see ``featured``."""
    # one row for each labelled document of the sample
    got = features.where("_y is not null").dropDuplicates(["_id"]).select("_id", "_y", *FEATURES).toPandas().sort_values("_id")
    y = got._y.to_numpy(float)
    good = int((y == 1).sum())
    prior = float(np.log((good + 1) / (len(y) - good + 1)))
    if good in (0, len(y)):
        return prior
    views = _views(*(got[c].tolist() for c in FEATURES))
    # a third of each class calibrates
    held = np.concatenate([np.flatnonzero(y == 0), np.flatnonzero(y == 1)])[::3]
    own = np.setdiff1d(np.arange(len(y)), held)
    if len(np.unique(y[own])) < 2 or len(np.unique(y[held])) < 2:
        own = held = np.arange(len(y))
    fitted = [x.take(own) for x in views]
    models = [fit(x, y[own], slots) for x, slots in zip(fitted, (ContentFeatures.SLOTS, PAGE_SLOTS))]
    calibrated = lambda: [platt(m.score(x)[held], y[held]) for m, x in zip(models, views)]
    for _ in range(rounds):
        platts, teaching = calibrated(), [Logistic(m.w.copy(), m.seen, m.b) for m in models]
        for _ in range(passes):
            for model, x, (low, high) in zip(models, fitted, _taught_sums(features, Teacher(models, teaching, platts))):
                g, gb = model.gradient(x, y[own])
                if low[-1] and high[-1]:  # a view that is taught one class only learns nothing from it
                    t = 0.5 * low[:-1] / low[-1] + 0.5 * high[:-1] / high[-1]
                    g, gb = (1 - TAUGHT) * g + TAUGHT * t[:-1], (1 - TAUGHT) * gb + TAUGHT * float(t[-1])
                model.step(g, gb)
    parts = []
    for m, (slope, shift) in zip(models, calibrated()):
        parts += [m.w * slope, m.b * slope + shift]
    return CoModel(*parts, prior)


def _page_columns(docs: DataFrame):
    kinds = {"lang": "string", "source": "string", "n_chars": "long"}
    return [(F.col(c) if c in docs.columns else F.lit(None)).cast(t).alias(c) for c, t in kinds.items()]


def score(docs: DataFrame, model: CoModel | float, text_col: str = "text") -> DataFrame:
    """``docs`` with p_content, p_page and p_quality."""
    docs = docs.drop(*OUTPUTS)
    if isinstance(model, float):
        return docs.withColumns({c: F.lit(float(_sigmoid(model))) for c in OUTPUTS})
    sent = docs.sparkSession.sparkContext.broadcast(model)  # two fixed-size tables
    names = docs.columns

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, own = ContentFeatures(), sent.value
        for batch in batches:
            for at, to in slices(batch.column(len(names) + 3)):
                part = batch.slice(at, to - at)
                content = features.scores(part.column(len(names) + 3), own.content) + own.content_bias
                page = np.array([own.page[page_slots(*x)].sum() for x in zip(*(part.column(len(names) + i).to_pylist() for i in range(4)))]) + own.page_bias
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(names))), *own.outputs(content, page)], [*names, *OUTPUTS])

    read = docs.select(*(F.col(f"`{c}`") for c in names), *(c.alias(f"_page_{i}") for i, c in enumerate(_page_columns(docs))), text_bytes(text_col).alias("_text"))
    return read.mapInArrow(lean(task), StructType([*docs.schema.fields, *(StructField(c, DoubleType()) for c in OUTPUTS)]))


def score_features(features: DataFrame, model: CoModel | float, columns: tuple[str, ...]) -> DataFrame:
    """``columns``, which ``featured`` carried along, with the outputs; those named like one are replaced."""
    own_columns = [F.col(f"_own_{i}").alias(c) for i, c in enumerate(columns) if c not in OUTPUTS]
    if isinstance(model, float):
        return features.select(*own_columns).withColumns({c: F.lit(float(_sigmoid(model))) for c in OUTPUTS})
    sent = features.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf(", ".join(f"{c} double" for c in OUTPUTS))
    def scored(vectors: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        own = sent.value
        try:
            for columns in vectors:
                for at in range(0, len(columns[0]), ROWS):
                    x, page = _views(*(c.slice(at, ROWS).to_pylist() for c in columns))
                    yield pa.StructArray.from_arrays(own.outputs(x.times(own.content) + own.content_bias, page.times(own.page) + own.page_bias), OUTPUTS)
        finally:
            give_back()

    # only the vectors go to Python: the columns wait in Spark
    held = features.select(*(f"_own_{i}" for i in range(len(columns))), scored(*FEATURES).alias("_scores"))
    return held.select(*own_columns, "_scores.*")


def classify(docs: DataFrame, labels: DataFrame, keep: float = KEEP, text_col: str = "text", columns: tuple[str, ...] | None = None, labelled: int = LABELLED) -> DataFrame:
    """``docs`` with both views' probabilities, the combined one, and kept; of its columns only ``columns``, if given, which saves reading the texts twice."""
    features = featured(docs, _sampled(docs, labels, "doc_id", labelled), "doc_id", text_col, columns or ())
    model = train(features)
    scored = score(docs, model, text_col) if columns is None else score_features(features, model, columns)
    return scored.withColumn("kept", F.col("p_quality") >= keep)


def op6_co_training(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return classify(docs, labels, columns=("doc_id",)).select("doc_id", *OUTPUTS, "kept")
