"""Secret scans: fixed patterns, and character Markov models told apart by log-likelihood ratio.

Two first-order models over printable ASCII are trained from labelled samples: strings that the
fixed patterns mark as secrets (random) and the other tokens of the corpus (ordinary). Training
is one scan. A token of ``LEAST`` characters or more outside the pattern spans (of one that touches
a span, what is left of it) is a secret of kind ``markov`` when the ratio of its likelihoods under the two models, in natural log, exceeds ``MARGIN`` plus what the prior odds ask
for. The token itself is left out of the ordinary counts it is scored by.

The models are counted twice, and the larger ratio holds: over all occurrences, of which one is
left out, and over distinct strings, where a string counts once however often its text is copied,
so that a copied secret is left out whole and vouches for nothing. Tasks emit 95 x 95 tables of the
former and their distinct strings for the latter; Spark removes repeats and sums.

The random model starts from ``UNIFORM`` pseudo-counts for each pair, so it exists without any
sample; then it is that of uniform random strings.

Edge cases: a null or empty text has no spans; repeated rows are scanned alike and each counts as
a sample; a null id is carried along; an empty table gives no rows and uniform models. Offsets
are code points, ends exclusive.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_bytes

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # a whole run, for it is greedy
LEAST = 16  # characters of a scored token; shorter ones hold too little to outweigh the prior odds
CANDIDATE = re.compile(rf"[A-Za-z0-9+/_.=-]{{{LEAST},}}")
#: What secrets and identifiers are made of.
TOKEN = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-"
KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
#: Byte tables: token bytes stay or become x, all others become line ends.
_STAY = bytes(c if c in TOKEN else 10 for c in range(256))
_LONG = bytes(120 if c in TOKEN else 10 for c in range(256))
SYMBOLS = 95  # from space to ~
UNIFORM = 50.0
MARGIN = 10.0
PRIOR_LOG_ODDS = float(np.log(1e4))  # ordinary tokens of that length for one secret


def _base(raw: bytes, text: str) -> list[tuple[int, int, int, str]]:
    """(start, kind, end, value). Keywords and long tokens are looked for before the patterns run."""
    found, low = [], raw.lower()
    if any(k in low for k in KEYWORDS):
        found += [(m.start(), 0, m.end(), m.group(2)) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if has_long_token(raw):
        found += [(m.start(), 1, m.end(), m.group()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
        found += [(m.start(), 2, m.end(), m.group()) for m in HEX.finditer(text)]
    return sorted(found)


def has_long_token(raw: bytes) -> bool:
    """Whether any CANDIDATE is there; access keys and long hex runs lie inside candidates."""
    return b"x" * LEAST in raw.translate(_LONG)


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) by start, then kind as listed: assign, access, hex."""
    return [(s, ("assign", "access", "hex")[k], e) for s, k, e, _ in _base(text.encode(), text)]


def pair_counts(tokens: bytes) -> np.ndarray:
    """[95, 95] counts of neighbouring characters inside the tokens, which line ends separate."""
    raw = np.frombuffer(tokens, np.uint8)
    counts = np.bincount(raw[:-1].astype(np.int32) * 128 + raw[1:], minlength=128 * 128) if len(raw) > 1 else np.zeros(128 * 128, np.int64)
    return counts.reshape(128, 128)[32:127, 32:127]


def _outside(pattern: re.Pattern, text: str, spans: list[tuple[int, str, int]]) -> list[re.Match]:
    """Matches in what the spans leave of the text. Spans are sorted by their start."""
    out, at = [], 0
    for start, _, end in [*spans, (len(text), "", len(text))]:
        if start > at:
            out += pattern.finditer(text, at, start)
        at = max(at, end)
    return out


@dataclass
class MarkovPair:
    """log probabilities of the next character under the random model, and the ordinary model's counts."""

    random: np.ndarray
    ordinary: np.ndarray
    distinct: MarkovPair | None = None  # the same, of counts that hold each string once

    @classmethod
    def of(cls, random: np.ndarray, ordinary: np.ndarray, distinct: MarkovPair | None = None) -> MarkovPair:
        # characters that secrets are made of; others get the share of one pseudo-count
        alphabet = np.zeros(SYMBOLS)
        alphabet[[c - 32 for c in TOKEN]] = 1
        p = random + np.outer(alphabet, alphabet) * UNIFORM + 1e-3
        return cls(np.log(p / p.sum(1, keepdims=True)), ordinary, distinct)

    def score(self, token: str, learned: bool = False) -> float:
        """log of random over ordinary, the larger one of both counts. ``learned``: the token is one of the ordinary samples; it is left out, so it can't vouch for itself."""
        raw = np.frombuffer(token.encode("ascii"), np.uint8).astype(np.int64) - 32
        a, b = raw[:-1], raw[1:]
        n, rows = self.ordinary[a, b], self.totals[a]
        if learned:
            _, place, times = np.unique(a * SYMBOLS + b, return_inverse=True, return_counts=True)
            n, rows = n - times[place], rows - np.bincount(a)[a]
        own = float((self.random[a, b] - np.log((n + 0.5) / (rows + 0.5 * SYMBOLS))).sum())
        return max(own, self.distinct.score(token, learned)) if self.distinct else own

    @cached_property
    def totals(self) -> np.ndarray:
        return self.ordinary.sum(1)


#: Labels of the tables: by occurrence, then by distinct string.
RANDOM, ORDINARY, RANDOM_ONCE, ORDINARY_ONCE = range(4)
HELD = 200_000  # distinct strings that a task holds before it passes them on


def train(docs: DataFrame, text_col: str = "text") -> MarkovPair:
    """Models from all documents; the driver gets four 95 x 95 tables."""
    names = ["label", "pair", "token", "n"]

    def rows_of(label, pair, token, n) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(label, pa.int64()), pa.array(pair, pa.int64()), pa.array(token, pa.binary()), pa.array(n, pa.int64())], names)

    def table_rows(sums: np.ndarray) -> pa.RecordBatch:
        at = np.flatnonzero(sums)
        label, pair = np.divmod(at, SYMBOLS * SYMBOLS)
        return rows_of(label, pair, [None] * len(at), sums.reshape(-1)[at])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, SYMBOLS, SYMBOLS), np.int64)
        held: tuple[set[bytes], set[bytes]] = (set(), set())

        def taken() -> Iterator[pa.RecordBatch]:
            for label, tokens in zip((RANDOM_ONCE, ORDINARY_ONCE), held):
                yield rows_of([label] * len(tokens), [None] * len(tokens), list(tokens), [1] * len(tokens))
                tokens.clear()

        for batch in batches:
            random, ordinary = [], []
            for raw in batch.column(0).to_pylist():
                text = raw.decode()
                at = 0
                first = len(random), len(ordinary)
                for start, _, end, value in _base(raw, text):
                    random.append(value.encode())
                    ordinary.append(text[at:start].encode().translate(_STAY))
                    at = max(at, end)
                ordinary.append((text[at:].encode() if at else raw).translate(_STAY))
                held[0].update(random[first[0] :])
                for part in ordinary[first[1] :]:
                    held[1].update(part.split())
                if len(held[0]) + len(held[1]) > HELD:
                    yield from taken()
            sums[0] += pair_counts(b"\n".join(random))
            sums[1] += pair_counts(b"\n".join(ordinary))
        yield from taken()
        yield table_rows(sums)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Distinct strings become tables; tables pass."""
        sums = np.zeros((4, SYMBOLS, SYMBOLS), np.int64)
        for batch in batches:
            label = batch.column(0).to_numpy()
            for own in (RANDOM_ONCE, ORDINARY_ONCE):
                sums[own] += pair_counts(b"\n".join(batch.column(2).filter(pa.array(label == own)).to_pylist()))
            table = np.flatnonzero(label < RANDOM_ONCE)
            pair, n = (batch.column(i).take(pa.array(table)).to_numpy() for i in (1, 3))
            np.add.at(sums.reshape(4, -1), (label[table], pair), n)
        yield table_rows(sums)

    kind = "label long, pair long, token binary, n long"
    rows = docs.where(F.col(text_col).isNotNull()).select(text_bytes(text_col))
    once = rows.mapInArrow(task, kind).groupBy("label", "pair", "token").agg(F.sum("n").alias("n"))
    counts = once.mapInArrow(spread, kind).groupBy("label", "pair").agg(F.sum("n").alias("n")).toPandas()
    tables = np.zeros((4, SYMBOLS * SYMBOLS))
    tables[counts["label"].to_numpy(int), counts["pair"].to_numpy(int)] = counts["n"].to_numpy()
    random, ordinary, *distinct = tables.reshape(4, SYMBOLS, SYMBOLS)
    return MarkovPair.of(random, ordinary, MarkovPair.of(*distinct))


def scan(docs: DataFrame, models: MarkovPair, id_col: str = "doc_id", text_col: str = "text", margin: float = MARGIN) -> DataFrame:
    """doc_id and spans, an array of (kind, start, end, score), of every row; score is null for base spans."""
    id_type = docs.schema[id_col].dataType.simpleString()
    models = docs.sparkSession.sparkContext.broadcast(models)  # 300 kB
    needed = margin + PRIOR_LOG_ODDS

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
        own = models.value
        for batch in batches:
            out = []
            for raw in batch.column(1).to_pylist():
                text = raw.decode()
                spans = [(s, ("assign", "access", "hex")[k], e) for s, k, e, _ in _base(raw, text)]
                found = [{"kind": k, "start": s, "end": e, "score": None} for s, k, e in spans]
                for m in _outside(CANDIDATE, text, spans) if has_long_token(raw) else ():
                    score = own.score(m.group(), learned=True)
                    if score > needed:
                        found.append({"kind": "markov", "start": m.start(), "end": m.end(), "score": score})
                out.append(sorted(found, key=lambda x: (x["start"], x["kind"] == "markov")))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, kind)], ["doc_id", "spans"])

    rows = docs.select(F.col(id_col).alias("doc_id"), text_bytes(text_col))
    return rows.mapInArrow(task, f"doc_id {id_type}, spans array<struct<kind:string,start:long,end:long,score:double>>")


def digest(scanned: DataFrame) -> DataFrame:
    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def number(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")

    base = F.filter("spans", lambda s: s["kind"] != "markov")
    return scanned.select(
        "doc_id", number("assign").alias("n_assign"), number("access").alias("n_access"), number("hex").alias("n_hex"),
        F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), number("markov").alias("n_markov"),
    )


def op9_secret_scan(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return digest(scan(docs, train(docs)))
