"""Mixing sources to target weights with soft domain membership, in DataFrame functions only.

1. A naive Bayes model of the labelled table's domains (clean, low, toxic) is counted on a bounded
   sample of labelled documents (``LABELLED``). It decides twice: toxic or not, then low or clean.
   The features of a decision are all words that mark its domain beyond chance (``GAIN``,
   ``LIFT``); nothing but the sample's own vocabulary bounds their number. The first decision
   also counts by a text's length that such words are absent; the second also has the values
   of ``lang`` and buckets of symbols, capitals and repetition.
2. Every document gets posteriors of its domains in one projection over the scan: the model is a
   hashed table in it, looked up once for each distinct word.
3. Nonnegative document rates x are fitted so that the expected domain tokens
   S_k = sum of tokens * p_k * x meet the targets T_k: weighted least squares
   f = sum of (S_k - T_k)^2 / c_k by projected gradient. A step moves every document's rate by
   -a * sum of p_k * (S_k - T_k) / c_k (the gradient in the metric that weighs a document by its
   tokens) and projects it to x >= 0; Spark then sums K + 1 numbers. The step length a is that of
   Barzilai and Borwein, cut while f exceeds its last four values, down to the length that is safe
   whatever the memberships. c_k is the Gram matrix's diagonal. A rate is a fold over the
   K-vectors of the steps; every ``HELD`` steps the rates so far are written, so that no pass
   folds more.

``targets_met`` says whether all domain tokens came within ``MET`` of their targets; targets that
no nonnegative rates reach give the nearest rates found, and a warning.

Edge cases: null or empty texts have no tokens, no keywords and weigh nothing; a null label is no
label, of several labels of a document the lowest quality and the highest toxicity count; repeated
rows weigh each; without labels all posteriors are the same and rates are equal; a target domain
that no document belongs to is left out; an empty table gives no rows. Input columns named like
the outputs are replaced; other columns of any name are carried through.
"""

from __future__ import annotations

import json
import math
import warnings
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, let, materialize

DOMAINS = ("clean", "low", "toxic")
TARGETS = {"clean": 0.95, "low": 0.02, "toxic": 0.03}
LABELLED = 4000  # labelled documents that the classifier is counted on
MIN_DOCS = 5  # documents of the sample that hold a feature
GAIN = 12.0  # log-likelihood ratio of a word's documents in a domain that it marks, at least
LIFT = 3.0  # a word that marks a domain is that much more frequent in it than in the sample
STEPS = 60
HELD = 8  # steps that a pass folds at most
TOLERANCE = 1e-3  # of a target, at which steps end
MET = 0.01  # of a target, within which it counts as met
OUTPUTS = ("n_tokens", "posterior", "rate", "targets_met")
#: Columns of ``_staged``, under names that no input has.
WORDS, MARKS = "__mixing_words", "__mixing_marks"


def _words(text: Column) -> Column:
    trimmed = F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), f"^{SPACE}+|{SPACE}+$", "")
    return let(trimmed, lambda t: F.when(F.length(t) == 0, F.array().cast("array<string>")).otherwise(F.split(F.lower(t), f"{SPACE}+")))


def _bucket(name: str, top: Column, bottom: Column, bounds: tuple[float, ...]) -> Column:
    out = F.lit(f"{name}:0")
    for i, b in enumerate(bounds, 1):
        out = F.when(top > bottom * F.lit(b), F.lit(f"{name}:{i}")).otherwise(out)
    return out


def _staged(docs: DataFrame, text_col: str) -> DataFrame:
    """``docs`` with n_tokens, the distinct words and the marks, which are the other features."""
    body = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    lang = F.coalesce(F.col("lang").cast("string"), F.lit("")) if "lang" in docs.columns else F.lit("")
    staged = docs.drop(*OUTPUTS).withColumn(WORDS, _words(F.col(text_col)))
    staged = staged.withColumn("n_tokens", F.size(WORDS).cast("long")).withColumn(WORDS, F.array_distinct(WORDS))
    marks = F.array(
        _bucket("symbols", F.regexp_count(body, F.lit("[#*$%&|<>!]")), F.col("n_tokens"), (0.02, 0.1, 0.5)),
        _bucket("capitals", F.regexp_count(body, F.lit(r"\p{Lu}")), F.length(body), (0.1, 0.3)),
        _bucket("repeats", F.col("n_tokens") - F.size(WORDS), F.col("n_tokens"), (0.3, 0.6, 0.9)),
        F.concat(F.lit("lang:"), lang),
    )
    return staged.withColumn(MARKS, marks)


def _word_key(word: Column) -> Column:
    return F.xxhash64(word, F.lit(0))


def _mark_key(mark: Column) -> Column:
    return F.xxhash64(mark, F.lit(1))


@dataclass
class Classifier:
    """Log odds of toxic against the rest, and of low against clean, by feature key; without labels all domains are alike."""

    domains: tuple[str, ...]
    bias: tuple[float, float] | None = None
    weights: dict[int, list[float]] | None = None
    absent: float = 0.0  # log odds of toxic for each distinct word of a text

    def posterior(self) -> Column:
        """Of a row of ``_staged``."""
        if self.bias is None:
            return F.array(*(F.lit(1.0 / len(self.domains)) for _ in self.domains))
        start = F.array(F.lit(self.bias[0]) + F.size(WORDS) * F.lit(self.absent), F.lit(self.bias[1]))
        if self.weights:
            slots = 1 << (4 * len(self.weights)).bit_length()
            table: list[list[dict]] = [[] for _ in range(slots)]
            for key, own in self.weights.items():
                table[key % slots].append({"k": key, "w": own})
            held = F.from_json(F.lit(json.dumps(table)), "array<array<struct<k:bigint,w:array<double>>>>")  # folded to a literal

            def found(key: Column) -> Column:
                return let(key, lambda k: F.filter(F.get(held, F.pmod(k, F.lit(slots)).cast("int")), lambda e: e["k"] == k))

            # nearly all words end at one look into a bitmap
            wide = 1 << (64 * len(self.weights)).bit_length()
            bits = [0] * (wide // 32)
            for key in self.weights:
                bits[key % wide // 32] |= 1 << key % 32
            bitmap = F.from_json(F.lit(json.dumps(bits)), "array<bigint>")

            def maybe(key: Column) -> Column:
                return F.getbit(F.get(bitmap, F.shiftright(key, 5).bitwiseAND(wide // 32 - 1).cast("int")), key.bitwiseAND(31).cast("int")) == 1

            words = F.filter(WORDS, lambda w: maybe(_word_key(w)))
            own = F.flatten(F.concat(F.transform(words, lambda w: found(_word_key(w))), F.transform(MARKS, lambda m: found(_mark_key(m)))))
            start = F.aggregate(own, start, lambda a, e: F.zip_with(a, e["w"], lambda x, y: x + y))

        def spread(odds: Column) -> Column:
            toxic, low = (1 / (1 + F.exp(-F.get(odds, F.lit(i)))) for i in (0, 1))
            return F.array((1 - toxic) * (1 - low), (1 - toxic) * low, toxic)

        return let(start, spread)


def domain_of(quality: Column, toxic: Column) -> Column:
    return F.when(toxic == 1, "toxic").when(quality == 0, "low").otherwise("clean")


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", labelled: int = LABELLED) -> Classifier:
    known = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("q"), F.max("toxic").alias("t"))
    known = known.select(F.col("doc_id").alias("__mixing_id"), domain_of(F.col("q"), F.coalesce("t", F.lit(0))).alias("__mixing_domain"))
    # at most ``labelled`` rows
    sample = known.withColumn("m", F.crc32(F.col("__mixing_id").cast("string").cast("binary"))).orderBy("m", "__mixing_id").limit(labelled).drop("m")
    read = _staged(docs.join(F.broadcast(sample), F.col(id_col) == F.col("__mixing_id")), text_col).select(F.col("__mixing_domain").alias("domain"), WORDS, MARKS)
    read = materialize(read, "mixing-sample")
    sizes = {r.domain: r.n for r in read.groupBy("domain").agg(F.count("*").alias("n")).collect()}
    total = sum(sizes.values())
    if not total:
        return Classifier(DOMAINS)
    words = {r.domain: float(r.n) for r in read.groupBy("domain").agg(F.sum(F.size(WORDS)).alias("n")).collect()}
    keyed = F.concat(F.transform(WORDS, lambda w: F.struct(_word_key(w).alias("k"), F.lit(True).alias("word"))), F.transform(MARKS, lambda m: F.struct(_mark_key(m).alias("k"), F.lit(False).alias("word"))))
    features = read.select("domain", F.explode(keyed).alias("f")).select("domain", "f.*")
    table = features.groupBy("k").agg(F.min("word").alias("word"), *(F.count_if(F.col("domain") == d).cast("double").alias(d) for d in DOMAINS))

    def marked(domain: str, rest: tuple[str, ...]) -> Column:
        """Whether a word marks the domain among it and the rest."""
        n, n1 = sum((F.col(d) for d in rest), F.col(domain)), sizes.get(domain, 0)
        lift = F.try_divide(F.col(domain) * float(n1 + sum(sizes.get(d, 0) for d in rest)), n * F.lit(float(max(n1, 1))))
        return F.coalesce(F.col("word") & (n >= MIN_DOCS) & (lift > LIFT) & (F.col(domain) * F.log(lift) > GAIN), F.lit(False))

    table = table.withColumns({"is_toxic": marked("toxic", ("clean", "low")), "is_low": marked("low", ("clean",))})
    rows = table.where(F.col("is_toxic") | F.col("is_low") | (~F.col("word") & (F.col("low") + F.col("clean") >= MIN_DOCS))).orderBy("k").collect()  # bounded by the sample's words
    n = {d: sizes.get(d, 0) for d in DOMAINS}
    d1, d0 = words.get("toxic", 0.0) + 1, words.get("clean", 0.0) + words.get("low", 0.0) + 1
    weights, absent = {}, 0.0
    for r in rows:
        own = [0.0, 0.0]
        if r.is_toxic:  # a share of distinct words
            a1, a0 = (r.toxic + 0.5) / d1, (r.clean + r.low + 0.5) / d0
            own[0], absent = math.log(a1 / a0), absent - (a1 - a0)
        if r.is_low or not r.word:  # a share of documents
            own[1] = math.log((r.low + 0.5) / (n["low"] + 1)) - math.log((r.clean + 0.5) / (n["clean"] + 1))
        weights[r.k] = own
    bias = math.log((n["toxic"] + 1) / (n["clean"] + n["low"] + 1)), math.log((n["low"] + 1) / (n["clean"] + 1))
    return Classifier(DOMAINS, bias, weights, absent)


def memberships(docs: DataFrame, model: Classifier, text_col: str = "text") -> DataFrame:
    """``docs`` with n_tokens and posterior, an array in the order of the model's domains."""
    return _staged(docs, text_col).withColumn("posterior", model.posterior()).drop(WORDS, MARKS)


def rate(steps: list[list[float]], start: Column | None = None) -> Column:
    """A document's rate after these steps: 1, moved by each and projected to 0 and above."""
    x = F.lit(1.0) if start is None else start
    if not steps:
        return x
    moves = F.from_json(F.lit(json.dumps(steps)), "array<array<double>>")  # folded to a literal
    inner = lambda g: sum((F.get("posterior", F.lit(k)) * F.get(g, F.lit(k)) for k in range(len(steps[0]))), F.lit(0.0))
    return F.aggregate(moves, x, lambda x, g: F.greatest(F.lit(0.0), x - inner(g)))


@dataclass
class Fit:
    """The steps, and the domain tokens they lead to."""

    steps: list[list[float]]
    sums: list[float]
    targets: list[float]
    met: bool


def fit_rates(members: DataFrame, weights: list[float], steps: int = STEPS, tolerance: float = TOLERANCE, total: float | None = None) -> Fit:
    """Rates that meet ``weights`` of ``total`` tokens (all tokens by default), by projected gradient.

    members: n_tokens and posterior.
    """
    n = len(weights)
    p, tokens = [F.get("posterior", F.lit(k)) for k in range(n)], F.col("n_tokens")
    row = members.agg(*(F.sum(tokens * q) for q in p), *(F.sum(tokens * q * r) for q in p for r in p)).first()
    row = np.array([float(v or 0.0) for v in row])
    sums, gram = row[:n], row[n:].reshape(n, n)
    total = float(sums.sum()) if total is None else total
    used = sums > 0
    if not used.any() or not total:
        return Fit([], sums.tolist(), sums.tolist(), True)
    target = np.where(used, weights, 0.0)
    target *= total / max(target.sum(), 1e-300)
    scale = np.where(used, np.maximum(np.diag(gram), 1e-300), 1.0)
    safe = 1 / float(np.linalg.eigvalsh(gram / np.sqrt(np.outer(scale, scale)))[-1])
    loss = lambda s: float(((s - target) ** 2 / scale)[used].sum())
    off = lambda s: float(np.max(np.where(used, np.abs(s - target) / np.maximum(target, 1e-9 * total), 0.0)))
    held, since = members.select("n_tokens", "posterior", F.lit(1.0).alias("x")), []
    taken: list[list[float]] = []
    best, best_sums, length, losses = taken, sums, 1.0, [loss(sums)]

    def ahead(move: list[float]) -> tuple[np.ndarray, float]:
        """Domain tokens after one more step, and the step's length in the metric."""
        moved = held.withColumn("x", rate(since, F.col("x"))).withColumn("next", rate([move], F.col("x")))
        row = moved.agg(*(F.sum(tokens * F.col("next") * q) for q in p), F.sum(tokens * (F.col("next") - F.col("x")) ** 2)).first()
        out = [float(v or 0.0) for v in row]
        return np.array(out[:n]), out[n]

    while len(taken) < steps and off(best_sums) >= tolerance:
        slope = np.where(used, (sums - target) / scale, 0.0)
        while True:
            move = (length * slope).tolist()
            sums_ahead, moved = ahead(move)
            if loss(sums_ahead) <= max(losses[-4:]) or length <= safe:
                break
            length = max(length / 4, safe)
        change = float(((sums_ahead - sums) ** 2 / scale)[used].sum())
        taken, since, sums = [*taken, move], [*since, move], sums_ahead
        losses.append(loss(sums))
        if losses[-1] < loss(best_sums):
            best, best_sums = taken, sums
        if change <= 0:
            break  # no rate moves any more
        length = max(moved / change, safe)
        if len(since) == HELD:
            held, since = materialize(held.withColumn("x", rate(since, F.col("x"))), "mixing-rates"), []
    met = off(best_sums) < MET
    if not met:
        warnings.warn(f"mixing targets are not met: tokens {best_sums.round(1).tolist()} for {target.round(1).tolist()}", stacklevel=2)
    return Fit(best, best_sums.tolist(), target.tolist(), met)


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, text_col: str = "text", columns: tuple[str, ...] | None = None, **options) -> DataFrame:
    """``docs`` with n_tokens, posterior, rate and targets_met; of its columns only ``columns``, if given.

    Memberships are written once, with these columns: fitting and the result both read them.
    """
    model = train(docs, labels, text_col=text_col)
    members = memberships(docs, model, text_col)
    if columns is not None:
        members = members.select(*columns, "n_tokens", "posterior")
    members = materialize(members, "mixing-members")
    targets = targets or TARGETS
    fit = fit_rates(members.select("n_tokens", "posterior"), [targets.get(d, 0.0) for d in model.domains], **options)
    return members.withColumns({"rate": rate(fit.steps), "targets_met": F.lit(fit.met)})


def copies(id_col: str = "doc_id") -> Column:
    """Whole copies of a row with a rate: its whole part, and one more with the rest's probability, by the id's checksum."""
    chance = F.coalesce(F.pmod(F.xxhash64(F.col(id_col)), F.lit(1 << 20)).cast("double"), F.lit(0.0)) / (1 << 20)
    return F.floor(F.col("rate") + chance).cast("int")


def op7_soft_mixing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    mixed = mix(docs, labels, columns=("doc_id",)).withColumn("copies", copies())
    posteriors = [F.get("posterior", F.lit(k)).alias(f"p_{d}") for k, d in enumerate(DOMAINS)]
    return mixed.select("doc_id", "n_tokens", *posteriors, "rate", "copies", "targets_met")
