"""Quality rules: a threshold table compiled into one Spark projection.

Each rule bounds one ratio of a text. All counts and ratios are built-in expressions, so the
whole operator is a map over the scan: no shuffle, no user function, no state.

Edge cases: a null or empty text has no words, every count is 0 and it fails the base rule;
repeated rows are judged alike; an empty table gives an empty table; columns of the input that
carry one of the operator's output names are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NOT_SPACE, SPACE, let

WINDOW = 3  # words in a window for n_repeat_words

#: Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "the", "of", "and", "to", "in", "is", "that", "it", "for", "on", "was", "as", "be", "with", "by", "this", "are", "at", "from",
    "der", "die", "und", "den", "das", "von", "ist", "ein", "eine", "zu", "mit", "nicht", "sich", "auf", "dem", "des", "im",
    "de", "la", "le", "et", "les", "un", "une", "que", "en", "du", "pour", "dans", "au", "par", "sur", "avec",
    "el", "los", "las", "y", "del", "por", "para", "con", "se", "su", "al", "es",
)


@dataclass(frozen=True)
class Rule:
    """A text passes if ``low <= ratio <= high``; None leaves that side open."""

    name: str
    ratio: str
    low: float | None = None
    high: float | None = None


#: The threshold table. Ratios are over words, or over lines with a word for line ratios.
RULES = (
    Rule("word_length", "word_chars / n_words", 2.0, 14.0),
    Rule("symbols", "n_symbols / n_words", None, 0.2),
    Rule("stop_words", "n_stop_words / n_words", 0.02, None),
    Rule("duplicate_lines", "n_dup_lines / n_lines", None, 0.5),
)


def _covered(starts: Column) -> Column:
    """Words in the union of windows that begin at the ascending ``starts``."""
    step = F.transform(starts, lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get(starts, i + 1) - p, F.lit(WINDOW))))
    return F.aggregate(step, F.lit(0), lambda a, x: a + x)


def _repeat_words(words: Column) -> Column:
    """Words inside windows that occur twice or more. Texts without such a window skip the sort."""

    def at(i: Column, k: int) -> Column:
        return F.get(words, i + k)

    grams = F.transform(F.sequence(F.lit(0), F.size(words) - WINDOW), lambda i: F.concat_ws(" ", *(at(i, k) for k in range(WINDOW))))

    def counted(gs: Column) -> Column:
        ordered = F.sort_array(F.transform(gs, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))

        def starts(s: Column) -> Column:
            twice = F.transform(
                s, lambda x, i: F.when((F.get(s, i - 1)["g"] == x["g"]) | (F.get(s, i + 1)["g"] == x["g"]), x["i"])
            )
            return F.sort_array(F.filter(twice, lambda p: p.isNotNull()))

        return F.when(F.size(F.array_distinct(gs)) == F.size(gs), F.lit(0)).otherwise(let(let(ordered, starts), _covered))

    return F.when(F.size(words) <= WINDOW, F.lit(0)).otherwise(let(grams, counted))


def text_counts(docs: DataFrame, text: str = "text", stop_words: tuple[str, ...] = STOP_WORDS) -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words and n_stop_words (long)."""
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    trimmed = F.regexp_replace(body, f"^{SPACE}+|{SPACE}+$", "")
    words = let(trimmed, lambda t: F.when(F.length(t) == 0, F.array().cast("array<string>")).otherwise(F.split(t, f"{SPACE}+")))
    lines = F.filter(F.split(body, "\n"), lambda x: x.rlike(NOT_SPACE))
    staged = docs.withColumn("__rules_body", body).withColumn("__rules_words", words).withColumn("__rules_lines", lines)
    counts = {
        "n_words": F.size("__rules_words"),
        "word_chars": F.length(F.array_join("__rules_words", "")),
        "n_symbols": F.regexp_count("__rules_body", F.lit("[#*$%&|<>]")),
        "n_lines": F.size("__rules_lines"),
        "n_dup_lines": F.size("__rules_lines") - F.size(F.array_distinct("__rules_lines")),
        "n_repeat_words": _repeat_words(F.col("__rules_words")),
        "n_stop_words": F.size(F.filter("__rules_words", lambda w: F.lower(w).isin(*stop_words))),
    }
    return staged.withColumns({k: v.cast("long") for k, v in counts.items()}).drop("__rules_body", "__rules_words", "__rules_lines")


def passes(rules: tuple[Rule, ...] = RULES) -> Column:
    """The table as one boolean expression; a ratio without a denominator passes."""
    tests = [F.lit(True)]
    for r in rules:
        top, bottom = (F.col(x.strip()) for x in r.ratio.split("/"))
        for bound, ok in ((r.low, lambda b, t=top, d=bottom: t >= d * F.lit(b)), (r.high, lambda b, t=top, d=bottom: t <= d * F.lit(b))):
            if bound is not None:
                tests.append(ok(bound) | (bottom == 0))
    return reduce(lambda a, b: a & b, tests)


def apply_rules(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, min_words: int = 50, max_repeat_percent: int = 50) -> DataFrame:
    """``docs`` with the counts, base_failed and kept."""
    counted = text_counts(docs, text)
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    return counted.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & passes(rules))


def op10_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return apply_rules(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "n_stop_words"
    )


_STOP_SQL = ", ".join(f"'{w}'" for w in STOP_WORDS)

OP10_SQL = rf"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS body, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM documents),
g AS (
  SELECT doc_id, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS gram,
         unnest(range(1, len(w) - 1)) AS p
  FROM t WHERE len(w) >= 3),
r AS (SELECT doc_id, p FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, gram) AS c FROM g) WHERE c >= 2),
u AS (SELECT doc_id, count(DISTINCT p + k) AS n FROM r, (VALUES (0), (1), (2)) AS s(k) GROUP BY doc_id),
c AS (
  SELECT t.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
         CAST(length(body) - length(regexp_replace(body, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(u.n, 0) AS BIGINT) AS n_repeat_words,
         CAST(len(ls) AS BIGINT) AS n_lines,
         CAST(len(list_filter(w, lambda x: lower(x) IN ({_STOP_SQL}))) AS BIGINT) AS n_stop_words
  FROM t LEFT JOIN u USING (doc_id)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM c)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND word_chars >= n_words * 2.0 AND word_chars <= n_words * 14.0 AND n_symbols <= n_words * 0.2
         AND n_stop_words >= n_words * 0.02 AND n_dup_lines <= n_lines * 0.5 AS kept, n_lines, n_stop_words
FROM f
"""
