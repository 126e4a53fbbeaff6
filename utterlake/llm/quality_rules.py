"""Quality rules: a threshold table compiled into one projection of ratios.

Everything is a built-in column function; no user functions, no shuffle. A
row is judged by itself, so skewed sources and copies cost nothing extra.

Defined cases: a null text counts as empty and has no words; an empty text
fails the base rule; ties do not arise; repeated rows give repeated rows; an
empty table gives an empty table; other columns of the input pass through
unchanged under their own names (a clash with an output name raises).
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACES = " \t\n\x0b\x0c\r"
SPACE_RUN = "[\\x20\\x09-\\x0D]+"
SYMBOLS = "#*$%&|<>"

#: Frequent function words of the supported languages. Fixed values.
STOP_WORDS = (
    "the", "be", "to", "of", "and", "that", "have", "with", "in", "is", "was",
    "der", "die", "das", "und", "ist", "den", "von", "zu", "mit", "ein",
    "le", "la", "les", "de", "et", "des", "un", "une", "que", "pour", "en", "au",
    "el", "los", "las", "y", "del", "por", "con", "su",
)


@dataclass(frozen=True)
class Rule:
    """lo <= 1000 * part / whole <= hi, in integers; whole None: part itself is compared, unscaled."""

    name: str
    part: str
    whole: str | None
    lo: int | None
    hi: int | None
    min_words: int = 0


RULES: tuple[Rule, ...] = (
    Rule("words", "n_words", None, 50, 200_000),
    Rule("mean_word_length", "word_chars", "n_words", 2_000, 14_000),
    Rule("symbols_per_word", "n_symbols", "n_words", None, 250),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", None, 500),
    Rule("repeated_windows", "n_repeat_words", "n_words", None, 500),
    Rule("stop_words", "n_stop_words", "n_words", 5, None),
)


def compile_rules(rules: Sequence[Rule]) -> Column:
    """One array column with the names of the rules that a row breaks."""
    broken = []
    for r in rules:
        part = F.col(r.part).cast("long")
        value, scale = (part, F.lit(1)) if r.whole is None else (part * 1000, F.col(r.whole).cast("long"))
        bad = F.lit(False)
        if r.lo is not None:
            bad = bad | (value < scale * r.lo)
        if r.hi is not None:
            bad = bad | (value > scale * r.hi)
        broken.append(F.when(bad & (F.col("n_words") >= r.min_words), F.lit(r.name)))
    return F.filter(F.array(*broken), lambda x: x.isNotNull())


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words and n_stop_words."""
    own = {"n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_stop_words"}
    if clash := own & set(docs.columns):
        raise ValueError(f"columns already present: {sorted(clash)}")
    t = F.coalesce(F.col(text), F.lit(""))
    blank = lambda c: F.length(F.translate(c, SPACES, "")) == 0
    df = docs.withColumns(
        {
            "_words": F.filter(F.split(t, SPACE_RUN), lambda w: w != ""),
            "_lines": F.filter(F.split(t, "\n"), lambda x: ~blank(x)),
        }
    )
    w = F.col("_words")
    df = df.withColumns(
        {
            "n_words": F.size(w).cast("long"),
            "word_chars": F.length(F.translate(t, SPACES, "")).cast("long"),
            "n_symbols": (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long"),
            "n_lines": F.size("_lines").cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "n_stop_words": F.size(F.filter(w, lambda x: F.lower(x).isin(*STOP_WORDS))).cast("long"),
            # one (hash, place) pair for each window of three words, equal windows side by side
            "_windows": F.when(
                F.size(w) >= 3,
                F.array_sort(F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.struct(F.xxhash64(w[i], w[i + 1], w[i + 2]).alias("h"), i.alias("i")))),
            ).otherwise(F.array().cast("array<struct<h:bigint,i:int>>")),
        }
    )
    s = F.col("_windows")
    twice = F.filter(s, lambda e, j: (e["h"] == F.get(s, j - 1)["h"]) | (e["h"] == F.get(s, j + 1)["h"]))
    covered = F.array_distinct(F.flatten(F.transform(twice, lambda e: F.array(e["i"], e["i"] + 1, e["i"] + 2))))
    return df.withColumn("n_repeat_words", F.size(covered).cast("long")).drop("_words", "_lines", "_windows")


def quality_rules(docs: DataFrame, rules: Sequence[Rule] = RULES, text: str = "text") -> DataFrame:
    """docs with the measures, `broken` (names of broken rules), `base_failed` and `kept`.

    base_failed: fewer than 50 words, or more than half of the words in
    repeated three-word windows. kept: not base_failed and no rule broken.
    """
    df = measure(docs, text).withColumn("broken", compile_rules(rules))
    base = (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)
    return df.withColumn("base_failed", base).withColumn("kept", ~base & (F.size("broken") == 0))


def op9_quality_rules(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return quality_rules(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


_RUN = "'[\\x20\\x09-\\x0D]+'"
OP9_SQL = f"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t,
         list_filter(regexp_split_to_array(coalesce(text, ''), {_RUN}), lambda w: w <> '') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_replace(x, {_RUN}, '', 'g') <> '') AS ln
  FROM documents
), g AS (
  SELECT doc_id, i, w[i] || ' ' || w[i+1] || ' ' || w[i+2] AS tri
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)
), twice AS (
  SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, tri) >= 2
), rep AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, (SELECT unnest([0, 1, 2]) AS k) GROUP BY doc_id
), m AS (
  SELECT d.doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(t, {_RUN}, '', 'g'))::BIGINT AS word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         len(ln)::BIGINT AS n_lines, (len(ln) - len(list_distinct(ln)))::BIGINT AS n_dup_lines,
         coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
         len(list_filter(w, lambda x: lower(x) IN ({", ".join(f"'{x}'" for x in STOP_WORDS)})))::BIGINT AS n_stop_words
  FROM d LEFT JOIN rep ON rep.doc_id = d.doc_id
), b AS (
  SELECT *, n_words < 50 OR n_repeat_words * 100 > n_words * 50 AS base_failed FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND n_words BETWEEN 50 AND 200000
       AND word_chars * 1000 BETWEEN n_words * 2000 AND n_words * 14000 AND n_symbols * 1000 <= n_words * 250
       AND n_dup_lines * 1000 <= n_lines * 500 AND n_repeat_words * 1000 <= n_words * 500
       AND n_stop_words * 1000 >= n_words * 5 AS kept
FROM b
"""
