"""Quality rules: one threshold table compiled into a Spark projection, with built-in functions only."""

from __future__ import annotations

import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lurewatch.llm.common import bind, table, words

# Frequent function words of the four languages.
STOP_WORDS = (
    "the of and to in is it that was for on are as with by at be this have from or an he his she "
    "de la le les des et en un une du que qui dans sur par pour avec est pas au il elle "
    "el los las y del se con su al lo una es como más por para este esta "
    "der die das und den von zu mit sich dem nicht ein eine auf für ist im auch an als"
).split()

#: name, measure, lowest and highest allowed value (None: open). Measures are ratios to words or to lines with a word.
RULES = (
    ("mean_word_chars", "mean_word_chars", 2.0, 20.0),
    ("symbols_per_word", "symbols_per_word", None, 0.2),
    ("stop_word_share", "stop_word_share", 0.02, None),
    ("duplicate_line_share", "duplicate_line_share", None, 0.6),
)
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50

#: Each stop word as written small, capitalised or large, with or without one closing mark.
STOP_FORMS = sorted({f + m for w in STOP_WORDS for f in (w, w.capitalize(), w.upper()) for m in ("", *".,;:!?")})
#: The same forms as xxhash64() gives them: words are hashed anyway, and numbers are cheap to look up.
_STOP_HASHES = [(x ^ 1 << 63) - (1 << 63) for x in (xxhash.xxh64_intdigest(f.encode(), 42) for f in STOP_FORMS)]


def _total(items: Column) -> Column:
    return F.aggregate(items, F.lit(0).cast("long"), lambda a, x: a + x)


def _same_as_neighbour(s: Column) -> Column:
    return F.filter(s, lambda x, k: (x["h"] == F.get(s, k - 1)["h"]) | (x["h"] == F.get(s, k + 1)["h"]))


def _repeat_words(h: Column) -> Column:
    """Words that lie in three-word windows found twice or more. h: hashes of the words in order."""
    windows = F.transform(F.slice(h, F.lit(1), F.greatest(F.size(h) - 2, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(h, i + 1), F.get(h, i + 2)))
    # Only texts in which a window occurs twice go on to sort their windows.
    ordered = lambda t: F.sort_array(F.transform(t, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    places = lambda t: bind(ordered(t), lambda s: F.sort_array(F.transform(_same_as_neighbour(s), lambda x: x["i"])))
    covered = lambda p: _total(F.transform(p, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - x, F.lit(3)))))
    return bind(windows, lambda t: F.when(F.size(F.array_distinct(t)) < F.size(t), bind(places(t), covered)).otherwise(0)).cast("long")


def _counts(t: Column) -> Column:
    """Struct of the base counts, the stop words and the lines with a word of a text."""

    def of(x: Column) -> Column:
        n_dup = F.size(x["l"]) - F.size(F.array_distinct(x["l"]))
        return F.struct(
            F.size(x["w"]).cast("long").alias("n_words"), F.char_length(F.array_join(x["w"], "")).cast("long").alias("word_chars"),
            F.regexp_count(t, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"), n_dup.cast("long").alias("n_dup_lines"),
            _repeat_words(x["h"]).alias("n_repeat_words"), F.size(F.filter(x["h"], lambda h: h.isin(_STOP_HASHES))).alias("stops"), F.size(x["l"]).alias("lines"),
        )

    lines = F.filter(F.split(t, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    hashed = lambda w: F.struct(w.alias("w"), F.transform(w, lambda x: F.xxhash64(x)).alias("h"), lines.alias("l"))
    return bind(bind(words(t), hashed), of)


BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def measured(text: Column) -> Column:
    """Struct of the base counts (BASE, long) and of the measures that RULES names (double, null where there is no word).

    A null text counts as an empty one. Triples of words are told apart by a 64-bit hash. Every step is bound once
    (see bind()), so the expression stays of one size wherever it is pushed.
    """
    ratio = lambda c, x, of: F.try_divide(x[c], x[of])
    return bind(_counts(F.coalesce(text, F.lit(""))), lambda x: F.struct(
        *[x[c].alias(c) for c in BASE], ratio("word_chars", x, "n_words").alias("mean_word_chars"), ratio("n_symbols", x, "n_words").alias("symbols_per_word"),
        ratio("stops", x, "n_words").alias("stop_word_share"), ratio("n_dup_lines", x, "lines").alias("duplicate_line_share"),
    ))


def judged(text: Column, rules=RULES) -> Column:
    """measured() with base_failed, failed_rules and kept (see verdicts())."""

    def of(x: Column) -> Column:
        broken = [F.when((x[m] < lo if lo is not None else F.lit(False)) | (x[m] > hi if hi is not None else F.lit(False)), F.lit(name)) for name, m, lo, hi in rules]
        failed = (x["n_words"] < MIN_WORDS) | (100 * x["n_repeat_words"] > MAX_REPEAT_PERCENT * x["n_words"])
        names = [*BASE, *(m for _, m, _, _ in RULES)]
        return bind(F.struct(x.alias("x"), failed.alias("failed"), F.array_compact(F.array(*broken)).alias("broken")), lambda y: F.struct(
            *[y["x"][c].alias(c) for c in names], y["failed"].alias("base_failed"), y["broken"].alias("failed_rules"), (~y["failed"] & (F.size(y["broken"]) == 0)).alias("kept"),
        ))

    return bind(measured(text), of)


def verdicts(docs: DataFrame, text: str = "text", rules=RULES) -> DataFrame:
    """All columns of the input with the counts and measures of every whole text, base_failed, failed_rules (names of the
    broken rules, in table order) and kept; input columns of those names are replaced.

    base_failed: fewer than 50 words, or over half of the words lie in repeated three-word windows. A measure
    that is null (no word) breaks no rule. Equal and repeated rows get equal results; an empty table gives an
    empty table.
    """
    new = judged(F.col(text), rules)
    names = {*BASE, *(m for _, m, _, _ in RULES), "base_failed", "failed_rules", "kept"}
    out = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("row"), new.alias("new"))
    return out.select(*[F.col("row")[c].alias(c) for c in docs.columns if c not in names], "new.*")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of every document."""
    out = verdicts(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def keep_by_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that break no rule.

    Each row is judged for itself, a repeated one each time; a null text as an empty one. All columns stay as they are,
    whatever their names; an empty table gives an empty one.
    """
    return docs.filter(judged(F.col("text"))["kept"])


_STOP_SQL = ", ".join(f"'{w}'" for w in STOP_FORMS)
SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT r, doc_id, text,
         list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM d
), p AS (
  SELECT r, i, concat_ws(' ', w[i], w[i + 1], w[i + 2]) AS g
  FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) >= 3)
), q AS (
  SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM p
), c AS (
  SELECT r, sum(least(3, coalesce(nxt - i, 3)))::BIGINT AS n
  FROM (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS nxt FROM q WHERE n > 1) GROUP BY r
), m AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
         (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words,
         len(l) AS n_lines,
         len(list_filter(w, lambda x: x IN ({_STOP_SQL}))) AS stops
  FROM w LEFT JOIN c USING (r)
), b AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       CASE WHEN base_failed THEN false ELSE word_chars / n_words BETWEEN 2 AND 20 AND n_symbols / n_words <= 0.2
            AND stops / n_words >= 0.02 AND n_dup_lines / n_lines <= 0.6 END AS kept
FROM b
"""

QUERIES = {"op1_quality_rules": op1_quality_rules}
ORACLES = {"op1_quality_rules": SQL}
