"""Quality rules: a table of thresholds compiled into one Spark projection.

All measures are built-in expressions over one text, so a document of any length is judged in
its own row and nothing is shuffled. The stop words are the commonest words of the languages of
the corpus; a language outside the list needs its own.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmargin.llm.arrays import column, fresh

WINDOW = 8
_SPACES = "[\\x20\\x09-\\x0D]+"

# Common words of English, German, French and Spanish.
STOP_WORDS = (
    "the of and to in a is that it was for on be with as by at this are an "
    "der die und das den von zu mit ist ein eine im nicht auch sich auf "
    "le la les de et des un une que est pour dans sur pas par en au "
    "el los las y del se no una por con su para lo al como"
).split()

# Fixed values: (measure, least, most); null is no bound. A document passes if every measure
# that is not null lies within its bounds.
RULES = (
    ("n_words", 20.0, None),
    ("mean_word_chars", 1.5, 15.0),
    ("symbols_per_word", None, 0.5),
    ("stop_word_share", 0.005, None),
    ("dup_line_share", None, 0.6),
    ("repeat_word_share", None, 0.3),
)


def words_of(text: Column) -> Column:
    """Words of a text in order (null: none)."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), _SPACES), lambda w: w != "")


def repeated_words(words: Column, width: int = WINDOW) -> Column:
    """Words inside ``width``-word windows that occur twice or more, first ones included.

    Windows are compared by 64-bit hashes. Without equal hashes the answer is 0; otherwise the
    windows are sorted by hash, and the starts with an equal neighbour are sorted by place, so
    the cost grows with n log n.
    """
    hashes = F.when(
        F.size(words) >= width,
        F.transform(F.sequence(F.lit(1), F.size(words) - (width - 1)), lambda k: F.xxhash64(F.slice(words, k, width))),
    ).otherwise(F.array().cast("array<bigint>"))
    return hashes


def _covered(hashes: Column, width: int) -> Column:
    ordered = F.sort_array(F.transform(hashes, lambda h, k: F.struct(h.alias("h"), k.alias("k"))))

    def starts(pairs: Column) -> Column:
        def equal(k: Column, other: Column) -> Column:
            return F.coalesce(F.get(pairs, k)["h"] == F.get(pairs, other)["h"], F.lit(False))

        found = F.filter(
            F.sequence(F.lit(0), F.size(pairs) - 1), lambda k: equal(k, k - 1) | equal(k, k + 1)
        )
        return F.sort_array(F.transform(found, lambda k: F.get(pairs, k)["k"]))

    def summed(places: Column) -> Column:
        gaps = F.transform(
            places, lambda at, k: F.coalesce(F.least(F.lit(width), F.get(places, k + 1) - at), F.lit(width))
        )
        return F.aggregate(gaps, F.lit(0), lambda a, x: a + x)

    # an array of one value stands for a local name, so that each part is computed once
    bound = F.transform(F.array(ordered), lambda pairs: starts(pairs))
    return F.get(F.transform(bound, lambda places: summed(places)), 0)


def measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the counts of each text as ``n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, n_lines, n_stop_words`` (long; null text: all 0). Same-named columns go."""
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_stop_words")
    others = [c for c in docs.columns if c.lower() not in names]
    words, hashes, lines, folded, raw = (fresh(docs, n) for n in ("q_words", "q_hashes", "q_lines", "q_low", "q_text"))
    base = docs.select(*[column(c) for c in others], F.coalesce(F.col(text), F.lit("")).alias(raw))
    split = base.withColumn(words, words_of(F.col(raw))).withColumn(
        lines, F.filter(F.split(raw, "\n"), lambda line: line.rlike("[^\\x20\\x09-\\x0D]"))
    )
    hashed = split.withColumn(hashes, repeated_words(F.col(words))).withColumn(
        folded, F.regexp_count(F.lower(raw), F.lit("(?<![^\\t\\n\\f\\r \\p{P}])(?:" + "|".join(sorted(set(STOP_WORDS))) + ")(?![^\\t\\n\\f\\r \\p{P}])"))
    )
    repeats = F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), _covered(F.col(hashes), WINDOW)).otherwise(0)
    return hashed.select(
        *[column(c) for c in others],
        F.size(words).cast("long").alias("n_words"),
        F.coalesce(F.length(F.array_join(words, "")), F.lit(0)).cast("long").alias("word_chars"),
        F.regexp_count(raw, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        repeats.cast("long").alias("n_repeat_words"),
        F.size(lines).cast("long").alias("n_lines"),
        F.col(folded).cast("long").alias("n_stop_words"),
    )


def _ratio(part: str, whole: str) -> Column:
    return F.try_divide(F.col(part).cast("double"), F.col(whole))


RATIOS = {
    "n_words": lambda: F.col("n_words").cast("double"),
    "mean_word_chars": lambda: _ratio("word_chars", "n_words"),
    "symbols_per_word": lambda: _ratio("n_symbols", "n_words"),
    "stop_word_share": lambda: _ratio("n_stop_words", "n_words"),
    "dup_line_share": lambda: _ratio("n_dup_lines", "n_lines"),
    "repeat_word_share": lambda: _ratio("n_repeat_words", "n_words"),
}


def failed_rules(rules=RULES) -> Column:
    """The names of the rules that a row of ``measures`` breaks, compiled from the table."""

    def breaks(name: str, least: float | None, most: float | None) -> Column:
        bounds = [RATIOS[name]() < least] if least is not None else []
        bounds += [RATIOS[name]() > most] if most is not None else []
        return F.when(F.coalesce(reduce(lambda a, b: a | b, bounds, F.lit(False)), F.lit(False)), F.lit(name))

    return F.array_compact(F.array(*[breaks(*rule) for rule in rules]))


def judged(docs: DataFrame, rules=RULES, text: str = "text") -> DataFrame:
    """``docs`` with the counts, ``base_failed``, ``failed_rules`` and ``kept``."""
    counted = measures(docs, text)
    base = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return (
        counted.withColumn("base_failed", base)
        .withColumn("failed_rules", failed_rules(rules))
        .withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))
    )


def op5_quality_rules(spark, sf_dir: str) -> DataFrame:
    """Counts and verdict of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return judged(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_stop_words",
        "base_failed", "kept",
    )


OP5_SQL = f"""
WITH split AS (
    SELECT doc_id, coalesce(text, '') AS t,
        list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w,
        list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\\x20\\x09-\\x0D]')) AS l,
    FROM documents
), windows AS (
    SELECT rowid AS r, unnest(range(1, greatest(len(w) - 6, 1))) AS k, w FROM (SELECT row_number() OVER () AS rowid, doc_id, w FROM split)
), repeats AS (
    SELECT r, k FROM (SELECT r, k, count(*) OVER (PARTITION BY r, array_to_string(w[k:k + 7], ' ')) AS n FROM windows) WHERE n > 1
), covered AS (
    SELECT r, sum(least(8, coalesce(next - k, 8))) AS n FROM
        (SELECT r, k, lead(k) OVER (PARTITION BY r ORDER BY k) AS next FROM repeats) GROUP BY r
), counted AS (
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
        CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
        CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words,
        CAST(len(l) AS BIGINT) AS n_lines,
        CAST(len(list_filter(regexp_split_to_array(lower(t), '[\\t\\n\\f\\r \\pP]'),
            lambda x: x IN ({', '.join(repr(w) for w in sorted(set(STOP_WORDS)))}))) AS BIGINT) AS n_stop_words
    FROM (SELECT row_number() OVER () AS rowid, * FROM split) s LEFT JOIN covered c ON s.rowid = c.r
), judged AS (
    SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM counted
)
SELECT *, NOT base_failed AND n_words >= 20 AND word_chars / n_words BETWEEN 1.5 AND 15 AND n_symbols / n_words <= 0.5
    AND n_stop_words / n_words >= 0.005 AND coalesce(n_dup_lines / nullif(n_lines, 0), 0) <= 0.6
    AND n_repeat_words / n_words <= 0.3 AS kept FROM judged
"""
