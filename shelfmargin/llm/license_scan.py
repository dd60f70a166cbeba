"""License texts found by an exact set-similarity join of text blocks with templates.

The blocks for a template of n words are windows of 2 n words of the whole text, starting at
every max(1, n div 2)-th word, so line breaks do not matter, each run of 1.5 n words is inside
a block, and a long line gathers no words from far apart. The tokens of a block are its distinct
words. A template is found in a block that holds at least ``CONTAINMENT`` percent of its tokens.

The blocks of a text are parts of it, so the text's own token set, cut to the vocabulary of all
templates, settles which templates its blocks can reach. Tokens are ordered by how many texts
hold them, rare ones first. A text with a block that reaches the threshold shares one of the
first ``size - needed + 1`` tokens of the template, so only these are join keys (prefix filter);
texts with fewer vocabulary tokens than needed are left out (length filter); the places of the
a shared token in template and text bound how many can still follow (positional filter, before any
intersection). What remains is cut into its blocks, and each is verified on the whole sets.

Short forms are templates of a few words that a block must hold to 100 percent, and the text one after the
other in their order. Templates and short forms of one license share its label.

Templates are a short fixed list, so their prefixes and token counts are broadcast: at most
``MOST_TOKENS`` tokens, checked. All steps are DataFrame expressions.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmargin.session import checkpointed

CONTAINMENT = 75  # percent
MOST_TOKENS = 100_000
_OTHER = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"

# Phrases that stand for a license on their own, and their labels.
BASE_PHRASES = {
    "cc by": "cc-by",
    "general public license": "gpl",
    "all rights reserved": "reserved",
}

# Notices of common licenses, by label.
TEMPLATES = {
    "apache": ("licensed under the apache license version 2 0 you may not use this file except in compliance with the license",),
    "bsd": ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",),
    "cc-by": ("this work is licensed under a creative commons attribution 4 0 international license cc by",),
    "gpl": (
        "this work is licensed under the gnu general public license version 3",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license",
    ),
    "mit": ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",),
    "mpl": ("this source code form is subject to the terms of the mozilla public license v 2 0",),
}

# Lines that name a license. All their words must stand in this order, one after the
# other: of four words a line about any other license would hold 75 percent.
SHORT_FORMS = {
    "apache": ("under the apache license",),
    "mit": ("under the mit license",),
}


def words_text(text: Column) -> Column:
    """The words of a text, A-Z folded, each with a blank on both sides (null: none)."""
    low = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(low, _OTHER, " ")), F.lit(" "))


def _word_total(line: Column) -> Column:
    blanks = F.length(line) - F.length(F.replace(line, F.lit(" "), F.lit("")))
    return F.when(F.trim(line) == "", 0).otherwise(blanks - 1).cast("long")


def _places(line: Column, phrase: str) -> Column:
    """Word positions where ``phrase`` starts; computed only where it occurs."""
    parts = phrase.split(" ")
    words = F.split(F.trim(line), " ")

    def search(whole: Column) -> Column:
        def here(k: Column) -> Column:
            match = F.lit(True)
            for place, part in enumerate(parts):
                match = match & (F.get(whole, k + place) == part)
            return F.coalesce(match, F.lit(False))

        return F.filter(F.sequence(F.lit(0), F.size(whole) - 1), here)

    found = F.get(F.transform(F.array(words), search), 0)
    return F.when(F.contains(line, F.lit(f" {phrase} ")), found).otherwise(F.array().cast("array<int>"))


def base_scan(docs: DataFrame, phrases: dict[str, str] = BASE_PHRASES) -> DataFrame:
    """``docs`` with ``line`` and the places of each phrase: ``n_words, n_base, first_word,
    last_word, base_array``."""
    lined = docs.withColumn("line", words_text(F.col("text")))
    places = {f"at_{k}": (phrase, label) for k, (phrase, label) in enumerate(phrases.items())}
    found = lined.select("*", *[_places(F.col("line"), phrase).alias(name) for name, (phrase, _) in places.items()])
    every = F.flatten(F.array(*places))
    labels = F.array_compact(F.array(*[F.when(F.size(name) > 0, label) for name, (_, label) in places.items()]))
    return found.select(
        *docs.columns,
        _word_total(F.col("line")).alias("n_words"),
        F.size(every).cast("long").alias("n_base"),
        F.array_min(every).cast("long").alias("first_word"),
        F.array_max(every).cast("long").alias("last_word"),
        labels.alias("base_array"),
    )


def _enough_follow(in_template: Column, in_text: Column, needed: Column) -> Column:
    """Whether ``needed`` tokens can be shared from the first shared one on, by what is left of both sets."""
    return F.least(in_template, in_text) >= needed


def _best_block(words: Column, template: Column, length: Column) -> Column:
    """Most tokens of ``template`` that a window of ``2 * length`` words holds."""
    stride = F.greatest(F.expr("length div 2"), F.lit(1))
    starts = F.sequence(F.lit(1), F.greatest(F.size(words) - length, F.lit(1)), stride)
    return F.array_max(
        F.transform(starts, lambda k: F.size(F.array_intersect(template, F.slice(words, k, 2 * length))))
    )


def _forms(
    templates: Mapping[str, Sequence[str]], short_forms: Mapping[str, Sequence[str]], percent: int
) -> list[tuple[str, list[str], int, str | None]]:
    """(label, words, tokens needed, phrase of a short form) of every template that has words."""
    forms = []
    for share, group in ((percent, templates), (100, short_forms)):
        for label, texts in group.items():
            for text in texts:
                words = re.findall("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+", text.lower())
                if words:
                    phrase = " ".join(words) if group is short_forms else None
                    forms.append((label, words, -(-share * len(set(words)) // 100), phrase))
    return forms


def containments(
    docs: DataFrame,
    templates: Mapping[str, Sequence[str]] = TEMPLATES,
    percent: int = CONTAINMENT,
    short_forms: Mapping[str, Sequence[str]] = SHORT_FORMS,
) -> DataFrame:
    """``doc_id, text_hash, label, containment`` (0 to 1): templates found in each document.

    Null texts have no blocks; a template without words is never found.
    """
    spark = docs.sparkSession
    forms = _forms(templates, short_forms, percent)
    vocabulary = sorted({word for _, words, _, _ in forms for word in words})
    if sum(len(set(words)) for _, words, _, _ in forms) > MOST_TOKENS:
        raise ValueError(f"templates have more than {MOST_TOKENS} tokens")
    least = min((needed for _, _, needed, _ in forms), default=1)
    texts = docs.where(F.col("text").isNotNull()).select(
        "doc_id", F.xxhash64("text").alias("text_hash"), F.split(F.trim(words_text(F.col("text"))), " ").alias("words")
    )

    def held(order: list[str]) -> Column:
        return F.array_intersect(F.array(*[F.lit(word) for word in order]).cast("array<string>"), F.col("words"))

    # frequencies only order the tokens: any order gives the same result, the rare ones first the fewest candidates
    counted = {
        row.token: row.texts
        for row in texts.select(F.explode(held(vocabulary)).alias("token")).groupBy("token").agg(F.count("*").alias("texts")).collect()
    }
    order = sorted(vocabulary, key=lambda word: (counted.get(word, 0), word))
    rank = {word: k for k, word in enumerate(order)}
    prefixes = []
    for label, words, needed, phrase in forms:
        ordered = sorted(set(words), key=rank.__getitem__)
        prefixes += [
            (token, place, label, ordered, len(ordered), needed, len(words), phrase)
            for place, token in enumerate(ordered[: len(ordered) - needed + 1])
        ]
    few = spark.createDataFrame(
        prefixes,
        "token string, place int, label string, template array<string>, template_size int, needed int, length int, phrase string",
    )
    keys = F.array(*[F.lit(word) for word in sorted({p[0] for p in prefixes}, key=rank.__getitem__)]).cast("array<string>")
    # both sets are in the order of ranks: the first shared token has the most tokens after it, so the
    # row that the bound must keep is its own, and the other rows go
    here = F.array_position("tokens", F.col("token")).cast("int")
    candidates = (
        texts.withColumn("tokens", held(order))
        .where(F.size("tokens") >= least)
        .withColumn("keys", F.array_intersect(keys, F.col("tokens")))
        .where(F.size("keys") > 0)
        .select("doc_id", "text_hash", "words", "tokens", F.explode("keys").alias("token"))
        .join(F.broadcast(few), "token")
        .where(F.size("tokens") >= F.col("needed"))
        .where(_enough_follow(F.col("template_size") - F.col("place"), F.size("tokens") - here + 1, F.col("needed")))
        .where(F.get(F.array_intersect("template", "tokens"), 0) == F.col("token"))
        .where(F.size(F.array_intersect("template", "tokens")) >= F.col("needed"))
    )
    shared = _best_block(F.col("words"), F.col("template"), F.col("length"))
    text = F.concat(F.lit(" "), F.array_join("words", " "), F.lit(" "))
    in_order = F.col("phrase").isNull() | F.contains(text, F.concat(F.lit(" "), F.col("phrase"), F.lit(" ")))
    return (
        candidates.where(in_order)
        .withColumn("shared", shared)
        .where(F.col("shared") >= F.col("needed"))
        .groupBy("doc_id", "text_hash", "label")
        .agg(F.max(F.col("shared") / F.col("template_size")).alias("containment"))
    )


def scan(
    docs: DataFrame,
    templates: Mapping[str, Sequence[str]] = TEMPLATES,
    percent: int = CONTAINMENT,
    short_forms: Mapping[str, Sequence[str]] = SHORT_FORMS,
) -> DataFrame:
    """``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score`` of each row.

    ``score`` is the best containment, or 1 where a base phrase stands. Without any label the
    label columns are empty texts. Rows with equal id and text have equal results; ids may be null.
    """
    source = docs.select("doc_id", "text")
    found = checkpointed(containments(source, templates, percent, short_forms))
    merged = found.groupBy(F.col("doc_id").alias("found_id"), F.col("text_hash").alias("found_hash")).agg(
        F.collect_set("label").alias("more"), F.max("containment").alias("best")
    )
    based = base_scan(source.withColumn("text_hash", F.xxhash64("text"))).drop("text")
    joined = based.join(
        merged, F.col("doc_id").eqNullSafe(F.col("found_id")) & (F.col("text_hash") == F.col("found_hash")), "left"
    )
    every = F.array_union("base_array", F.coalesce("more", F.array().cast("array<string>")))
    score = F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("best", F.lit(0.0)))
    return joined.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        F.array_join(F.array_sort(F.array_distinct("base_array")), ",").alias("base_labels"),
        F.array_join(F.array_sort(every), ",").alias("labels"),
        score.alias("score"),
    )


def op10_license_scan(spark, sf_dir: str) -> DataFrame:
    """Phrases and license notices of every document."""
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _template_rows() -> str:
    """``(label, words, all words, tokens needed, phrase)`` of every template and short form."""
    rows = []
    for label, words, needed, phrase in _forms(TEMPLATES, SHORT_FORMS, CONTAINMENT):
        listed = ", ".join(repr(word) for word in sorted(set(words)))
        rows.append(f"('{label}', [{listed}], {len(words)}, {needed}, {repr(phrase) if phrase else 'NULL'})")
    return ", ".join(rows)


def _phrase(phrase: str, name: str) -> str:
    parts = phrase.split(" ")
    test = " AND ".join(f"w[k + {k}] = '{part}'" for k, part in enumerate(parts))
    return f"list_filter(range(1, len(w) + 1), lambda k: coalesce({test}, false)) AS {name}"


OP10_SQL = f"""
WITH templates(label, words, n, needed, phrase) AS (VALUES {_template_rows()}),
numbered AS (
    SELECT row_number() OVER () AS r, doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
), worded AS (
    SELECT r, doc_id, t, regexp_extract_all(t, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM numbered
), placed AS (
    SELECT r, doc_id, w, {', '.join(_phrase(phrase, f'a{k}') for k, phrase in enumerate(BASE_PHRASES))} FROM worded
), held AS (
    SELECT r, w, label, words, n, needed FROM worded, templates
    WHERE len(list_intersect(list_distinct(w), words)) >= needed
        AND (phrase IS NULL OR contains(' ' || array_to_string(w, ' ') || ' ', ' ' || phrase || ' '))
), blocks AS (
    SELECT r, label, len(words) AS size, needed, list_max(list_transform(
        range(1, greatest(len(w) - n, 1) + 1, greatest(n // 2, 1)),
        lambda k: len(list_intersect(list_distinct(w[k : k + 2 * n - 1]), words))
    )) AS shared FROM held
), found AS (
    SELECT r, label, max(shared / size) AS containment FROM blocks WHERE shared >= needed GROUP BY r, label
), merged AS (
    SELECT r, list(label) AS more, max(containment) AS best FROM found GROUP BY r
), joined AS (
    SELECT p.*, list_concat(list_concat(a0, a1), a2) AS a, coalesce(m.more, []) AS more, m.best,
        list_filter([{', '.join(f"CASE WHEN len(a{k}) > 0 THEN '{label}' END" for k, label in enumerate(BASE_PHRASES.values()))}], lambda x: x IS NOT NULL) AS base
    FROM placed p LEFT JOIN merged m USING (r)
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(a) AS BIGINT) AS n_base,
    CAST(list_min(a) - 1 AS BIGINT) AS first_word, CAST(list_max(a) - 1 AS BIGINT) AS last_word,
    array_to_string(list_sort(base), ',') AS base_labels,
    array_to_string(list_sort(list_distinct(list_concat(base, more))), ',') AS labels,
    CASE WHEN len(a) > 0 THEN 1.0::DOUBLE ELSE coalesce(best, 0.0)::DOUBLE END AS score
FROM joined
"""
