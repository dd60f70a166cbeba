"""Mixing sources to target weights by Pareto order sampling.

Targets: sources share the words of the whole corpus by weight; a target stops at ``LIMIT``
times its source's size and the excess is shared again. Within a source the target is shared
over size classes (documents whose sizes have the same number of binary digits) in the same
way, larger classes weighing more per word, so inclusion chances are unequal.

A document with expected copies e is taken floor(e) times for certain. For the remaining
fraction p, documents are ranked by the odds of a random number divided by the odds of p, and
the first in that order are taken as long as they fit into the words the source still needs; then
the largest later documents that fit what is left are taken until none fits.

The ranking needs no sort of a source: ranks fall into ``BUCKETS`` buckets whose words are
added up, and only the bucket in which a source reaches its goal is ordered exactly. All steps
are DataFrame expressions; the random number comes from the md5 of the id, so reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmargin.llm.arrays import column, fresh
from shelfmargin.session import checkpointed

LIMIT = 3
BUCKETS = 1 << 16
SEED = "mix"
SALTS = 32
_WORD = "[^\\x20\\x09-\\x0D]+"


def word_count(text: Column) -> Column:
    """Number of words (null: 0)."""
    return F.coalesce(F.regexp_count(text, F.lit(_WORD)), F.lit(0)).cast("long")


def _filled(groups: DataFrame, within: list[str], size: str, weight: str, goal: str, order: list[Column]) -> DataFrame:
    """Share ``goal`` by ``weight`` up to ``LIMIT`` * ``size`` each, as ``share``.

    Groups fill up in the order of limit / weight. The first one whose limit is not below its
    part of what is left, and all after it, get parts of that. Whole-number sums, so exact.
    """
    line = Window.partitionBy(*within).orderBy((F.col(size) * LIMIT / F.col(weight)).asc(), *order)
    before = line.rowsBetween(Window.unboundedPreceding, -1)
    onward = line.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = Window.partitionBy(*within)
    none = F.lit(0).cast("long")
    left = F.col(goal) - F.coalesce(F.sum(F.col(size) * LIMIT).over(before), none)
    ranked = groups.withColumn("left_goal", left).withColumn("left_weight", F.sum(weight).over(onward))
    full = F.col(size) * LIMIT * F.col("left_weight") <= F.col("left_goal") * F.col(weight)
    level = F.min(
        F.when(~full, F.struct((F.col(size) * LIMIT / F.col(weight)).alias("at"), (F.col("left_goal") / F.col("left_weight")).alias("level")))
    ).over(whole)["level"]
    return (
        ranked.withColumn("full", full)
        .withColumn("level", level)
        .withColumn(
            "share",
            F.when(F.col("full") | F.col("level").isNull(), (F.col(size) * LIMIT).cast("double")).otherwise(
                F.col("level") * F.col(weight)
            ),
        )
        .drop("left_goal", "left_weight", "full", "level")
    )


def source_targets(sizes: DataFrame) -> DataFrame:
    """``source, source_size, target`` from rows of ``source, size``.

    Sources in code-point order, null last, weigh 1, 2, 3, repeating. One row per source meets
    in a task, after the words of each were added up.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    everyone = Window.orderBy(F.col("source").asc_nulls_last())
    weighed = totals.withColumn("weight", ((F.row_number().over(everyone) - 1) % 3 + 1).cast("long"))
    total = totals.agg(F.sum("source_size")).scalar()
    filled = _filled(
        weighed.withColumn("goal", total).withColumn("all", F.lit(1)),
        ["all"], "source_size", "weight", "goal", [F.col("source").asc_nulls_last()],
    )
    return filled.select("source", "source_size", F.col("share").alias("target"))


def random_odds(doc_id: Column, chance: Column) -> Column:
    """A rank in (0, 1) that grows with odds(random number) / odds(chance)."""
    digest = F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit("|" + SEED)).cast("binary"))
    number = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / F.lit(2.0**52)
    odds = number / (1 - number) * (1 - chance) / chance
    return odds / (1 + odds)


def _salted(few: DataFrame) -> DataFrame:
    """The few rows of each source once per salt, so that the rows of a hot source meet them in many tasks."""
    return few.withColumn("few_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def _gap_fillers(rows: DataFrame) -> DataFrame:
    """``fill_source, fill_odds, fill_id, fill_size``: later documents that fill what the order left open.

    The order stops at the first document that is too large for the words a source still needs. Of
    the documents after it the largest that fits is taken, then the largest that fits the rest, until
    none fits. Equal rows count together. How many of each number of words are taken follows from one
    list per source with as many entries as there are numbers of words; of each number the
    last in the order are taken.
    """
    open_ = F.col("odds").isNotNull() & ~F.col("taken") & (F.col("size") > 0)
    units = (
        rows.where(open_ & (F.col("size") <= F.col("gap")))
        .groupBy("source", "odds", "doc_id", "size")
        .agg((F.count("*") * F.col("size")).alias("words"), F.max("gap").alias("gap"))
        .where(F.col("words") <= F.col("gap"))
    )
    lists = (
        units.groupBy("source", "words")
        .agg(F.count("*").alias("held"), F.max("gap").alias("gap"))
        .groupBy("source")
        .agg(F.sort_array(F.collect_list(F.struct("words", "held")), False).alias("sizes"), F.max("gap").alias("gap"))
    )

    def step(state: Column, one: Column) -> Column:
        number = F.least(one["held"], F.floor(state["gap"] / one["words"]))
        more = F.concat(state["takes"], F.array(F.struct(one["words"].alias("words"), number.alias("number"))))
        return F.struct(
            (state["gap"] - number * one["words"]).alias("gap"),
            F.when(number > 0, more).otherwise(state["takes"]).alias("takes"),
        )

    start = F.struct(F.col("gap").alias("gap"), F.array().cast("array<struct<words:bigint,number:bigint>>").alias("takes"))
    takes = checkpointed(
        lists.select("source", F.explode(F.aggregate("sizes", start, step, lambda state: state["takes"])).alias("take")).select(
            F.col("source").alias("of"), F.col("take.words").alias("take_words"), F.col("take.number").alias("number")
        )
    )
    most = takes.agg(F.max("number")).first()[0] or 0  # one number: lets every task keep that many rows of a group
    last = Window.partitionBy("source", "words").orderBy(F.desc("odds"), F.desc("doc_id"), F.desc("size"))
    return (
        units.join(takes, F.col("source").eqNullSafe(F.col("of")) & (F.col("words") == F.col("take_words")))
        .withColumn("place", F.row_number().over(last))
        .where((F.col("place") <= most) & (F.col("place") <= F.col("number")))
        .select(
            F.col("source").alias("fill_source"), F.col("odds").alias("fill_odds"),
            F.col("doc_id").alias("fill_id"), F.col("size").alias("fill_size"),
        )
    )


def mix(sizes: DataFrame) -> DataFrame:
    """``sizes`` (``doc_id, source, size``) with ``source_size, target, copies``.

    Rows that agree in id, size and source are taken alike. Null ids share a random number and
    are told apart by size; a null source is a source of its own. Documents without words are
    never taken. Of an empty table nothing is taken.
    """
    targets = source_targets(sizes)
    digits = F.length(F.bin("size")).cast("long")
    classed = sizes.withColumn("size_class", digits).withColumn(
        "salt", F.pmod(F.xxhash64("doc_id", "size"), F.lit(SALTS)).cast("int")
    )
    salt = F.col("salt") == F.col("few_salt")
    # one row per source and size class: at most 64 per source
    classes = classed.groupBy("source", "size_class").agg(F.sum("size").alias("class_size"))
    named = classes.withColumnRenamed("source", "of").join(targets, F.col("of").eqNullSafe(F.col("source"))).drop("of")
    goal = named.withColumn("goal", F.rint("target").cast("long")).withColumn(
        "weight", F.col("class_size") * (F.col("size_class") + 16)
    ).where("class_size > 0")
    shares = _filled(goal, ["source"], "class_size", "weight", "goal", [F.col("size_class")])
    expected = F.col("share") / F.col("class_size")
    certain = F.least(F.floor(expected + 1e-9), F.lit(LIMIT).cast("long"))
    plan = shares.withColumn("certain", certain).withColumn(
        "chance", F.greatest(F.least(expected - certain, F.lit(1 - 1e-9)), F.lit(0.0))
    )
    sure = plan.groupBy("source").agg(F.sum(F.col("certain") * F.col("class_size")).alias("sure"), F.max("goal").alias("goal"))
    need = sure.select(F.col("source").alias("need_source"), (F.col("goal") - F.col("sure")).alias("need"))
    plan = checkpointed(
        plan.join(need, F.col("source").eqNullSafe(F.col("need_source"))).select(
            F.col("source").alias("plan_source"), F.col("size_class").alias("plan_class"),
            "certain", "chance", "need",
        )
    )
    same = F.col("source").eqNullSafe(F.col("plan_source")) & (F.col("size_class") == F.col("plan_class"))
    ranked = classed.join(_salted(plan), same & salt, "left").drop("few_salt").withColumn(
        "odds", F.when(F.col("chance") > 0, random_odds(F.col("doc_id"), F.col("chance")))
    )
    drawn = ranked.where(F.col("odds").isNotNull()).withColumn("bucket", F.floor(F.col("odds") * BUCKETS))
    per_bucket = drawn.groupBy("source", "bucket").agg(F.sum("size").alias("words"), F.max("need").alias("need"))
    running = F.sum("words").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    reached = (
        per_bucket.withColumn("running", running)
        .where(F.col("running") >= F.col("need"))
        .groupBy("source")
        .agg(F.min(F.struct("bucket", "running", "words")).alias("edge"))
        .select(
            F.col("source").alias("edge_source"),
            F.col("edge.bucket").alias("edge_bucket"),
            (F.col("edge.running") - F.col("edge.words")).alias("words_before"),
        )
    )
    at_edge = drawn.join(
        _salted(reached), salt & F.col("source").eqNullSafe(F.col("edge_source")) & (F.col("bucket") == F.col("edge_bucket"))
    ).drop("few_salt")
    folded = at_edge.groupBy("source", "odds", "doc_id", "size", "need", "words_before").agg(
        (F.count("*") * F.col("size")).alias("words")
    )
    last = Window.partitionBy("source").orderBy("odds", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    filled = folded.withColumn("filled", F.sum("words").over(last) + F.col("words_before"))
    cuts = (
        filled.where(F.col("filled") <= F.col("need"))
        .groupBy("source")
        .agg(F.max(F.struct("odds", "doc_id", "size", "filled")).alias("cut"))
        .select(F.col("source").alias("cut_source"), F.struct("cut.odds", "cut.doc_id", "cut.size").alias("cut"), "cut.filled")
    )
    needs = plan.groupBy("plan_source").agg(F.max("need").alias("whole_need"))
    ends = (
        reached.join(cuts, F.col("edge_source").eqNullSafe(F.col("cut_source")), "left")
        .join(needs, F.col("edge_source").eqNullSafe(F.col("plan_source")))
        .select(
            "edge_source", "edge_bucket", "cut",
            (F.col("whole_need") - F.coalesce("filled", "words_before")).alias("gap"),
        )
    )
    place = F.floor(F.col("odds") * BUCKETS)
    # a source that never reaches its need takes every drawn document
    taken = F.col("odds").isNotNull() & (
        F.col("edge_bucket").isNull()
        | (place < F.col("edge_bucket"))
        | F.coalesce((place == F.col("edge_bucket")) & (F.struct("odds", "doc_id", "size") <= F.col("cut")), F.lit(False))
    )
    rows = checkpointed(
        ranked.join(_salted(ends), F.col("source").eqNullSafe(F.col("edge_source")) & salt, "left").select(
            "doc_id", "source", "size", "salt", "odds", "gap", taken.alias("taken"),
            F.coalesce("certain", F.lit(0).cast("long")).alias("certain"),
        )
    )
    fill = _gap_fillers(rows)
    filling = F.col("fill_size").isNotNull() & ~F.col("taken")
    rows = rows.join(
        fill,
        F.col("source").eqNullSafe(F.col("fill_source"))
        & F.col("doc_id").eqNullSafe(F.col("fill_id"))
        & (F.col("odds") == F.col("fill_odds"))
        & (F.col("size") == F.col("fill_size")),
        "left",
    ).select(
        "doc_id",
        "source",
        "size",
        "salt",
        (F.col("certain") + F.when(F.col("taken") | filling, 1).otherwise(0)).cast("int").alias("copies"),
    )
    to = targets.withColumnRenamed("source", "target_source")
    return rows.join(_salted(to), F.col("source").eqNullSafe(F.col("target_source")) & salt).drop(
        "target_source", "salt", "few_salt"
    )


def sized(docs: DataFrame) -> DataFrame:
    """``doc_id, source, size``, counted once and kept in the shared folder for the steps of the mix."""
    return checkpointed(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")))


def mixed(docs: DataFrame) -> DataFrame:
    """``docs`` with every row repeated as often as the mix takes it.

    Copies of a row have equal ids. The decision depends on (id, source, size), so it is made
    once for these and joined back, whatever other columns there are.
    """
    size, key, other, third, copies = (fresh(docs, n) for n in ("mix_size", "mix_id", "mix_source", "mix_words", "mix_copies"))
    chosen = mix(sized(docs)).where("copies > 0").select(
        F.col("doc_id").alias(key), F.col("source").alias(other), F.col("size").alias(third), F.col("copies").alias(copies)
    ).distinct()
    same = (
        F.col("doc_id").eqNullSafe(F.col(key)) & F.col("source").eqNullSafe(F.col(other)) & (F.col(size) == F.col(third))
    )
    joined = docs.withColumn(size, word_count(F.col("text"))).join(chosen, same)
    return joined.withColumn(copies, F.explode(F.array_repeat(F.lit(0), F.col(copies)))).select(*[column(c) for c in docs.columns])


def op1_pareto_mix(spark, sf_dir: str) -> DataFrame:
    """Words taken of each document by a mix of all sources."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix(sized(docs)).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("long").alias("taken")
    )


OP1_SQL = """
WITH RECURSIVE sized AS (
    SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size FROM documents
), totals AS (
    SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source
), weighed AS (
    SELECT *, CAST((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1 AS BIGINT) AS weight,
        CAST(sum(source_size) OVER () AS BIGINT) AS goal FROM totals
), ranked AS (
    SELECT *, goal - coalesce(sum(source_size * 3) OVER (ORDER BY CAST(source_size * 3 AS DOUBLE) / weight, source NULLS LAST
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS left_goal,
        sum(weight) OVER (ORDER BY CAST(source_size * 3 AS DOUBLE) / weight, source NULLS LAST
            ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS left_weight FROM weighed
), leveled AS (
    SELECT *, source_size * 3 * left_weight <= left_goal * weight AS is_full,
        (min(CASE WHEN source_size * 3 * left_weight > left_goal * weight THEN {'at': CAST(source_size * 3 AS DOUBLE) / weight,
            'level': CAST(left_goal AS DOUBLE) / CAST(left_weight AS DOUBLE)} END) OVER ()).level AS level FROM ranked
), targets AS (
    SELECT source, source_size,
        CASE WHEN is_full OR level IS NULL THEN CAST(source_size * 3 AS DOUBLE) ELSE level * weight END AS target FROM leveled
), classes AS (
    SELECT source, CAST(length(bin(size)) AS BIGINT) AS size_class, CAST(sum(size) AS BIGINT) AS class_size
    FROM sized GROUP BY ALL HAVING sum(size) > 0
), goals AS (
    SELECT c.*, CAST(round_even(target, 0) AS BIGINT) AS goal, class_size * (size_class + 16) AS weight
    FROM classes c JOIN targets t ON c.source IS NOT DISTINCT FROM t.source
), class_ranked AS (
    SELECT *, goal - coalesce(sum(class_size * 3) OVER (PARTITION BY source ORDER BY CAST(class_size * 3 AS DOUBLE) / weight, size_class
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS left_goal,
        sum(weight) OVER (PARTITION BY source ORDER BY CAST(class_size * 3 AS DOUBLE) / weight, size_class
            ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS left_weight FROM goals
), class_leveled AS (
    SELECT *, class_size * 3 * left_weight <= left_goal * weight AS is_full,
        (min(CASE WHEN class_size * 3 * left_weight > left_goal * weight THEN {'at': CAST(class_size * 3 AS DOUBLE) / weight,
            'level': CAST(left_goal AS DOUBLE) / CAST(left_weight AS DOUBLE)} END) OVER (PARTITION BY source)).level AS level FROM class_ranked
), expected AS (
    SELECT *, CASE WHEN is_full OR level IS NULL THEN CAST(class_size * 3 AS DOUBLE) ELSE level * weight END / class_size AS e
    FROM class_leveled
), planned AS (
    SELECT *, least(CAST(floor(e + 1e-9) AS BIGINT), 3) AS certain,
        greatest(least(e - least(CAST(floor(e + 1e-9) AS BIGINT), 3), 1 - 1e-9), 0.0) AS chance FROM expected
), needed AS (
    SELECT *, goal - CAST(sum(certain * class_size) OVER (PARTITION BY source) AS BIGINT) AS need FROM planned
), drawn AS (
    SELECT s.*, p.certain, p.need,
        (CAST(CAST('0x' || substr(md5(coalesce(CAST(s.doc_id AS VARCHAR), '') || '|mix'), 1, 13) AS BIGINT) AS DOUBLE) + 0.5)
            / 4503599627370496.0 AS u, p.chance
    FROM sized s LEFT JOIN needed p ON s.source IS NOT DISTINCT FROM p.source AND length(bin(s.size)) = p.size_class
), odds AS (
    SELECT *, CASE WHEN chance > 0 THEN u / (1 - u) * (1 - chance) / chance END AS o FROM drawn
), ordered AS (
    SELECT *, o / (1 + o) AS r FROM odds
), run AS (
    SELECT *, sum(size) OVER (PARTITION BY source, o IS NULL ORDER BY r, doc_id NULLS FIRST, size RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS filled,
        sum(size) OVER (PARTITION BY source, o IS NULL, r, doc_id, size) AS words FROM ordered
), gaps AS (
    SELECT source, CASE WHEN sum(size) FILTER (o IS NOT NULL) >= max(need)
        THEN max(need) - coalesce(max(filled) FILTER (o IS NOT NULL AND filled <= need), 0) END AS gap FROM run GROUP BY source
), rest AS (
    SELECT DISTINCT r.source, {'words': CAST(words AS BIGINT), 'r': r, 'doc_id': doc_id, 'size': size} AS unit
    FROM run r JOIN gaps g ON r.source IS NOT DISTINCT FROM g.source
    WHERE o IS NOT NULL AND filled > need AND size > 0 AND words <= gap
), picks AS (
    SELECT g.source, CAST(g.gap AS BIGINT) - max(unit).words AS gap, max(unit) AS unit
    FROM gaps g JOIN rest t ON t.source IS NOT DISTINCT FROM g.source GROUP BY g.source, g.gap
    UNION ALL
    SELECT p.source, p.gap - max(t.unit).words, max(t.unit) FROM picks p JOIN rest t
        ON t.source IS NOT DISTINCT FROM p.source AND t.unit < p.unit AND t.unit.words <= p.gap GROUP BY p.source, p.gap
)
SELECT doc_id, size, t.source_size, t.target,
    CAST(size * (coalesce(certain, 0) + CASE WHEN o IS NOT NULL AND (filled <= need OR p.unit IS NOT NULL) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM run r JOIN targets t ON r.source IS NOT DISTINCT FROM t.source
LEFT JOIN picks p ON r.source IS NOT DISTINCT FROM p.source AND o IS NOT NULL AND p.unit.r = r.r AND p.unit.doc_id IS NOT DISTINCT FROM doc_id AND p.unit.size = size
"""
