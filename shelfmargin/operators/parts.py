"""Arrays of bounded length for keys of any size."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmargin.operators.numbering import number_rows
from shelfmargin.session import checkpointed, shuffles_removed

ITEMS_PER_PART = 100_000


def collect_in_parts(
    rows: DataFrame,
    key: str,
    fields: Sequence[str],
    name: str,
    items_per_part: int = ITEMS_PER_PART,
    totals: Mapping[str, Column] | None = None,
) -> DataFrame:
    """``key, part, first_no, name`` and ``totals``: the rows of each key as arrays of structs of ``fields``.

    The rows of a key are numbered by ``fields`` from 1; part p holds the numbers from
    ``first_no = p * items_per_part + 1`` on. The rule is the same for every key and input:
    parts in order hold the whole key in order, and no array is longer than ``items_per_part``.
    ``totals`` are aggregates over all rows of a key; they stand in part 0 alone.

    Fewer than ``rows / items_per_part`` keys have more than one part. Their rows alone are sorted over
    many tasks; those of every other key are dealt once, for array and totals. ``rows`` are read twice, and
    again where a key has several parts.
    """
    totals = totals or {}
    rows = rows.where(F.col(key).isNotNull())
    counts = rows.groupBy(key).agg(F.count("*").alias("key_rows"))
    with shuffles_removed(rows.sparkSession):
        large = checkpointed(counts.where(F.col("key_rows") > items_per_part).select(key))
    if large.isEmpty():
        return _one_part(rows, key, fields, name, totals)
    return _one_part(rows.join(F.broadcast(large), key, "left_anti"), key, fields, name, totals).unionByName(
        _several_parts(rows.join(F.broadcast(large), key, "left_semi"), key, fields, name, items_per_part, totals)
    )


def _one_part(
    rows: DataFrame, key: str, fields: Sequence[str], name: str, totals: Mapping[str, Column]
) -> DataFrame:
    """The rows of each key as one array.

    They are dealt before they are grouped: arrays begun in each task would take more bytes than the rows.
    """
    items = F.array_sort(F.collect_list(F.struct(*fields)))
    numbered = F.transform(
        "items", lambda item, place: F.struct((place + 1).cast("long").alias("item_no"), *[item[field].alias(field) for field in fields])
    )
    return rows.repartition(key).groupBy(key).agg(items.alias("items"), *_named(totals)).select(
        key, F.lit(0).alias("part"), F.lit(1).cast("long").alias("first_no"), numbered.alias(name), *totals
    )


def _several_parts(
    rows: DataFrame, key: str, fields: Sequence[str], name: str, items_per_part: int, totals: Mapping[str, Column]
) -> DataFrame:
    """The rows of each key, numbered without a window over a key, as arrays of ``items_per_part``."""
    with shuffles_removed(rows.sparkSession):
        numbered = number_rows(rows.select(key, *fields), [F.col(field) for field in fields], "item_no", within=[key])
    part = F.expr(f"cast((item_no - 1) div {items_per_part} AS int)")
    items = F.array_sort(F.collect_list(F.struct("item_no", *fields)))
    lists = numbered.groupBy(key, part.alias("part")).agg(
        F.min("item_no").alias("first_no"), items.alias(name)
    )
    if not totals:
        return lists
    heads = rows.groupBy(key).agg(*_named(totals)).withColumn("part", F.lit(0))
    return lists.join(heads, [key, "part"], "left")


def _named(totals: Mapping[str, Column]) -> list[Column]:
    return [total.alias(name) for name, total in totals.items()]
