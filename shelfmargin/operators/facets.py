"""Dashboard filters and the values they offer."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ALL = "All"


def apply_facets(df: DataFrame, selections: Mapping[str, Sequence | None]) -> DataFrame:
    """Keep rows that match every facet; an empty selection does not filter."""
    for column, values in selections.items():
        if values:
            df = df.where(F.col(column).isin(*values))
    return df


def single_choice(value: str | None) -> list[str]:
    """Selection of a one-value facet, where ``All`` stands for no filter."""
    return [] if value in (None, ALL) else [value]


def facet_options(
    df: DataFrame,
    facets: Sequence[str],
    scopes: Mapping[str, tuple[str, Sequence]] | None = None,
) -> DataFrame:
    """``facet, option``: distinct non-null values per facet, in order.

    ``scopes[facet] = (parent, selected)`` limits the options of ``facet`` to rows whose
    ``parent`` is among the selected values. All facets come from one pass over the data,
    which first folds the rows into the combinations that occur.
    """
    scopes = scopes or {}

    def entry(facet: str) -> Column:
        value = F.col(facet).cast("string")
        parent, selected = scopes.get(facet, (None, ()))
        if selected:
            value = F.when(F.col(parent).isin(*selected), value)
        return F.struct(F.lit(facet).alias("facet"), value.alias("option"))

    used = list(dict.fromkeys([*facets, *[parent for parent, _ in scopes.values()]]))
    combinations = df.select(*used).distinct()
    entries = combinations.select(
        F.explode(F.array(*[entry(facet) for facet in facets])).alias("entry")
    )
    return (
        entries.select("entry.facet", "entry.option")
        .where(F.col("option").isNotNull())
        .distinct()
        .orderBy("facet", "option")
    )
