"""Product names, attribute maps and padded keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNKNOWN = "not have"
ATTRIBUTES = ("type", "variant")


# The characters that count as blank around a name part.
BLANKS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


def name_part(name: Column, index: int) -> Column:
    """The ``index``-th comma part without surrounding blanks; NULL if there is none."""
    return F.btrim(F.get(F.split(name, ","), F.lit(index)), F.lit(BLANKS))


def split_name(name: Column) -> list[Column]:
    return [
        name_part(name, index).alias(alias)
        for index, alias in enumerate(("full_name", *ATTRIBUTES))
    ]


def attribute_map() -> Column:
    """Map that holds only the attributes a product has."""
    pairs = [item for name in ATTRIBUTES for item in (F.lit(name), F.col(name))]
    return F.map_filter(F.create_map(*pairs), lambda _, value: value.isNotNull())


def attribute(name: str) -> Column:
    return F.coalesce(F.try_element_at(F.col("attributes"), F.lit(name)), F.lit(UNKNOWN))


def padded_key(position: Column, width: int) -> Column:
    """Zero-padded text; longer numbers keep all their digits."""
    return F.format_string(f"%0{width}d", position)
