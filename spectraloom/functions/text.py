"""Text helpers with defined results on dirty input."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A finite decimal number and nothing else; "1.5d", "NaN" and "1_0" are none.
NUMBER = r"^[-+]?(?:\d+(?:\.\d*)?|\.\d+)(?:[eE][-+]?\d+)?$"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once per row.

    An expression that a lambda refers to is otherwise evaluated again for every element.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(text: Column) -> Column:
    """Text without leading and trailing white space of any kind (``trim`` takes spaces only). Null stays null."""
    return F.regexp_replace(text, r"^[\s\u00a0]+|[\s\u00a0]+$", "")


def truthy(text: Column) -> Column:
    """Null for empty text, else the text: ``coalesce(truthy(a), truthy(b))`` takes the first filled one."""
    return F.nullif(text, F.lit(""))


def filled(text: Column) -> Column:
    """Stripped text, null where nothing is left."""
    return truthy(strip(text))


def finite(text: Column) -> Column:
    """A finite double, null for everything else (also for numbers beyond the range of doubles)."""
    clean = strip(text.cast("string"))
    value = F.when(clean.rlike(NUMBER), clean.try_cast("double"))
    return F.when(F.abs(value) < float("inf"), value)


def shown(value: Column) -> Column:
    """Null as the word None, where a missing value is a group of its own."""
    return F.coalesce(value.cast("string"), F.lit("None"))


def stable_hash(prefix: str, *parts: Column, length: int = 24) -> Column:
    """``prefix_`` and the first hex digits of the SHA-256 of the parts; null differs from every text.

    Parts are escaped and joined with a separator, so ("a", "bc") and ("ab", "c") differ.
    """
    safe = [F.coalesce(F.concat(F.lit("="), F.regexp_replace(p.cast("string"), r"([\\|])", r"\\$1")), F.lit("~")) for p in parts]
    return F.concat(F.lit(prefix + "_"), F.substring(F.sha2(F.concat_ws("|", *safe), 256), 1, length))


def fixed(value: Column, digits: int) -> Column:
    """A number as text with a fixed number of decimals; the same on every engine."""
    return value.cast(f"decimal(28,{digits})").cast("string")


def sorted_distinct(values: Column) -> Column:
    """Aggregate: the distinct non-null values in code-point order."""
    return F.array_sort(F.collect_set(values))
