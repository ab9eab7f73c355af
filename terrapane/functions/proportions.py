"""Class proportions as MAP<INT, DOUBLE>, their text forms, and what is read from them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from terrapane.dims import CODES, LEGEND

PAIR = r"\"?'?(-?\d+)\"?'?\s*:\s*([0-9.eE+-]+)"


def text_to_map(text: Column) -> Column:
    """Either text form, {0: 1.0} or {"0": 1.0}."""
    keys = F.transform(F.regexp_extract_all(text, F.lit(PAIR), F.lit(1)), lambda k: k.cast("int"))
    values = F.transform(F.regexp_extract_all(text, F.lit(PAIR), F.lit(2)), lambda v: v.cast("double"))
    return F.when(text.isNotNull(), F.map_from_arrays(keys, values))


def map_to_json(props: Column) -> Column:
    """JSON with string keys, keys ascending."""
    items = F.array_sort(F.map_entries(props))
    return F.concat(F.lit("{"), F.array_join(F.transform(items, lambda e: F.concat(F.lit('"'), e["key"].cast("string"), F.lit('": '), e["value"].cast("string"))), ", "), F.lit("}"))


def is_all_zero(props: Column) -> Column:
    return (F.size(props) == 1) & (F.coalesce(F.try_element_at(props, F.lit(0)), F.lit(0.0)) == 1.0)


def share(props: Column, code: int) -> Column:
    return F.coalesce(F.try_element_at(props, F.lit(code)), F.lit(0.0))


def column_name(code: int) -> str:
    return f"lc_{code}"


def wide_columns(props: Column) -> list[Column]:
    """A column for each class of the legend, 0.0 where absent."""
    return [share(props, c).alias(column_name(c)) for c in CODES]


def entropy(values: list[Column]) -> Column:
    """Shannon entropy, base 2, of the values scaled to add up to 1; 0 if they add up to 0."""
    total = reduce(lambda a, b: a + b, values)
    terms = [F.when((v > 0) & (total > 0), -(v / total) * F.log2(v / total)).otherwise(F.lit(0.0)) for v in values]
    return reduce(lambda a, b: a + b, terms)


def majority(values: list[Column], names: list[str] | None = None) -> Column:
    """Name of the greatest; the first of equal ones."""
    names = names or [n for _, n in LEGEND]
    most = F.greatest(*values)
    return F.coalesce(*(F.when(v == most, F.lit(n)) for v, n in zip(values, names, strict=True)))
