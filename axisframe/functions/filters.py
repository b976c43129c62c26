"""The predicate language over named fields: ``<field><operator><value>``, with wildcards in the field."""

from __future__ import annotations

import fnmatch
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from axisframe.functions.predicates import conjunction, disjunction

OPERATORS = (">=", "<=", "==", "!=", ">", "<", "=")
_OPERATOR = re.compile("|".join(OPERATORS))


def parse_filter(text: str) -> tuple[str, str, str]:
    """(field, operator, value); exactly one operator, blanks around it ignored."""
    found = _OPERATOR.findall(text)
    if len(found) != 1:
        raise ValueError(f"a filter needs exactly one operator: {text!r}")
    field, value = (x.strip() for x in text.split(found[0]))
    return field, "==" if found[0] == "=" else found[0], value


def _number(text: str) -> float | None:
    try:
        return float(text)
    except ValueError:
        return None


def compare(value: Column, operator: str, text: str, strict: bool = False) -> Column:
    """Equality by number if both sides are numbers, else as text; order by number.

    A field that is no number is before and after nothing, or an error if ``strict``.
    """
    number, other = value.try_cast("double"), _number(text)
    if operator in ("==", "!="):
        same = value == F.lit(text)
        if other is not None:
            same = F.when(number.isNotNull(), number == F.lit(other)).otherwise(same)
        return same if operator == "==" else ~same
    if other is None:
        raise ValueError(f"{text!r} is no number to compare with {operator}")
    test = {">": number > other, "<": number < other, ">=": number >= other, "<=": number <= other}[operator]
    otherwise = F.raise_error(F.concat(F.lit(f"no number to compare with {operator}{text}: "), value)) if strict else F.lit(False)
    return F.coalesce(test, otherwise)


def field_filter(fields: Column, text: str, combine: str, strict: bool = False) -> Column:
    """One filter on a map of fields; a wildcard that matches no field is false, whatever it is combined by."""
    name, operator, value = parse_filter(text)
    chosen = F.map_filter(fields, lambda k, _: k.rlike(fnmatch.translate(name)))
    test = lambda v: compare(v, operator, value, strict)
    hits = F.exists(F.map_values(chosen), test) if combine == "ANY" else F.forall(F.map_values(chosen), test)
    return (F.size(chosen) > 0) & hits


def keep_features(df: DataFrame, fields: str = "fields", all_of: list[str] = (), any_of: list[str] = (), strict: bool = False) -> DataFrame:
    """Rows that pass all of the first list and, if there is one, any of the second."""
    m = F.col(fields)
    every = conjunction([field_filter(m, f, "ALL", strict) for f in all_of])
    some = disjunction([field_filter(m, f, "ANY", strict) for f in any_of]) if any_of else F.lit(True)
    return df.where(every & some)
