"""Separation of records that fail to parse from those that load.

Cells of every record are exploded to (row, column, value) and joined to a rule table; a cell that
breaks a rule gives (row, rule). Errors are aggregated per row (the rule of lowest rank wins), and clean
rows are those without any. Only broken cells are shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """``column`` is 1-based, 0 stands for the whole record; ``peer`` is a second column the test may need."""

    rank: int
    column: int
    kind: str
    reason: str
    arg: str | None = None
    peer: int | None = None


#: A feature line has nine columns; reasons in the order in which they apply.
FEATURE_RULES = [
    Rule(1, 0, "arity", "columns", arg="9"),
    Rule(2, 1, "member", "seqid"),
    Rule(3, 4, "digits_upto", "start", peer=5),
    Rule(4, 9, "even_quotes", "quoting", arg='"'),
]


def _digits_above(a: Column, b: Column) -> Column:
    """a > b for digit strings of any length; false where b is not written in digits."""
    strip = lambda x: F.regexp_replace(x, "^0+", "")
    x, y = strip(a), strip(b)
    above = (F.length(x) > F.length(y)) | ((F.length(x) == F.length(y)) & (x > y))
    return b.rlike("^[0-9]+$") & above


def _breaks() -> Column:
    value, arg = F.coalesce(F.col("value"), F.lit("")), F.col("arg")
    digits = value.rlike("\\A[0-9]+\\z")
    below_one = value.rlike("\\A0+\\z")
    quotes = F.length(value) - F.length(F.replace(value, arg, F.lit("")))
    return (
        F.when(F.col("kind") == "arity", value != arg)
        .when(F.col("kind") == "digits_upto", ~digits | below_one | _digits_above(value, F.coalesce(F.col("peer_value"), F.lit(""))))
        .when(F.col("kind") == "even_quotes", quotes % 2 == 1)
    )


def is_record(line: Column) -> Column:
    """Not null, not blank and no comment or directive."""
    return F.coalesce(F.length(F.regexp_replace(line, "\\s", "")) > 0, F.lit(False)) & ~line.startswith("#")


def cells(df: DataFrame, keys: list[str], line: str, rules: list[Rule], sep: str = "\t") -> DataFrame:
    """(keys, column, value, peer_value) of every record; column 0 holds the number of columns."""
    parts = df.select(*keys, F.split(F.col(line), sep, -1).alias("_cells"))
    parts = parts.select(*keys, F.array_insert("_cells", 1, F.size("_cells").cast("string")).alias("_cells"))
    peers = {r.column: r.peer for r in rules if r.peer}
    each = parts.select(*keys, "_cells", F.posexplode("_cells").alias("column", "value"))
    peer = F.lit(None).cast("string")
    for column, p in peers.items():
        peer = F.when(F.col("column") == column, F.get("_cells", F.lit(p))).otherwise(peer)
    return each.select(*keys, "column", "value", peer.alias("peer_value"))


def _errors(records: DataFrame, keys: list[str], line: str, members: DataFrame, rules: list[Rule]) -> DataFrame:
    """(keys, reason) of records (each with ``keys``) that break a rule, the one of lowest rank."""
    schema = "rank int, column int, kind string, reason string, arg string"
    # The rule table is a constant of this module's size, never of the data's.
    table = F.broadcast(records.sparkSession.createDataFrame([(r.rank, r.column, r.kind, r.reason, r.arg) for r in rules], schema))
    judged = cells(records, keys, line, rules).join(table, "column")
    known = members.select(F.col(members.columns[0]).alias("value")).where("value is not null").distinct()
    # Membership is an anti-join of the cells it concerns; no other cell travels for it.
    strangers = judged.where("kind = 'member'").join(known, "value", "left_anti")
    broken = judged.where("kind <> 'member'").where(_breaks()).select(*keys, "rank", "reason")
    broken = broken.unionByName(strangers.select(*keys, "rank", "reason"))
    return broken.groupBy(*keys).agg(F.min_by("reason", "rank").alias("reason"))


def rule_errors(df: DataFrame, row: str, line: str, members: DataFrame, rules: list[Rule] = FEATURE_RULES) -> DataFrame:
    """(row, reason) of every record that breaks a rule; ``members`` is one column of allowed values.

    Null, blank and comment lines are no records. Where column 5 is no number nothing is above it.
    A row id given twice is judged once; two different lines under one id give the lower-ranked reason.
    """
    records = df.where(is_record(F.col(line))).select(F.col(row).alias("_row"), F.col(line).alias("_line"))
    return _errors(records, ["_row"], "_line", members, rules).select(F.col("_row").alias(row), "reason")


FEATURE_COLUMNS = ["seqid", "source", "type", "start", "end_pos", "score", "strand", "phase", "attributes"]


def clean_rows(df: DataFrame, row: str, line: str, members: DataFrame, rules: list[Rule] = FEATURE_RULES, sep: str = "\t") -> DataFrame:
    """The records that break no rule, split into typed feature columns (carriage returns at the end dropped).

    A record is a row id and a line: repeated ones come out once, and a faulty line does not take others of its id with it.
    """
    records = df.where(is_record(F.col(line))).select(F.col(row).alias("_row"), F.col(line).alias("_line"))
    errors = _errors(records, ["_row", "_line"], "_line", members, rules).select(F.col("_row").alias("_bad"), F.col("_line").alias("_bad_line"))
    good = records.join(errors, F.col("_row").eqNullSafe(F.col("_bad")) & (F.col("_line") == F.col("_bad_line")), "left_anti").distinct()
    good = good.select("_row", F.split(F.regexp_replace("_line", "\r+$", ""), sep, -1).alias("_c"))
    columns = [F.get("_c", F.lit(i)).alias(n) for i, n in enumerate(FEATURE_COLUMNS)]
    typed = good.select(F.col("_row").alias(row), *columns)
    return typed.withColumns({n: F.expr(f"try_cast({n} as bigint)") for n in ("start", "end_pos")})
