"""Record conditions, direction policy and type routing as Column predicates."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tandem.functions.scalars import js_number, kind_of, text

#: Words and signs that a raw predicate may not hold.
FORBIDDEN = re.compile(r";|--|/\*|\b(insert|update|delete|upsert|union|merge)\b", re.I)
#: The operators of a condition.
OPERATORS = ["eq", "ne", "gt", "lt", "contains", "is_null", "is_not_null"]


@dataclass(frozen=True)
class Condition:
    """One comparison: eq, ne, gt, lt, contains, is_null or is_not_null."""

    field: str
    operator: str
    value: str | float | bool | None = None

    def column(self, df: DataFrame) -> Column:
        columns = df.columns
        c = F.col(self.field) if self.field in columns else F.lit(None).cast("string")
        value = "" if self.value is None else str(self.value).lower() if isinstance(self.value, bool) else str(self.value)
        if self.operator in ("is_null", "is_not_null"):
            return c.isNull() if self.operator == "is_null" else c.isNotNull()
        if self.operator in ("eq", "ne"):
            same = F.lower(text(c)) == value.lower()
            return same if self.operator == "eq" else ~same
        if self.operator == "contains":
            return F.contains(F.lower(text(c)), F.lit(value.lower()))
        if self.operator not in ("gt", "lt"):
            raise ValueError(f"unknown operator {self.operator}")
        if self.value is None or self.field not in columns:
            return F.lit(False)
        kind = kind_of(df.schema[self.field].dataType)
        own = c.cast("int").cast("double") if kind == "boolean" else c.cast("double") if kind == "number" else js_number(c)
        left = F.when(c.isNull(), F.lit(0.0)).otherwise(own)
        right = F.lit(float(self.value)) if isinstance(self.value, (bool, int, float)) else js_number(F.lit(value))
        return F.coalesce(left > right if self.operator == "gt" else left < right, F.lit(False))


def matches(conditions: list[Condition], df: DataFrame) -> Column:
    """Whether all conditions hold for a row of df; none always do."""
    return reduce(lambda a, b: a & b, [c.column(df) for c in conditions], F.lit(True))


def raw(predicate: str) -> Column:
    """A predicate given as text, of at most 500 characters and without statements."""
    if len(predicate) > 500 or FORBIDDEN.search(predicate):
        raise ValueError("the predicate is too long or holds a forbidden word")
    return F.expr(predicate)


def direction_allows(direction: Column, enabled: Column, system: Column) -> Column:
    """Whether a change in a system may be carried over: both, a_to_b or b_to_a."""
    return F.coalesce(enabled & ((direction == "both") | (direction == F.when(system == "a", "a_to_b").otherwise("b_to_a"))), F.lit(False))


def route(df: DataFrame, candidates: list[tuple[str, list[Condition]]]) -> DataFrame:
    """Adds the first type whose conditions hold; rows of no type go. A single type without conditions needs no test."""
    kind = F.lit(None).cast("string")
    for name, conditions in reversed(candidates):
        kind = F.when(matches(conditions, df), name).otherwise(kind)
    return df.withColumn("type", kind).where(F.col("type").isNotNull())


def missing_required(df: DataFrame, required: list[str]) -> DataFrame:
    """Rows in which a required field is null or empty, and which fields those are."""
    blank = F.array_compact(F.array(*[F.when(text(F.col(c)) == "", F.lit(c)) for c in required]))
    return df.withColumn("missing", blank).where(F.size("missing") > 0)


def refused_conditions(conditions: DataFrame, systems: list[str]) -> DataFrame:
    """Saved conditions (system, field, operator, raw) with why each may not be saved, null if it may.

    A row holds a field and an operator, or a raw predicate, which only the first system takes.
    """
    blank = F.trim(F.coalesce("field", F.lit(""))) == ""
    unsafe = (F.length("raw") > 500) | F.col("raw").rlike("(?i)" + FORBIDDEN.pattern)
    why = (
        F.when(~F.coalesce(F.col("system").isin(systems), F.lit(False)), "unknown_system").when(F.col("raw").isNotNull() & (F.col("system") != systems[0]), "raw_not_supported")
        .when(unsafe, "unsafe_raw").when(F.col("raw").isNotNull(), None).when(blank | (F.length("field") > 200), "field")
        .when(~F.coalesce(F.col("operator").isin(OPERATORS), F.lit(False)), "operator")
    )
    return conditions.withColumn("refused", why)
