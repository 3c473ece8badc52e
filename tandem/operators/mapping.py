"""Field rules and value maps, compiled to projections."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tandem.functions.scalars import TRANSFORMS, kind_of


@dataclass(frozen=True)
class FieldRule:
    """How a canonical field is read from a native path and written back to it."""

    canonical: str
    native: str
    read: str = "identity"
    write: str = "identity"
    read_only: bool = False


@dataclass(frozen=True)
class ValueMap:
    """Canonical and native values of a field; of repeated natives or canonicals the first counts."""

    field: str
    pairs: tuple[tuple[str, str], ...]

    def _lookup(self, pairs: Iterable[tuple[str, str]], c: Column) -> Column:
        first: dict[str, str] = {}
        for k, v in pairs:
            first.setdefault(k, v)
        table = F.create_map(*[F.lit(x) for kv in first.items() for x in kv])
        return F.coalesce(F.try_element_at(table, c), c) if first else c

    def to_canonical(self, c: Column) -> Column:
        return self._lookup(((n, k) for k, n in self.pairs), c)

    def to_native(self, c: Column) -> Column:
        return self._lookup(self.pairs, c)


def to_canonical(df: DataFrame, rules: list[FieldRule], values: tuple[ValueMap, ...] = (), keep: tuple[str, ...] = ("id",)) -> DataFrame:
    """Every ruled field: path, transform, then value map; a path that the table lacks gives null."""
    maps = {v.field: v for v in values}
    out = []
    for r in rules:
        there = r.native.split(".")[0] in df.columns
        c = TRANSFORMS[r.read](F.col(r.native), kind_of(df.select(r.native).schema[0].dataType)) if there else F.lit(None).cast("string")
        out.append((maps[r.canonical].to_canonical(c) if r.canonical in maps else c).alias(r.canonical))
    return df.select(*keep, *out)


def from_canonical(df: DataFrame, rules: list[FieldRule], values: tuple[ValueMap, ...] = (), keep: tuple[str, ...] = ("id",)) -> DataFrame:
    """Writable native fields: value map, then transform; read-only, nested and absent fields are not emitted."""
    maps = {v.field: v for v in values}
    out = []
    for r in rules:
        if r.read_only or "." in r.native or r.canonical not in df.columns:
            continue
        c = maps[r.canonical].to_native(F.col(r.canonical)) if r.canonical in maps else F.col(r.canonical)
        out.append(TRANSFORMS[r.write](c, kind_of(df.schema[r.canonical].dataType)).alias(r.native))
    return df.select(*keep, *out)


def native_fields(rules: list[FieldRule], without: tuple[str, ...] = ("id", "lastmodifieddate")) -> list[str]:
    """Columns to read: each once, whatever its case, in order of the rules."""
    seen: dict[str, str] = {}
    for r in rules:
        if r.native.lower() not in without:
            seen.setdefault(r.native.lower(), r.native)
    return list(seen.values())


def native_field(rules: list[FieldRule], canonical: str) -> str | None:
    """The native field of a canonical one: that of the first rule."""
    return next((r.native for r in rules if r.canonical == canonical), None)


#: What a record of each type is called by, the first that is not empty; a pair is put together.
LABELS: dict[str, tuple] = {"contact": (("firstName", "lastName"), "email"), "company": ("name", "domain"), "deal": ("name",)}


def labelled(df: DataFrame, kind: str, record_id: str = "id") -> DataFrame:
    """Adds what each record is called; columns that are absent are passed over, the id is last."""
    filled = lambda c: F.nullif(F.trim(c), F.lit(""))
    choices = []
    for names in LABELS.get(kind, ("name",)):
        there = [F.nullif(F.col(n), F.lit("")) for n in ((names,) if isinstance(names, str) else names) if n in df.columns]
        choices += [filled(F.concat_ws(" ", *there))] if there else []
    return df.withColumn("label", F.coalesce(*choices, F.col(record_id)))
