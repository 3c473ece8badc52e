"""Settings by type, schedules and the registry of objects: small frames that are laid over each other."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timedelta

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tandem.functions.scalars import clamped_interval

#: The five fields of a schedule with their ranges.
CRON = (("minute", 0, 59), ("hour", 0, 23), ("day", 1, 31), ("month", 1, 12), ("weekday", 0, 7))
NAMES = {n: i for names, first in (("sun mon tue wed thu fri sat", 0), ("jan feb mar apr may jun jul aug sep oct nov dec", 1)) for i, n in enumerate(names.split(), first)}


def overlaid(defaults: DataFrame, saved: DataFrame, key: str = "type", required: tuple[str, ...] = (), fallback: dict | None = None) -> DataFrame:
    """Defaults with saved rows laid over them, value by value, and fallback values under both; what still lacks a required value after that goes."""
    values = [c for c in defaults.columns if c != key]
    new = saved.select(key, *[F.col(c).alias(f"_{c}") for c in values])
    merged = defaults.join(new, key, "full").select(key, *[F.coalesce(f"_{c}", c, F.lit((fallback or {}).get(c))).alias(c) for c in values])
    return merged.dropna(subset=list(required)) if required else merged


def patched(current: DataFrame, patch: DataFrame, key: str = "type", clearable: tuple[str, ...] = ()) -> DataFrame:
    """Current settings with the given values of a patch, and its new types. A null leaves what is there; an empty text clears a value that may be cleared."""
    values = [c for c in patch.columns if c != key]
    new = patch.select(key, *[F.col(c).alias(f"_{c}") for c in values])
    value = lambda c: F.when(F.col(f"_{c}") == "", None).otherwise(F.coalesce(f"_{c}", c)) if c in clearable else F.coalesce(f"_{c}", c)
    return current.join(new, key, "full").select(*[value(c).alias(c) if c in values else F.col(c) for c in current.columns])


def positioned(rules: DataFrame, by: str, order: str, out: str = "sort_order") -> DataFrame:
    """Adds the place of each row among those of its type, from 0."""
    return rules.withColumn(out, F.row_number().over(Window.partitionBy(by).orderBy(order)) - 1)


def by_native(registry: DataFrame, records: DataFrame) -> DataFrame:
    """Records (system, native) with every canonical type registered for them; shared tells that there are several."""
    of = registry.groupBy("system", "native").agg(F.array_sort(F.collect_set("type")).alias("types"))
    return records.join(of, ["system", "native"], "left").withColumn("shared", F.coalesce(F.size("types") > 1, F.lit(False)))


def _values(part: str, low: int, high: int) -> set[int]:
    out: set[int] = set()
    for piece in part.split(","):
        span, _, step = piece.partition("/")
        first, _, last = span.partition("-")
        number = lambda x: NAMES[x.lower()] if x.lower() in NAMES else int(x)
        a = low if span == "*" else number(first)
        b = high if span == "*" or (step and not last) else number(last or first)
        if not (low <= a <= b <= high) or int(step or 1) < 1:
            raise ValueError(f"no schedule: {part}")
        out.update(range(a, b + 1, int(step or 1)))
    return out


def cron_fields(expression: str) -> dict[str, set[int]] | None:
    """The values of each field of a five-field schedule; null if it is none."""
    parts = expression.split()
    if len(parts) != len(CRON):
        return None
    try:
        found = {name: _values(p, low, high) for p, (name, low, high) in zip(parts, CRON)}
    except (ValueError, KeyError):
        return None
    return found | {"weekday": {w % 7 for w in found["weekday"]}, "any_day": set() if parts[2] != "*" and parts[4] != "*" else {1}}


def next_times(expression: str, now: datetime, n: int = 1) -> list[datetime]:
    """The next n times of a schedule after now, within five years; none if it is no schedule. Where day and weekday are both given, either fits."""
    f, out = cron_fields(expression), []
    day = now.replace(hour=0, minute=0, second=0, microsecond=0)
    for _ in range(366 * 5 if f else 0):
        hits = [day.day in f["day"], (day.weekday() + 1) % 7 in f["weekday"]]
        if day.month in f["month"] and (all(hits) if f["any_day"] else any(hits)):
            times = (day.replace(hour=h, minute=m) for h in sorted(f["hour"]) for m in sorted(f["minute"]))
            out += [t for t in times if t > now][: n - len(out)]
        if len(out) >= n:
            break
        day += timedelta(days=1)
    return out


def next_due(schedules: DataFrame, now: datetime) -> DataFrame:
    """Adds when each schedule (enabled, cron, interval_minutes, ...) is due next: its cron time, or now and its interval. Each distinct cron text is read once, in tasks."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            yield pd.DataFrame({"cron": rows["cron"], "_at": pd.Series([next((t for t in next_times(c, now)), None) for c in rows["cron"]], dtype="datetime64[ns]")})

    times = schedules.where("cron is not null").select("cron").distinct().mapInPandas(read, "cron string, _at timestamp_ntz")
    at = F.lit(now).cast("timestamp_ntz")
    after = F.timestamp_add("MINUTE", clamped_interval(F.col("interval_minutes")), at)
    return schedules.join(times, "cron", "left").withColumn("next_due_at", F.coalesce("_at", after)).drop("_at")


def due(schedules: DataFrame, now: datetime) -> DataFrame:
    """Enabled schedules whose time has come."""
    return schedules.where(F.col("enabled") & (F.col("next_due_at") <= F.lit(now).cast("timestamp_ntz")))


def overview(tenants: DataFrame, subscriptions: DataFrame, members: DataFrame) -> DataFrame:
    """Tenants with their plan (a subscription's goes before the tenant's own) and the size of their team."""
    team = members.groupBy("tenant").agg(F.count("*").alias("members"))
    held = subscriptions.select("tenant", F.col("plan").alias("_plan"), F.col("status").alias("_status"))
    rows = tenants.join(held, "tenant", "left").join(team, "tenant", "left")
    return rows.select("tenant", F.coalesce("_plan", "plan").alias("plan"), F.coalesce("_status", F.lit("none")).alias("status"), F.coalesce("members", F.lit(0)).cast("long").alias("members"))


def of_tenant(df: DataFrame, tenant) -> DataFrame:
    """Rows of one tenant only; on a table partitioned by tenant the others are not read."""
    return df.where(F.col("tenant") == F.lit(tenant))


def with_setting(saved: Column, name: str, value: Column) -> Column:
    """Settings kept as a JSON object, with one of them replaced or added by a value given as JSON; the others stay as they are. Null settings stay null."""
    held = F.from_json(saved, "map<string,variant>")
    others = F.map_filter(held, lambda k, _: k != name)
    return F.to_json(F.map_concat(others, F.create_map(F.lit(name), F.parse_json(value))))
