"""What a poll of one type in one system finds, and which poll settings may be saved."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tandem.operators.predicates import Condition, matches
from tandem.operators.reconcile import kept_deletions
from tandem.operators.settings import cron_fields
from tandem.sources.discovery import polled_changes

#: Least and most minutes between polls, least and most days that the first one looks back.
MINUTES, DAYS = (1, 43_200), (1, 365)


def found(records: DataFrame, deleted: DataFrame, since: Column, system: str, type_: str, conditions: list[Condition] | None = None, links: DataFrame | None = None, changed: str = "modified", gone_at: str = "deleted_at") -> DataFrame:
    """Change events of records changed, and of records (id, deleted_at) deleted, since a moment; each known by what and when, so that polls may overlap.

    Deleted records have no fields to test conditions on. Where several types share the native object, links (source_id, type) tell which deletions are this
    type's: one that is linked as another type goes.
    """
    changes = records.where(F.col(changed) >= since)
    changes = changes.where(matches(conditions, records)) if conditions else changes
    gone = deleted.where(F.col(gone_at) >= since)
    if links is not None:
        gone = kept_deletions(gone, links, type_)
    return polled_changes(changes, system, type_, "id", changed).unionByName(polled_changes(gone, system, type_, "id", gone_at, deleted=True))


def refused(settings: DataFrame, known: DataFrame) -> DataFrame:
    """Poll settings (type, enabled, interval_minutes, lookback_days, cron) with why each may not be saved, null if it may; known: (type).

    Schedules repeat: each distinct one is read once.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            yield rows[[cron_fields(c) is None for c in rows["cron"]]]

    unfit = settings.where(F.coalesce("cron", F.lit("")) != "").select("cron").distinct().mapInPandas(read, "cron string").withColumn("_unfit", F.lit(True))
    between = lambda c, span: F.coalesce(F.col(c).between(*span), F.lit(False))
    why = (
        F.when(F.col("_known").isNull(), "unknown_type").when(F.col("enabled").isNull(), "enabled").when(~between("interval_minutes", MINUTES), "interval_minutes")
        .when(F.col("lookback_days").isNotNull() & ~between("lookback_days", DAYS), "lookback_days").when(F.col("_unfit"), "cron")
    )
    found = settings.join(known.select("type", F.lit(True).alias("_known")).distinct(), "type", "left").join(unfit, "cron", "left")
    return found.withColumn("refused", why).select(*settings.columns, "refused")
