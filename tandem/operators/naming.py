"""Names for things by their labels: each gets the first free one of base, base_2, base_3 and so on, in order.

A label may come to another one's name: "deal 2" asks for deal_2, which the second "deal" would get. Who comes first has it. Seen
from one base, whose labels take its numbers upward, that is a claim on a number at a moment: it holds if the labels before that
moment have not come so far. Claims are looked at by rising number, with a count of those that held, and what is free decides for all labels at
once: the label at place j gets the j-th number that is neither taken nor claimed. Bases are looked at from the shortest on, as a
claim tells the claiming base whether its own bare name is free.

Places are counted over ranges of the sorted labels, so a base with many labels (a blank one, say) is spread over tasks. What meets
in one row are the taken and claimed numbers of one base.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tandem.functions.scalars import slug
from tandem.sources.stores import saved

#: A name that could be the numbered form of another one: its base and its number, which begins with no zero and is 2 or more.
_NUMBERED = "^(.+)_([2-9]|[1-9][0-9]{1,17})$"


def _parent(name: Column) -> tuple[Column, Column]:
    """The base and the number of a numbered name, null for others."""
    numbered = name.rlike(_NUMBERED)
    return F.when(numbered, F.regexp_extract(name, _NUMBERED, 1)), F.when(numbered, F.regexp_extract(name, _NUMBERED, 2).cast("long"))


def _counted(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Adds _before: how many rows with _real come before a row among those of its key; keys may be of any size."""
    placed = saved(rows.repartitionByRange(key, order).withColumn("_part", F.spark_partition_id()), "naming-places")
    own = F.sum(F.col("_real").cast("long")).over(Window.partitionBy("_part", key).orderBy(order, "_real").rowsBetween(Window.unboundedPreceding, -1))
    sums = placed.groupBy("_part", key).agg(F.sum(F.col("_real").cast("long")).alias("_n"))  # as many rows as ranges and keys
    offset = F.sum("_n").over(Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sums.select("_part", key, F.coalesce(offset, F.lit(0)).alias("_offset"))
    return placed.withColumn("_own", F.coalesce(own, F.lit(0))).join(offsets, ["_part", key]).withColumn("_before", F.col("_own") + F.col("_offset")).drop("_part", "_own", "_offset")


def _held(claims: Column, taken: Column) -> Column:
    """The numbers of claims (n, before, by rising n) that hold: those not taken that the labels before them have not come to."""
    start = F.struct(F.array().cast("array<bigint>").alias("held"))

    def look(state: Column, claim: Column) -> Column:
        below = claim["n"] - 1 - F.size(F.filter(taken, lambda t: t < claim["n"])) - F.size(state["held"])
        free = ~F.array_contains(taken, claim["n"]) & (claim["before"] <= below)
        return F.struct(F.when(free, F.concat(state["held"], F.array(claim["n"]))).otherwise(state["held"]).alias("held"))

    return F.aggregate(claims, start, look)["held"]


def named(df: DataFrame, label: str, order: str, taken: DataFrame | None = None, out: str = "slug") -> DataFrame:
    """Adds the name of each label, free of those in taken (column slug) and of each other, as a loop in the order of a unique column would give them.

    A label without letters and digits is called object. Null labels are blank ones.
    """
    spark = df.sparkSession
    taken = taken.select("slug").distinct() if taken is not None else spark.createDataFrame([], "slug string")
    base = F.coalesce(F.nullif(slug(F.col(label)), F.lit("")), F.lit("object"))
    labels = saved(df.select(F.col(order).alias("_order"), base.alias("_base")), "naming-labels")
    up, number = _parent(F.col("_base"))
    firsts = labels.groupBy("_base").agg(F.min("_order").alias("_order"))
    asks = firsts.select(up.alias("_key"), "_order", F.lit(False).alias("_real"), number.alias("_n"), F.col("_base").alias("_child")).where("_key is not null")
    asks = asks.join(firsts.select(F.col("_base").alias("_key")), "_key", "left_semi")  # a base without labels takes no numbers
    rows = labels.select(F.col("_base").alias("_key"), "_order", F.lit(True).alias("_real"), F.lit(None).cast("long").alias("_n"), F.lit(None).cast("string").alias("_child"))
    counted = saved(_counted(rows.unionByName(asks), "_key", "_order"), "naming-counted")

    numbers = lambda c: F.array_sort(F.collect_set(c))
    slug_up, slug_number = _parent(F.col("slug"))
    bare = taken.select(F.col("slug").alias("_key"), F.lit(1).cast("long").alias("_t"))
    used = bare.unionByName(taken.select(slug_up.alias("_key"), slug_number.alias("_t")).where("_key is not null")).groupBy("_key").agg(numbers("_t").alias("_taken"))
    claims = counted.where(~F.col("_real")).groupBy("_key").agg(F.array_sort(F.collect_list(F.struct(F.col("_n").alias("n"), F.col("_before").alias("before")))).alias("_claims"))
    depth = F.when(up.isNull(), 0)
    name = up
    for i in range(1, 8):
        higher, _ = _parent(name)
        depth, name = depth.when(higher.isNull(), i), higher
    none, no_claims = F.array().cast("array<bigint>"), F.array().cast("array<struct<n:bigint,before:bigint>>")
    bases = firsts.select("_base", up.alias("_up"), number.alias("_n"), depth.otherwise(8).alias("_depth")).join(used.withColumnRenamed("_key", "_base"), "_base", "left").join(claims.withColumnRenamed("_key", "_base"), "_base", "left")
    bases = saved(bases.withColumns({"_taken": F.coalesce("_taken", none), "_claims": F.coalesce("_claims", no_claims)}), "naming-bases")
    deepest = bases.agg(F.max("_depth")).first()[0]
    if deepest == 8:
        raise ValueError("a label ends in more than seven numbers")
    settled = None
    for level in range((deepest or 0) + 1):
        now = bases.where(F.col("_depth") == level)
        if settled is None:
            now = now.withColumn("_lost", F.lit(False))
        else:
            above = settled.select(F.col("_base").alias("_up"), F.col("_held").alias("_upper"))
            now = now.join(above, "_up", "left").withColumn("_lost", F.col("_upper").isNotNull() & ~F.array_contains(F.coalesce("_upper", none), F.col("_n"))).drop("_upper")
        now = now.withColumn("_taken", F.when(F.col("_lost"), F.array_sort(F.array_union("_taken", F.array(F.lit(1).cast("long"))))).otherwise(F.col("_taken")))
        now = now.withColumn("_held", _held(F.col("_claims"), F.col("_taken"))).select("_base", "_taken", "_held")
        settled = saved(now if settled is None else settled.unionByName(now), "naming-settled")
    gone = settled.select("_base", F.array_sort(F.array_union("_taken", "_held")).alias("_gone"))
    gone = gone.select("_base", F.transform("_gone", lambda x, i: x - 1 - i).alias("_free"))  # how many numbers are free below each one that is not
    places = counted.where("_real").select(F.col("_key").alias("_base"), "_order", (F.col("_before") + 1).alias("_place")).join(gone, "_base")
    at = F.col("_place") + F.size(F.filter("_free", lambda f: f < F.col("_place")))
    found = places.select("_order", F.when(at == 1, F.col("_base")).otherwise(F.concat_ws("_", "_base", at.cast("string"))).alias(out))
    return df.join(found, df[order] == found["_order"]).drop("_order")
