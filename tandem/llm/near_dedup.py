"""MinHash near-dedup with SetSketch registers.

A document is the set of its distinct word shingles. A register is the truncated, exponentially spaced minimum of an
exponential hash over the set: floor(1 - log_b(min)), clipped. Registers of a union are the larger ones, and equal
registers tell of similar sets. Rows with equal sets are one vertex, which has a number and the text of one of these rows; ids
only name components, so rows that share an id but not a set are apart.

1. Bands of registers put vertices into buckets. In each bucket, every vertex is paired with the smallest one only, so a
   bucket of any size gives as many pairs as it has vertices.
2. Pairs are estimated jointly by likelihood from how many registers are larger, smaller and equal, and from the exact
   set sizes; what is far below the threshold goes, the rest is verified on full sets. Links give components.
3. Buckets that still hold several components may hide links between vertices that were not paired. All their vertices
   go through an exact prefix-filter join: two sets of similarity t share one of their (1 - t) rarest shingles, and the
   first that they share leaves enough behind it in both. Of a shingle with many holders, those outside its main component are
   first compared with that component in blocks, which write links only, and components are taken again; then the pairs between
   other components are verified, and components taken once more.

With 4 registers in each of 32 bands, two sets of similarity 0.8 meet in no bucket with a chance of 4 in 10**8.

Null and blank texts have an empty set and stay alone. A null id stays null and counts as the lowest one, so a component with such a row has
none as its name. Repeated rows are copies, and rows of one id with different texts are vertices of their own. Other columns pass
through unchanged where documents are returned. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import components
from .tables import filled_id, lowest_id, map_arrow, save
from .words import MULT, mix, shingle_sets

#: Fixed values of the sketch: base, rate and limit of the registers as published, registers in a band, bands.
BASE, RATE, LIMIT = 1.001, 20.0, 65534
WIDTH, BANDS = 4, 32
REGISTERS = WIDTH * BANDS
#: Holders of a rare shingle that one task compares with all of them.
PART = 256
#: Holders above which a shingle's main component is compared in blocks; shingles of either side of a block; passes over them.
HOT, BLOCK, PASSES = 64, 2**16, 4
#: How far below the threshold an estimate may lie: five standard deviations of it at 0.8.
SLACK = 5 * (0.8 * 0.2 / REGISTERS) ** 0.5

_rng = np.random.default_rng(5)
LOW = _rng.integers(0, 2**31, REGISTERS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
HIGH = _rng.integers(0, 2**31, REGISTERS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def registers(found: np.ndarray) -> np.ndarray:
    """The registers of a set of 64-bit hashes."""
    low, high = found.astype(np.uint32), (found >> np.uint64(32)).astype(np.uint32)
    least = np.full(REGISTERS, 2**32 - 1, np.uint32)
    for a in range(0, len(found), 1024):
        x = low[a : a + 1024, None] * LOW + high[a : a + 1024, None] * HIGH
        x ^= x >> np.uint32(15)
        x *= np.uint32(0x85EBCA6B)
        np.minimum(least, x.min(axis=0), out=least)
    smallest = -np.log1p(-(least + 0.5) / 2.0**32) / RATE
    return np.clip(np.floor(1 - np.log(smallest) / np.log(BASE)), 0, LIMIT + 1).astype(np.uint16)


def bands(regs: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band; the band's number is part of it."""
    keys = np.arange(BANDS, dtype=np.uint64)
    for j in range(WIDTH):
        keys = mix(keys * np.uint64(MULT) + regs.reshape(BANDS, WIDTH)[:, j].astype(np.uint64))
    return keys.view(np.int64)


def estimate(larger: np.ndarray, smaller: np.ndarray, sizes_a: np.ndarray, sizes_b: np.ndarray) -> np.ndarray:
    """Maximum-likelihood similarity of pairs, from the numbers of registers in which a is larger and smaller."""
    u = sizes_a / (sizes_a + sizes_b)
    v = 1 - u
    low, high = np.zeros(len(u)), np.minimum(u / v, v / u)
    p = lambda x: -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)
    same = REGISTERS - larger - smaller

    def likelihood(j):
        up, down = p(u - v * j), p(v - u * j)
        tiny = 1e-12
        return larger * np.log(up + tiny) + smaller * np.log(down + tiny) + same * np.log(np.maximum(1 - up - down, 0) + tiny)

    for _ in range(40):
        a, b = low + (high - low) / 3, high - (high - low) / 3
        left = likelihood(a) < likelihood(b)
        low, high = np.where(left, a, low), np.where(left, high, b)
    return (low + high) / 2


def sketches(docs: DataFrame, k: int, text_col: str) -> DataFrame:
    """(_id, digest of the text, n, set key, registers, bands) of documents that have _id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [t or b"" for t in part.column(1).cast(pa.binary()).to_pylist()]
                sets = shingle_sets(texts, k)
                regs = [registers(s) if len(s) else None for s in sets]
                digest = [hashlib.md5(s.tobytes()).digest() if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([hashlib.md5(t).digest() for t in texts], pa.binary()), pa.array([len(s) for s in sets], pa.int64()), pa.array(digest, pa.binary()), pa.array([r if r is None else r.tobytes() for r in regs], pa.binary()), pa.array([r if r is None else bands(r).tolist() for r in regs], pa.list_(pa.int64()))],
                    names=["_id", "digest", "n", "key", "regs", "bands"],
                )

    kind = docs.schema["_id"].dataType.simpleString()
    return map_arrow(docs.select("_id", F.col(text_col).cast("string").alias("_text")), run, f"_id {kind}, digest binary, n long, key binary, regs binary, bands array<long>")


def likely(pairs: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) whose estimate does not rule them out."""
    regs = nodes.select("id", "n", "regs")
    both = pairs.join(regs.toDF("a", "na", "ra"), "a").join(regs.toDF("b", "nb", "rb"), "b")
    both = both.where((F.col("na") >= threshold * F.col("nb")) & (F.col("nb") >= threshold * F.col("na")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            na, nb = (batch.column(i).to_numpy().astype(float) for i in (2, 3))
            ra, rb = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint16).reshape(-1, REGISTERS) for i in (4, 5))
            good = estimate((ra > rb).sum(1), (ra < rb).sum(1), na, nb) >= threshold - SLACK
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(pa.array(good)) for i in (0, 1)], names=["a", "b"])

    kind = nodes.schema["id"].dataType.simpleString()
    return map_arrow(both.select("a", "b", "na", "nb", "ra", "rb"), run, f"a {kind}, b {kind}")


def verified(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Pairs (a, b) linked by their full sets."""
    # Many pairs share an a: its text comes last, where a join can split them, so that it is not sent once for each pair.
    both = pairs.join(texts.toDF("b", "tb"), "b").join(texts.toDF("a", "ta"), "a")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                columns = [part.column(i).cast(pa.binary()).to_pylist() for i in (2, 3)]
                known = dict.fromkeys(t for c in columns for t in c)
                known = dict(zip(known, shingle_sets(list(known), k)))
                one, two = ([known[t] for t in c] for c in columns)
                common = [len(np.intersect1d(x, y, assume_unique=True)) for x, y in zip(one, two)]
                good = [100 * c >= percent * (len(x) + len(y) - c) for x, y, c in zip(one, two, common)]
                yield pa.RecordBatch.from_arrays([part.column(i).filter(pa.array(good, pa.bool_())) for i in (0, 1)], names=["a", "b"])

    kind = texts.schema["id"].dataType.simpleString()
    return map_arrow(both.select("a", "b", "ta", "tb"), run, f"a {kind}, b {kind}")


def rare_prefixes(texts: DataFrame, labels: DataFrame, k: int, percent: int) -> DataFrame:
    """(id, component, n, s, at): the rarest shingles s of the sets in labels (id, component), by their place, where several components share one."""
    kind = texts.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                sets = shingle_sets(part.column(1).cast(pa.binary()).to_pylist(), k)
                rows = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
                take = lambda i: part.column(i).take(pa.array(rows))  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([take(0), take(2), pa.array(np.array([len(s) for s in sets])[rows], pa.int64()), pa.array(np.concatenate([*sets, np.empty(0, np.uint64)]).view(np.int64))], names=["id", "component", "n", "s"])

    rows = map_arrow(texts.join(labels, "id").select("id", "text", "component"), run, f"id {kind}, component {kind}, n long, s long")
    rows = save(rows, "rare-shingles")
    often = rows.groupBy("s").agg(F.count("*").alias("often")).where("often > 1")
    # A set's prefix is its n - ceil(t n) + 1 rarest shingles; those that no other set has stand first and need no row.
    own = Window.partitionBy("id")
    counted = rows.join(often, "s").withColumn("place", F.row_number().over(own.orderBy("often", "s"))).withColumn("known", F.count("*").over(own))
    kept = counted.withColumn("at", F.col("place") + F.col("n") - F.col("known")).where(F.col("at") <= F.col("n") - F.ceil(F.col("n") * percent / 100) + 1)
    kept = save(kept.select("id", "component", "n", "s", "at"), "rare-kept")  # read twice below, so that sets are not ranked twice
    mixed = kept.groupBy("s").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("s")
    return save(kept.join(mixed, "s"), "rare-prefixes")


def main_components(kept: DataFrame) -> DataFrame:
    """(s, parts, main) of the shingles that several components hold: main is the one with the most holders, if s has more than HOT of them."""
    held = kept.groupBy("s", "component").agg(F.count("*").alias("held"))
    most = held.groupBy("s").agg(F.max(F.struct("held", "component")).alias("most"), F.sum("held").alias("all"), F.count("*").alias("mixed")).where("mixed > 1")
    return most.select("s", F.ceil(F.col("all") / PART).alias("parts"), F.when(F.col("all") > HOT, F.col("most.component")).alias("main"))


def links_to_main(kept: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Links (a, b) between the holders of a frequent shingle and its main component, at most one for each a and block of the component.

    The members of the component and the others meet in blocks of bounded size, where their sets are compared; no pair is written
    unless it is a link.
    """
    kind = texts.schema["id"].dataType.simpleString()
    hot = save(kept.join(main_components(kept).where(F.col("main").isNotNull()), "s").select("id", "component", "n", "main").distinct(), "near-frequent")
    inside = F.col("component") == F.col("main")
    counts = hot.groupBy("main").agg(F.ceil(F.sum(F.when(inside, F.col("n"))) / BLOCK).alias("parts"), F.ceil(F.sum(F.when(~inside, F.col("n"))) / BLOCK).alias("turns"))
    hot = hot.join(counts, "main")
    own = lambda c: F.pmod(F.xxhash64("id"), c)
    every = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    members = hot.where(inside).select("id", "main", own("parts").alias("part"), every("turns").alias("turn")).join(texts, "id")
    others = hot.where(~inside).select("id", "main", own("turns").alias("turn"), every("parts").alias("part")).join(texts, "id")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        ids = left["id"].to_pylist()
        sets = shingle_sets(left["text"].cast(pa.binary()).to_pylist(), k)
        sizes = np.array([len(s) for s in sets], np.int64)
        values, owners = np.concatenate([*sets, np.empty(0, np.uint64)]), np.repeat(np.arange(len(sets)), sizes)
        order = np.argsort(values, kind="stable")
        values, owners = values[order], owners[order]
        a, b = [], []
        for id_, text in zip(right["b"].to_pylist(), right["text_b"].cast(pa.binary()).to_pylist()):
            found = shingle_sets([text], k)[0]
            low, high = np.searchsorted(values, found, "left"), np.searchsorted(values, found, "right")
            runs = high - low
            at = np.repeat(low - np.cumsum(runs) + runs, runs) + np.arange(runs.sum())
            common = np.bincount(owners[at], minlength=len(sets))
            good = np.flatnonzero(100 * common >= percent * (sizes + len(found) - common)) if len(sets) else []
            if len(good):
                a.append(id_)
                b.append(ids[good[0]])
        return pa.table([pa.array(a, left.schema.field("id").type), pa.array(b, left.schema.field("id").type)], names=["a", "b"])

    left = members.select("main", "part", "turn", "id", "text").groupBy("main", "part", "turn")
    right = others.select("main", "part", "turn", "id", "text").toDF("main_b", "part_b", "turn_b", "b", "text_b").groupBy("main_b", "part_b", "turn_b")
    return left.cogroup(right).applyInArrow(run, f"a {kind}, b {kind}")


def rare_pairs(kept: DataFrame, percent: int, compared: bool) -> DataFrame:
    """Pairs of different components that share one of their rarest shingles: all that can be linked, without those that
    links_to_main has compared."""
    kept = kept.join(main_components(kept), "s")
    if compared:
        kept = kept.where(F.col("main").isNull() | (F.col("main") != F.col("component")))
    side = lambda x: [F.col(c).alias(f"{c}_{x}") for c in ("id", "component", "n", "at")]
    one = kept.select("s", F.pmod(F.xxhash64("id"), "parts").alias("part"), *side("a"))
    two = kept.select("s", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), *side("b"))
    # If s is the first that two sets share, no more can be shared than it and what follows it in either set.
    most = 1 + F.least(F.col("n_a") - F.col("at_a"), F.col("n_b") - F.col("at_b"))
    near = most * (100 + percent) >= (F.col("n_a") + F.col("n_b")) * percent
    apart = (F.col("id_a") < F.col("id_b")) & (F.col("component_a") != F.col("component_b"))
    return one.join(two, ["s", "part"]).where(apart & near).select(F.col("id_a").alias("a"), F.col("id_b").alias("b")).distinct()


def relabelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """rows (id, component, ...) with the components of labels (id, component)."""
    others = [c for c in rows.columns if c not in ("id", "component")]
    return rows.withColumnRenamed("component", "_old").join(labels, "id", "left").select("id", F.coalesce("component", "_old").alias("component"), *others)


def rest_of_links(links: DataFrame, labels: DataFrame, open_: DataFrame, texts: DataFrame, nodes: DataFrame, k: int, percent: int) -> DataFrame:
    """(id, component) by links and by all links between components of the open vertices (id, component)."""
    kept = rare_prefixes(texts, open_, k, percent)
    compared = False
    for _ in range(PASSES):
        found = save(links_to_main(kept, texts, k, percent), "near-links")
        compared = found.isEmpty()
        if compared:
            break
        links = save(links.union(found), "near-links")
        labels = save(components(links), "near-labels")
        kept = save(relabelled(kept, labels), "rare-prefixes")
    more = save(verified(likely(rare_pairs(kept, percent, compared), nodes, percent / 100), texts, k, percent), "near-links")
    return labels if more.isEmpty() else save(components(links.union(more)), "near-labels")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: (_id, n_shingles, component_id, kept), linked at 100 x intersection >= percent x union; component_id is the smallest id reachable, null if that is null."""
    lowest = lowest_id(docs, id_col)
    docs = docs.select(filled_id(docs, id_col).alias("_id"), F.col(text_col).cast("string").alias("text"))
    found = save(sketches(docs, k, "text"), "near-sketches")
    kind = docs.schema["_id"].dataType.simpleString()
    nodes = found.where("n > 0").groupBy("key").agg(F.min(F.struct("_id", "digest")).alias("row"), F.first("n").alias("n"), F.first("regs").alias("regs"), F.first("bands").alias("bands"))
    nodes = save(nodes.select(F.monotonically_increasing_id().alias("id"), "key", "row.*", "n", "regs", "bands"), "near-nodes")
    placed = nodes.select("id", F.explode("bands").alias("bucket"))
    shared = placed.groupBy("bucket").agg(F.min("id").alias("a"), F.count("*").alias("size")).where("size > 1").select("bucket", "a")
    buckets = save(placed.join(shared, "bucket").select("bucket", "a", F.col("id").alias("b")), "near-buckets")
    pairs = buckets.where("a <> b").select("a", "b").distinct()
    members = nodes.join(buckets.select(F.col("b").alias("id")).distinct(), "id", "left_semi").select("id", "_id", "digest")
    rows = docs.select("_id", F.unhex(F.md5(F.col("text").cast("binary"))).alias("digest"), "text").join(members, ["_id", "digest"])
    texts = save(rows.groupBy("id").agg(F.first("text").alias("text")), "near-texts")
    links = save(verified(likely(pairs, nodes, percent / 100), texts, k, percent), "near-links")
    labels = save(components(links), "near-labels")
    named = buckets.select("bucket", F.col("b").alias("id")).join(labels, "id", "left").select("bucket", "id", F.coalesce("component", "id").alias("component"))
    mixed = named.groupBy("bucket").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("bucket")
    open_ = save(named.join(mixed, "bucket").select("id", "component").distinct(), "near-open")
    labels = rest_of_links(links, labels, open_, texts, nodes, k, percent)
    linked = labels.join(nodes.select("id", "_id"), "id")
    names = linked.groupBy("component").agg(F.min("_id").alias("name"))
    named = linked.join(names, "component").select("id", "name")
    named = save(nodes.select("id", "key", F.col("_id").alias("least")).join(named, "id", "left").select("key", F.coalesce("name", "least").alias("name")), "near-names")
    rows = found.select("_id", "n", "key").join(named, "key", "left")
    name = F.coalesce("name", "_id").cast(kind)
    return rows.select(F.nullif("_id", lowest).alias("_id"), F.col("n").alias("n_shingles"), F.nullif(name, lowest).alias("component_id"), (F.col("_id") == name).alias("kept"))


def keep_first(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without those that are not the first of their component; of rows with the same id all stay or go."""
    found = near_duplicates(docs, k, percent, id_col, text_col)
    kept = found.where("kept").select(filled_id(found, "_id").alias("_id")).distinct()
    rows = docs.select(F.struct("*").alias("_row"), filled_id(docs, id_col).alias("_id"))
    return rows.join(kept, "_id", "left_semi").select("_row.*")
