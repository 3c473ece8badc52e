"""Line dedup: suffix ranks over line-ID sequences by distributed prefix doubling, native.

A document is the sequence of its lines that hold words. Lines become ids, and the suffixes of all sequences are ranked
by their first 1, 2, 4, ... lines: a rank is the number of suffixes with a smaller prefix, that is, the start of an
interval of the suffix array with a longest common prefix of at least so many lines. Each doubling pairs the rank of a
suffix with that of the suffix further on. Suffixes whose interval holds just one place are dropped at once, so each
round works on what still repeats only.

A run of lines counts when it holds min_words words or more. Runs that are minimal, from either end, cover every longer
run, and hold at most min_words lines; a run of n lines is an interval with a common prefix of n, which the ranks of the
two blocks of 2^k <= n lines at its ends identify. In each such interval the first place (smallest id, then first line)
is the original; at all the others the run's lines are deleted. Overlapping runs merge into the maximal repeated run.

Defined results: null and blank texts, and lines without words, are kept as they are; a text all of whose lines go
becomes empty. Null ids count as the lowest id. Rows with the same id and the same text are one document: both are kept
with the same new text. Other columns pass through unchanged, but for _lines and _removed, which are replaced.
An empty table gives no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import filled_id, save

WORD = r"[^\x20\x09-\x0D]+"
DOC = ["_id", "_h"]
#: Ranks in one cell when places are counted; a bound on what one window sorts.
CELL = 1 << 18


def _words(line: Column) -> Column:
    """The number of words in a line. Where single spaces stand between words and nowhere else, spaces are counted byte by byte; a pattern reads the other lines."""
    odd = reduce(Column.__or__, [F.contains(line, F.lit(c)) for c in ("  ", "\t", "\x0b", "\x0c", "\r")], (line == "") | F.startswith(line, F.lit(" ")) | F.endswith(line, F.lit(" ")))
    return F.when(odd, F.regexp_count(line, F.lit(WORD))).otherwise(F.octet_length(line) - F.octet_length(F.replace(line, F.lit(" "), F.lit(""))) + 1)


def _sequences(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    lines = F.posexplode(F.split(F.col(text_col), "\n", -1)).alias("p", "line")
    found = docs.where(F.col(text_col).isNotNull()).select(filled_id(docs, id_col).alias("_id"), F.xxhash64(text_col).alias("_h"), lines)
    worded = F.ltrim("line", F.lit(" \t\n\x0b\x0c\r")) != ""  # a condition on the number of words would count them twice
    return found.where(worded).select(*DOC, "p", _words(F.col("line")).alias("words"), F.xxhash64("line").alias("a"), F.xxhash64(F.lit(7), "line").alias("b"))


def _windows(lines: DataFrame, min_words: int) -> DataFrame:
    """Minimal runs of min_words words: their first line (of those with words) and number of lines."""
    doc = Window.partitionBy(*DOC)
    placed = lines.withColumn("i", F.row_number().over(doc.orderBy("p")) - 1).withColumn("upto", F.sum("words").over(doc.orderBy("p")))
    placed = placed.withColumn("before", F.col("upto") - F.col("words"))
    ahead, back = doc.orderBy("before").rangeBetween(0, min_words - 1), doc.orderBy("upto").rangeBetween(-(min_words - 1), 0)
    return (
        placed.withColumn("n", F.count("*").over(ahead)).withColumn("full", F.max("upto").over(ahead) - F.col("before") >= min_words)
        .withColumn("m", F.count("*").over(back)).withColumn("filled", F.col("upto") - F.min("before").over(back) >= min_words)
        .select(*DOC, "p", "i", "a", "b", F.when(F.col("full"), F.col("n")).alias("n"), F.when(F.col("filled"), F.col("m")).alias("m"))
    )


def _ranks(classes: DataFrame, first: list[str], second: list[str], cell) -> DataFrame:
    """Adds rank to classes (with count n), by the order of first, then cell, then second: how many places come before in the same first."""
    cells = classes.withColumn("_cell", cell)
    inside = F.sum("n").over(Window.partitionBy(*first, "_cell").orderBy(*second)) - F.col("n")
    totals = cells.groupBy(*first, "_cell").agg(F.sum("n").alias("_all"))
    offsets = totals.select(*first, "_cell", (F.sum("_all").over(Window.partitionBy(*first).orderBy("_cell")) - F.col("_all")).alias("_before"))
    return cells.withColumn("_in", inside).join(offsets, [*first, "_cell"]).withColumn("_rank", F.col("_before") + F.col("_in")).drop("_cell", "_in", "_before")


def repeats(docs: DataFrame, min_words: int = 50, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """The lines of all documents, and those to delete: (_id, _h, p), p the line's number in the text."""
    lines = save(_windows(_sequences(docs, id_col, text_col).dropDuplicates([*DOC, "p"]), min_words), "line-ids")
    classes = lines.groupBy("a", "b").agg(F.count("*").alias("n")).where("n > 1").withColumn("whole", F.lit(0))
    ranked = _ranks(classes, ["whole"], ["a", "b"], F.shiftright("a", 52)).select("a", "b", F.col("_rank").alias("r"))
    level = save(lines.select(*DOC, "i", "a", "b").join(ranked, ["a", "b"]).select(*DOC, "i", "r"), "line-ranks")
    forward = lines.where("n is not null").select(*DOC, F.col("i").alias("s"), "n")
    backward = lines.where("m is not null").select(*DOC, (F.col("i") - F.col("m") + 1).alias("s"), F.col("m").alias("n"))
    asked = forward.union(backward).join(level.withColumnRenamed("i", "s"), [*DOC, "s"], "left_semi").distinct()
    asked = save(asked, "line-runs")
    longest = asked.agg(F.max("n")).first()[0] or 0
    runs, block = [], 1
    while block <= longest:
        mine = asked.where(F.col("n").between(block, 2 * block - 1))
        at = level.select(*DOC, F.col("i").alias("s"), F.col("r").alias("ra"))
        to = level.select(*DOC, F.col("i").alias("e"), F.col("r").alias("rb"))
        known = mine.withColumn("e", F.col("s") + F.col("n") - block).join(at, [*DOC, "s"]).join(to, [*DOC, "e"])
        spot = F.struct(*DOC, "s")
        firsts = known.groupBy("n", "ra", "rb").agg(F.min(spot).alias("first"), F.count("*").alias("copies")).where("copies > 1").drop("copies")
        firsts = save(firsts, "line-firsts")  # so that the join can split a run with many copies
        later = known.join(firsts, ["n", "ra", "rb"]).where(F.struct(*DOC, "s") > F.col("first"))
        runs.append(save(later.select(*DOC, "s", "n"), "line-copies"))  # saved by level, so that no plan holds all levels
        if 2 * block <= longest:
            ahead = level.select(*DOC, (F.col("i") - block).alias("i"), F.col("r").alias("r2"))
            pairs = level.join(ahead, [*DOC, "i"])
            classes = pairs.groupBy("r", "r2").agg(F.count("*").alias("n")).where("n > 1")
            ranked = _ranks(classes, ["r"], ["r2"], F.floor(F.col("r2") / CELL)).select("r", "r2", (F.col("r") + F.col("_rank")).alias("next"))
            level = save(pairs.join(ranked, ["r", "r2"]).select(*DOC, "i", F.col("next").alias("r")), "line-ranks")
        block *= 2
    if not runs:
        return lines, lines.where("false").select(*DOC, "p")
    found = reduce(DataFrame.union, runs).select(*DOC, F.explode(F.sequence("s", F.col("s") + F.col("n") - 1)).alias("i")).distinct()
    return lines, lines.select(*DOC, "i", "p").join(found, [*DOC, "i"]).select(*DOC, "p")


def dedup_lines(docs: DataFrame, min_words: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with later copies of repeated runs of lines deleted from the text; adds _lines and _removed, counts of lines."""
    _, gone = repeats(docs, min_words, id_col, text_col)
    by_doc = gone.groupBy(*DOC).agg(F.collect_set("p").alias("_gone"))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in ("_lines", "_removed")])  # names that clash with ours stay apart
    keyed = docs.select(row.alias("_row"), filled_id(docs, id_col).alias("_id"), F.xxhash64(text_col).alias("_h"))
    joined = keyed.join(by_doc, DOC, "left")
    old = F.col("_row")[text_col]
    parts = F.split(old, "\n", -1)
    kept = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col("_gone"))
    text = F.when(F.col("_gone").isNull(), old).otherwise(F.array_join(F.transform(kept, lambda p: F.get(parts, p)), "\n"))
    cut = F.when(F.col("_gone").isNull(), 0).otherwise(F.size("_gone")).cast("long")
    lines = F.when(old.isNull(), 0).otherwise(F.size(parts)).cast("long")
    columns = [text.alias(c) if c == text_col else F.col("_row")[c].alias(c) for c in docs.columns if c not in ("_lines", "_removed")]
    return joined.select(*columns, lines.alias("_lines"), cut.alias("_removed"))
