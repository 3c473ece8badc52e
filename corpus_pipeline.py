"""The corpus pipeline: four stages over documents, each written as Parquet before the next reads it.

1. toxicity: documents that the classifier rejects go.
2. line dedup: later copies of repeated runs of lines (50 words or more) are cut from the texts; a document of which
   nothing but white space is left then goes, since all it said is said elsewhere.
3. MinHash near-dedup: of each group of near-duplicates (five-word shingles, similarity of 0.8) the first stays.
4. best-fit packing: the texts are encoded and packed into sequences; one row per piece.

All stages but the last return the columns of documents. No SQL expresses the first stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tandem.llm import line_dedup, near_dedup, packing, tables, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted to be toxic; training leaves out the fold that op5 holds out."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.fit(docs, labels.where(~toxicity.in_fold(F.col("doc_id"), 0)))
    names = [tables.unused(docs, "_score"), tables.unused(docs, "_predicted")]
    return toxicity.score(docs, model, "text", *names).where(F.col(names[1]) == 0).select(*[F.col(f"`{c}`") for c in docs.columns])


def cut_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later copies of repeated runs of lines."""
    rows = docs.select(F.struct("*").alias("_row"), "doc_id", "text")
    found = line_dedup.dedup_lines(rows).where((F.col("_removed") == 0) | F.col("text").rlike(line_dedup.WORD))
    length = F.when(F.col("_removed") > 0, F.length("text")).otherwise(F.col("_row.n_chars")).cast("long")
    new = {"text": F.col("text"), "n_chars": length}
    return found.select(*[new.get(c, F.col("_row")[c]).alias(c) for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near-duplicates."""
    return near_dedup.keep_first(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents, each with its sequence and offset."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", cut_repeated_lines),
    ("MinHash near-dedup", drop_near_duplicates),
    ("best-fit packing", pack_sequences),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = tables.save(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
