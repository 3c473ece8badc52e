"""Words of a line, counted without a pattern where that is the same."""

from pyspark.sql import functions as F

from tandem.llm import line_dedup as L


def test_words_are_those_of_the_pattern(spark):
    lines = ["", " ", "\t", "a", " a", "a ", "a b", "a  b", "a\tb c", "a\x0bb", "a\x0cb", "a\rb", "b\r", "é ü 语 言", "a b c", "a b", "a\x00b c", "a b c d", "\x0b\x0c", "a \t b", "x" * 3000 + " y"]
    df = spark.createDataFrame([(x,) for x in lines], "line string").repartition(2)
    assert df.where(L._words(F.col("line")) != F.regexp_count("line", F.lit(L.WORD))).collect() == []
    found = L._sequences(spark.createDataFrame([(1, "\n".join(lines))], "doc_id int, text string"), "doc_id", "text")
    assert {r.p: r.words for r in found.collect()} == {p: n for p, x in enumerate(lines) if (n := len([w for w in x.translate(str.maketrans("\t\x0b\x0c\r", "    ")).split(" ") if w]))}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 1  # once a line: a condition on the count would repeat it
