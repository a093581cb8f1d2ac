"""The mix where one id holds most rows, and with very many sources."""

from pyspark.sql import functions as F

from quarrystone.llm import mixing


def test_an_id_with_most_rows_is_cut(spark):
    """A null id on a third of the rows: numbers are whole, in the stated order, and no range is much larger than asked."""
    df = spark.range(9000).select(F.when(F.col("id") % 3 > 0, F.col("id")).alias("doc_id"), F.lit("a").alias("source"), F.col("id").alias("more"))
    plain = mixing.OVER
    got = mixing.mix(df, block_rows=8, range_rows=16)
    rows = [tuple(r) for r in got.select("more", "mix_position").orderBy("mix_position").collect()]
    assert [p for _, p in rows] == list(range(9000))
    mixing.OVER = 10**9
    try:
        whole = [tuple(r) for r in mixing.mix(df, block_rows=8, range_rows=16).select("more", "mix_position").orderBy("mix_position").collect()]
    finally:
        mixing.OVER = plain
    assert rows == whole


def test_more_than_a_thousand_sources(spark):
    df = spark.range(4000).select(F.col("id").alias("doc_id"), F.concat(F.lit("s"), F.col("id") % 1500).alias("source"))
    got = mixing.mix(df, {"s7": 3}, block_rows=1).select("source", "mix_slot").orderBy("mix_slot").collect()
    assert len(got) == 4000 and len({r.mix_slot for r in got}) == 4000
    first = [r.source for r in got if r.mix_slot < 1502]
    assert first.count("s7") == 3 and len(set(first)) == 1500
