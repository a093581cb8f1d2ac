"""Stages of the pipeline on inputs where they once had no effect."""

import random

import corpus_pipeline
from pyspark.sql import functions as F

from quarrystone.llm import mixing, queries
from quarrystone.llm._common import table


def test_unknown_languages_and_letters_go(spark, small):
    """Random letters and random words of other scripts go; at least 98 % of the documents stay."""
    rng = random.Random(3)
    scripts = ["abcdefghijklmnopqrstuvwxyz", "αβγδεζηθικλμνξοπρστυφχψω", "абвгдежзийклмнопрстуфхцчшщъыьэюя"]
    made = [(10**9 + i, " ".join("".join(rng.choices(scripts[i % 3], k=rng.randint(2, 9))) for _ in range(200))) for i in range(60)]
    docs = table(spark, small, "documents")
    odd = spark.createDataFrame(made, "doc_id long, text string").withColumns({"lang": F.lit(None).cast("string"), "source": F.lit("src0"), "n_chars": F.length("text").cast("long")})
    both = docs.unionByName(odd.select(*docs.columns))
    kept = {r.doc_id for r in corpus_pipeline.keep_languages(spark, both, small).select("doc_id").collect()}
    stayed = [i for i, _ in made if i in kept]
    assert not stayed
    ids = [r.doc_id for r in docs.select("doc_id").collect()]
    assert sum(i in kept for i in ids) >= 0.98 * len(ids)


def test_run_is_in_the_order_of_the_mix(spark, small):
    """With several files a stage, run() still returns the rows in mix order, each with its position."""
    keys = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.files.openCostInBytes": "1"}
    for k, v in keys.items():
        spark.conf.set(k, v)
    try:
        out = corpus_pipeline.run(spark, small)
        rows = out.select("doc_id", "mix_position").collect()
        assert len(out.inputFiles()) > 1
    finally:
        for k in keys:
            spark.conf.unset(k)
    ids = [r.doc_id for r in rows]
    left = table(spark, small, "documents").where(F.col("doc_id").isin(ids))
    want = mixing.mix(left, queries.WEIGHTS).orderBy("mix_position").select("doc_id", "mix_position").collect()
    assert [tuple(r) for r in rows] == [tuple(r) for r in want]
