"""The pipeline's stages, each against its own rule on its own input."""

import corpus_pipeline
from pyspark.sql import functions as F

from quarrystone.llm import mixing, near_dup, queries, toxicity
from quarrystone.llm._common import crc_mod, stored, table


def test_stages_hold_their_rules(spark):
    d = "/root/testdata/sf0.01"
    docs = first = table(spark, d, "documents")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stored(stage(spark, docs, d), name)
        kept[name] = (before, docs)
        if name != "sentencepiece":
            assert docs.columns == first.columns
    ids = {n: ({r.doc_id for r in a.select("doc_id").collect()}, {r.doc_id for r in b.select("doc_id").collect()}) for n, (a, b) in kept.items()}
    assert len(ids["language_id"][1]) >= 0.98 * len(ids["language_id"][0])
    before = kept["toxicity"][0]
    model = toxicity.train(before.where(crc_mod("doc_id", 5) != 0), table(spark, d, "labels"))
    assert ids["toxicity"][1] == {r.doc_id for r in toxicity.score(before, model).where("predicted = 0").collect()} != ids["toxicity"][0]
    groups = near_dup.near_duplicates(kept["minhash_near_dedup"][0]).where("kept")
    assert ids["minhash_near_dedup"][1] == {r.doc_id for r in groups.collect()} != ids["minhash_near_dedup"][0]
    a, b = kept["mix_sources"]
    assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()
    order = [r.doc_id for r in mixing.mix(a, queries.WEIGHTS).orderBy("mix_position").select("doc_id").collect()]
    files = sorted(b.inputFiles())
    assert order == [r.doc_id for f in files for r in spark.read.parquet(f).select("doc_id").collect()]
    last = kept["sentencepiece"][1]
    assert ids["sentencepiece"][1] == ids["mix_sources"][1] and last.where(F.size("ids") != F.col("n_pieces")).isEmpty()
