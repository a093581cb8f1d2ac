"""Every pipeline stage on odd rows and on an empty table."""

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from quarrystone.llm._common import stored, table


def odd_documents(spark, small):
    docs = table(spark, small, "documents")
    long_text = "the cat sat on the mat " * 20_000
    rows = [(None, "the cat sat on the mat", "en", "src0"), (10**9, None, None, None), (10**9 + 1, "", "en", "src1"), (10**9 + 2, " \t ", None, "src1"), (10**9 + 3, "123 !!", "de", None), (10**9 + 4, long_text, None, "src2"), (10**9 + 4, long_text, None, "src2"), (10**9 + 5, long_text, "en", "src3")]
    odd = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long"))
    # columns that operators also add, or use inside
    out = docs.unionByName(odd.select(*docs.columns))
    for c in ("score", "predicted", "lang_pred", "component_id", "kept", "mix_slot", "id", "n"):
        out = out.withColumn(c, F.lit("own"))
    return out


def test_stages_on_odd_rows(spark, small):
    docs = odd_documents(spark, small)
    first = set(docs.columns)
    for name, stage in corpus_pipeline.STAGES:
        after = stored(stage(spark, docs, small), f"odd-{name}")
        if name != "sentencepiece":
            assert set(after.columns) == first and after.where("score != 'own' or kept != 'own' or n != 'own'").isEmpty(), name
            assert after.exceptAll(docs).isEmpty(), name
        ids = {r.doc_id for r in after.select("doc_id").collect()}
        if name == "language_id":
            assert not ids & {10**9, 10**9 + 1, 10**9 + 2, 10**9 + 3} and None in ids
        if name == "minhash_near_dedup":
            assert 10**9 + 5 not in ids and None in ids and after.where(F.col("doc_id") == 10**9 + 4).count() == 2
        if name == "mix_sources":
            assert after.count() == docs.count()
        docs = after
    assert docs.where("size(ids) != n_pieces or mix_position is null").isEmpty() and docs.select("mix_position").distinct().count() == docs.count()


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_on_an_empty_table(spark, small, name):
    empty = table(spark, small, "documents").limit(0)
    assert dict(corpus_pipeline.STAGES)[name](spark, empty, small).isEmpty()


def test_a_cluster_needs_the_shared_folder():
    from quarrystone.llm import _common

    class Elsewhere:
        class conf:  # noqa: N801
            get = staticmethod(lambda name, default: default)

        class sparkContext:  # noqa: N801
            master = "spark://host:7077"
            getCheckpointDir = staticmethod(lambda: None)  # noqa: N815

    with pytest.raises(ValueError, match="checkpoint"):
        _common.shared_path(Elsewhere, "x")
