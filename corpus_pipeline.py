"""The corpus pipeline: language ID, toxicity, near-dedup, mixing, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and reread as the next
stage's docs. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrystone.llm import language_id, mixing, near_dup, queries, sentencepiece_codec, toxicity
from quarrystone.llm._common import crc_mod, stored, table

#: A document goes if no language is found or its profile is as unlike all languages as made text is: cosines of unrelated
#: bundles have a deviation of 1 / sqrt(DIM), and the best of several languages, for random letters, stays under six of them.
MIN_LIKENESS = 6 / language_id.DIM**0.5

#: SQL cannot express the stages; tests hold them against brute force.
ORACLE_SQL = None


def _aside(docs: DataFrame, *added: str) -> tuple[DataFrame, list[Column]]:
    """``docs`` with columns that an operator would replace under other names, and what selects them back."""
    names = {c: f"__own_{c}" for c in docs.columns if c in added}
    return docs.withColumnsRenamed(names), [F.col(names.get(c, c)).alias(c) for c in docs.columns]


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents in no known language; profiles are learned from the training rows with a language.

    A null or empty text and one without letters goes; without any training language all rows go; repeated rows share their fate, a
    null id or lang changes nothing; an empty table stays empty.
    """
    prototypes = language_id.train(docs.where(crc_mod("doc_id", 4) != 2))
    rows, back = _aside(docs, "lang_pred", "score")
    known = language_id.classify(rows, prototypes)
    return known.where((F.col("lang_pred") != "und") & (F.col("score") >= MIN_LIKENESS)).select(*back)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the classifier calls toxic; it learns from the labelled training rows still there.

    Without labelled rows every score is 0.5, which says nothing, so all rows stay. A null or empty text is scored by the bias alone.
    """
    model = toxicity.train(docs.where(crc_mod("doc_id", 5) != 0), table(spark, sf_dir, "labels"))
    rows, back = _aside(docs, "predicted", "score")
    return toxicity.score(rows, model).where("predicted = 0").select(*back) if len(model[0]) else docs


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest id of each group of near copies; rows with a null id and those without words stay.

    Rows that share an id stay or go together. An empty table stays empty.
    """
    groups = near_dup.near_duplicates(docs)
    gone = groups.where("not kept").select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["__gone"], "left_anti").select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same rows, written in the order of the mix; a null source is one of its own, repeated rows keep a place each."""
    rows, back = _aside(docs, "mix_block", "mix_slot", "mix_position")
    return mixing.mixed(rows, queries.WEIGHTS).select(*back)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every document that is left, with its place in the mix: files reread have no order of their own.

    A null or empty text has no pieces; null ids and sources come back as they are.
    """
    coded = sentencepiece_codec.encode(mixing.mix(docs, queries.WEIGHTS), queries.MODEL, keep_text=False)
    return coded.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_pieces"), "ids", "mix_position")


STAGES = [
    ("language_id", keep_languages),
    ("toxicity", drop_toxic),
    ("minhash_near_dedup", drop_near_duplicates),
    ("mix_sources", mix_sources),
    ("sentencepiece", encode_pieces),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each one's result written to the shared folder and reread; rows in the order of the mix."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs.orderBy("mix_position")
