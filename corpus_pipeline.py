"""A corpus pipeline of five training-data operators.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its result is
written as Parquet below the shared folder and read again as the next one's
``docs``.  All but the last return the columns of ``documents``.  Language ID and
encoding, which send every text to Python, write their result themselves, with
small batches: a task's texts in one batch took an executor beyond its memory.

1. language_id: a byte convolutional network learns from the labelled rows of
   what it is given; documents without a letter, or whose language it is not
   sure of (score below ``MIN_SCORE``), go.  Without any labelled row there is
   no network and only documents without a letter go.
2. near_duplicates: n-gram Jaccard join over five-word n-grams at 0.8; of each
   component the document with the smallest id stays.
3. pii: personal data is replaced by surrogates; ``n_chars`` follows the text.
4. mix: documents are taken as often as the mix of their source asks for.
5. encode: token ids of every text.

A null id cannot be compared: such documents are never dropped as duplicates.
Rows that repeat an id share its decision.  Empty input gives empty output.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dqlens.llm import byte_bpe as BPE
from dqlens.llm import jaccard_join as JJ
from dqlens.llm import language_id as LID
from dqlens.llm import pii_surrogates as PII
from dqlens.llm import source_mixing as MX
from dqlens.llm.common import forget, free_name, read_table, sized, small_batches, stored
from dqlens.llm.queries import VOCABULARY

#: mean probability of the predicted language below which a text is rejected
MIN_SCORE = 0.35


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = LID.train_on(docs)
    if model is None:
        return docs.where(F.col("text").rlike(LID.LETTER.pattern))
    name = free_name(docs, "found")
    found = LID.predicted(docs, model, F.col("text"), name)
    kept = found.where((F.col(name)["lang"] != LID.UNKNOWN) & (F.col(name)["score"] >= MIN_SCORE)).drop(name)
    with small_batches(spark):
        return stored(kept, "kept")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    classes = JJ.jaccard_components(docs, width=5, threshold=(80, 100))
    dropped = stored(classes.where("doc_id != component_id").select(F.col("doc_id").alias("dropped")).distinct(),
                     "duplicates")
    return docs.join(sized(dropped), docs["doc_id"] == dropped["dropped"], "left_anti")


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    clean = PII.surrogates(docs).drop(free_name(docs, "entities"))
    return clean.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else clean


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return MX.apply_mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    coded = BPE.encode_frame(docs.select("doc_id", "text", "lang", "source"), VOCABULARY, decode=False)
    coded = coded.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids")
    with small_batches(spark):
        return stored(coded, "encoded")


STAGES = [("language_id", language_id), ("near_duplicates", near_duplicates), ("pii", pii),
          ("mix", mix), ("encode", encode)]

#: the stages train, draw and hash in ways that SQL does not express
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        found = stage(spark, docs, sf_dir)
        # what a stage has written down itself is not written again
        found = found if hasattr(found, "_dqlens_path") else stored(found, f"pipeline-{name}")
        if hasattr(docs, "_dqlens_path"):
            forget(docs)
        docs = found
    return docs
