"""From raw documents to token ids, in five stages.

Each stage is ``(spark, docs, sf_dir) -> DataFrame`` and works on all that the
stage before it kept. All but the last return the columns of ``documents``.
``run`` writes each stage's result as Parquet in the folder that executors share
and reads it again, so a lost executor costs a stage at most; what the next stage
has read is deleted, the last result stays.

1. quality: documents that the classifier rejects go;
2. near duplicates: of each group of linked documents the smallest id stays;
3. repeated strings: bytes covered by a string that stands elsewhere too are cut
   out of ``text`` (``n_chars`` follows; a document may end up empty, no row goes);
4. mixing: no row goes or repeats; the files hold the documents in the order of
   the mixture, which later stages that read in file order follow;
5. tokens: ids of each document, and the digest of their decoding.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.llm import bpe, mixing, quality, signature_trees, substrings
from keyloom.llm.common import removed, shared_dir
from keyloom.sources.tables import spread


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts (score of 0.3 and more), fitted on the labels of ``sf_dir``.

    Null and empty texts are scored like any other, by their structure; repeated rows
    get the same score and stay or go together; no rows give no rows, and without
    labelled documents the base rate decides for all.
    """
    machine = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.score(docs, machine).filter(F.col("predicted") == 1).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents whose shingle sets link, the one of the smallest doc_id.

    Null and empty texts and texts without words link with nothing and stay, repeated ones
    too; of rows equal in doc_id and text one stays; rows without a doc_id come last in
    their group; no rows give no rows.
    """
    return signature_trees.keep_one(docs).select(*docs.columns)


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, their texts without the bytes that a string of 200 bytes covers which stands elsewhere too.

    A null text stays null; a text that several rows hold is emptied in all of them (from
    200 bytes on); a character cut in two goes whole; ``n_chars`` follows where
    something went; no rows give no rows.
    """
    cut = substrings.dedup(docs)
    length = F.when(F.size("removed_spans") > 0, F.length("text").cast("bigint")).otherwise(F.col("n_chars"))
    return cut.withColumn("n_chars", length).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, once each, in files that hold them in the order of the mixture.

    A null source is a source of its own; null doc_ids and repeated rows are rows like
    others; no rows give no rows.
    """
    return mixing.in_order(mixing.schedule(docs)).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, source, n_tokens, ids, decoded_sha256`` of every row.

    A null text counts as empty and has no tokens; repeated rows stay; no rows give no rows.
    """
    coded = bpe.encode(docs.select("doc_id", "source", "text"), bpe.vocabulary(), decoded="sha256", keep_text=False)
    return coded.select("doc_id", "source", F.size("ids").cast("bigint").alias("n_tokens"), "ids", F.col("decoded").alias("decoded_sha256"))


STAGES = [
    ("quality_classifier", quality_filter),
    ("ngram_jaccard_join", near_duplicates),
    ("suffix_array_dedup", repeated_strings),
    ("mixing", mix_sources),
    ("bpe", tokens),
]

#: Neither the classifier nor the tokenizer can be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, before = spread(spark.read.parquet(f"{sf_dir}/documents.parquet")), None
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before is not None:
            removed(spark, before)
        before = path
    return docs
