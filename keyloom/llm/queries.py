"""Queries of this package, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from keyloom.llm import bpe, ego_join, html_text, kmeans_tree, licenses, mixing, oracles, quality, signature_trees, substrings, urls
from keyloom.sources.tables import spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op10_bpe(spark, sf_dir):
    return bpe.digests(_table(spark, sf_dir, "documents"), bpe.vocabulary())


@query
def op7_mix(spark, sf_dir):
    rows = _table(spark, sf_dir, "documents").select("doc_id", "source")
    return mixing.schedule(rows)


@query
def op6_licenses(spark, sf_dir):
    return licenses.scan(_table(spark, sf_dir, "documents")).drop("matches")



@query
def op1_urls(spark, sf_dir):
    return urls.judge(_table(spark, sf_dir, "pages"))


@query
def op4_quality(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars")
    machine = quality.train(docs, _table(spark, sf_dir, "labels"))
    return quality.score(docs, machine).select("doc_id", "held_out", "score", "predicted")


@query
def op8_html(spark, sf_dir):
    return html_text.extract(_table(spark, sf_dir, "pages"))


@query
def op2_near_vectors(spark, sf_dir):
    return ego_join.near_duplicates(_table(spark, sf_dir, "embeddings"))


@query
def op3_neighbours(spark, sf_dir):
    return kmeans_tree.search(_table(spark, sf_dir, "embeddings"))


@query
def op9_substrings(spark, sf_dir):
    return substrings.dedup(_table(spark, sf_dir, "documents"), texts=False)


@query
def op5_similar(spark, sf_dir):
    return signature_trees.similar(_table(spark, sf_dir, "documents"))


ORACLE |= oracles.SQL | {"op6_licenses": licenses.ORACLE_SQL}
QUERIES["pipeline"] = corpus_pipeline.run
if corpus_pipeline.ORACLE_SQL is not None:
    ORACLE["pipeline"] = corpus_pipeline.ORACLE_SQL
