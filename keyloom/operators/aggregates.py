"""Declarative jobs: each is one partial aggregate, one exchange, one final aggregate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyloom.functions.text import _DELIMITERS, _normal, distinct_token_array, tokens


def word_count(df: DataFrame, text: str) -> DataFrame:
    return tokens(df, text).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def pairs(df: DataFrame, text: str, doc: Column) -> DataFrame:
    """Emitted ``(word, doc)`` rows, repetitions kept."""
    return tokens(df.select(doc.cast("string").alias("doc"), F.col(text).alias("_text")), "_text", "doc").select("word", "doc")


def distinct_pairs(df: DataFrame, text: str, doc: Column) -> DataFrame:
    return pairs(df, text, doc).distinct()


def sharded_index(df: DataFrame, text: str, doc: Column, shards: int) -> DataFrame:
    """``(word, shard, docs)``: postings in ``shards`` chunks a word, for corpora in which one array could not list all documents of a word.

    A document's shard is a hash of its name, so a word that all documents hold is
    spread over as many tasks and rows; a chunk's documents are distinct and in byte order.
    Repetitions inside a row go before anything is shuffled, those across rows of one name in the end.
    """
    source = df.select(doc.cast("string").alias("doc"), F.col(text).alias("_text"))
    found = source.select("doc", F.explode(distinct_token_array(F.col("_text"))).alias("word"))
    grouped = found.groupBy("word", F.pmod(F.xxhash64("doc"), F.lit(shards)).cast("int").alias("shard")).agg(F.collect_list("doc").alias("docs"))
    return grouped.select("word", "shard", F.array_sort(F.array_distinct("docs")).alias("docs"))


def inverted_index(df: DataFrame, text: str, doc: Column, *, unique_docs: bool = False, combiner: bool = True) -> DataFrame:
    """``(word, docs)`` with the distinct documents of each word in byte order.

    ``unique_docs``: each document is one row, so repetitions are removed inside
    the row before anything is shuffled. Otherwise ``collect_set`` removes them
    on both sides of the exchange. ``combiner=False`` ships every pair.
    """
    source = df.select(doc.cast("string").alias("doc"), F.col(text).alias("_text"))
    if not combiner:
        grouped = pairs(df, text, doc).groupBy("word").agg(F.array_distinct(F.collect_list("doc")).alias("docs"))
    elif unique_docs:
        words = source.select("doc", F.explode(distinct_token_array(F.col("_text"))).alias("word"))
        grouped = words.groupBy("word").agg(F.collect_list("doc").alias("docs"))
    else:
        grouped = tokens(source, "_text", "doc").groupBy("word").agg(F.collect_set("doc").alias("docs"))
    return grouped.select("word", F.array_sort("docs").alias("docs"))


def document_frequency(df: DataFrame, text: str, doc: Column, *, unique_docs: bool = False) -> DataFrame:
    if unique_docs:
        words = df.select(F.explode(distinct_token_array(F.col(text))).alias("word"))
        return words.groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    return distinct_pairs(df, text, doc).groupBy("word").agg(F.count(F.lit(1)).alias("df"))


def vocabulary_size(df: DataFrame, text: str) -> DataFrame:
    return tokens(df, text).agg(F.count_distinct("word").alias("n_words"))


def combiner_effect(df: DataFrame, text: str) -> DataFrame:
    """Pairs emitted, and pairs left once each document's repetitions are combined."""
    words = F.filter(F.transform(F.split(F.col(text), _DELIMITERS), _normal), lambda w: w != "")
    sizes = df.select(F.size(words).alias("emits"), F.size(F.array_distinct(words)).alias("combined"))
    total = lambda c: F.coalesce(F.sum(F.greatest(F.col(c), F.lit(0)).cast("long")), F.lit(0).cast("long")).alias(c)
    return sizes.agg(total("emits"), total("combined"))
