"""The engine's ready-made queries over Parquet tables, each with the SQL it must agree with."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from keyloom.apps.inverted_index import POSTINGS, dedup, map_words
from keyloom.apps.word_count import SUM, add_up, map_ones
from keyloom.functions.hashing import djb2, djb2_mod
from keyloom.functions.text import atoi, postings_line, tokens
from keyloom.functions.udtf import register_udtfs
from keyloom.metrics import balance, partition_keys, top_partitions
from keyloom.operators import aggregates as A
from keyloom.operators.mapreduce import PythonReducer, map_reduce
from keyloom.operators.partitioners import first_letter_partition, python_partition
from keyloom.sources.tables import spread, table

Query = Callable[[SparkSession, str], DataFrame]
N_PARTS = 40
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

_TOKENS = "lower(left(unnest(regexp_extract_all({col}, '[0-9A-Za-z]+')), 255))"
_W = f"w AS (SELECT doc_id, source, {_TOKENS.format(col='text')} AS word FROM documents)"
_VOCAB = "v AS (SELECT DISTINCT word FROM w)"
_HASH = (
    "h AS (SELECT word, list_reduce(list_prepend(5381::HUGEINT, list_transform(string_split(word, ''), "
    "lambda c: ascii(c)::HUGEINT)), lambda a, c: (a * 33 + c) % 18446744073709551616::HUGEINT) AS hash FROM v)"
)
_PARTS = f"p AS (SELECT word, (hash % {N_PARTS})::INT AS partition FROM h)"


def _with(*ctes: str) -> str:
    return "WITH " + ", ".join(ctes) + " "


def register(oracle: str) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[fn.__name__], ORACLE[fn.__name__] = fn, oracle
        return fn

    return add


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents"))


def _postings(doc: str) -> str:
    return f"SELECT word, string_agg(doc, ', ' ORDER BY doc) AS postings FROM (SELECT DISTINCT word, {doc} AS doc FROM w) GROUP BY word"


def _joined(index: DataFrame) -> DataFrame:
    return index.select("word", F.array_join("docs", ", ").alias("postings"))


@register(_with(_W) + _postings("doc_id::VARCHAR"))
def inverted_index_doc(spark, sf_dir):
    return _joined(A.inverted_index(_docs(spark, sf_dir), "text", F.col("doc_id"), unique_docs=True))


@register(_with(_W) + _postings("source"))
def inverted_index_source(spark, sf_dir):
    return _joined(A.inverted_index(_docs(spark, sf_dir), "text", F.col("source")))


@register(_with(_W) + "SELECT word, string_agg(doc, ', ' ORDER BY doc) AS postings FROM (SELECT DISTINCT word, doc_id::VARCHAR AS doc FROM w) GROUP BY word")
def sharded_postings(spark, sf_dir):
    chunks = A.sharded_index(_docs(spark, sf_dir), "text", F.col("doc_id"), shards=8)
    whole = chunks.groupBy("word").agg(F.array_sort(F.flatten(F.collect_list("docs"))).alias("docs"))
    return _joined(whole)


@register(_with(_W) + f"SELECT word || ' -> [' || postings || ']' AS line FROM ({_postings('source')})")
def postings_lines(spark, sf_dir):
    return A.inverted_index(_docs(spark, sf_dir), "text", F.col("source")).select(postings_line(F.col("word"), F.col("docs")).alias("line"))


@register(_with(_W) + _postings("source"))
def inverted_index_no_combiner(spark, sf_dir):
    return _joined(A.inverted_index(_docs(spark, sf_dir), "text", F.col("source"), combiner=False))


@register(_with(_W) + _postings("source"))
def inverted_index_udf(spark, sf_dir):
    rows = _docs(spark, sf_dir).select(F.col("source").alias("doc"), F.col("text").alias("value"))
    return map_reduce(rows, map_words, POSTINGS, combiner=dedup, num_partitions=8)


@register(_with(_W) + "SELECT word, count(*) AS n FROM w GROUP BY word")
def word_count(spark, sf_dir):
    return A.word_count(_docs(spark, sf_dir), "text")


@register(_with(_W) + "SELECT word, count(*) AS n FROM w GROUP BY word")
def word_count_udf(spark, sf_dir):
    rows = _docs(spark, sf_dir).select(F.col("source").alias("doc"), F.col("text").alias("value"))
    return map_reduce(rows, map_ones, SUM, combiner=add_up, num_partitions=8)


@register(_with(_W) + "SELECT source, word, count(*) AS n FROM w WHERE length(word) >= 12 GROUP BY source, word")
def long_words_udtf(spark, sf_dir):
    register_udtfs(spark)
    query = "SELECT source, word, count(*) AS n FROM {docs}, LATERAL words(text) WHERE length(word) >= 12 GROUP BY source, word"
    return spark.sql(query, docs=_docs(spark, sf_dir).select("source", "text"))


@register(
    _with(_W) + "SELECT source, sum(coalesce(try_cast(regexp_extract(word, '^\\s*([+-]?[0-9]+)', 1) AS INT), 0))::BIGINT AS total "
    "FROM w WHERE regexp_matches(word, '^[0-9]') GROUP BY source"
)
def leading_numbers(spark, sf_dir):
    words = tokens(_docs(spark, sf_dir), "text", "source").filter(F.col("word").rlike("^[0-9]"))
    return words.groupBy("source").agg(F.sum(atoi(F.col("word"))).alias("total"))


@register(_with(_W) + "SELECT word, count(DISTINCT doc_id) AS df FROM w GROUP BY word")
def document_frequency(spark, sf_dir):
    return A.document_frequency(_docs(spark, sf_dir), "text", F.col("doc_id"), unique_docs=True)


@register(_with(_W) + "SELECT count(DISTINCT word) AS n_words FROM w")
def vocabulary_size(spark, sf_dir):
    return A.vocabulary_size(_docs(spark, sf_dir), "text")


@register(_with(_W) + "SELECT DISTINCT word, source AS doc FROM w")
def distinct_pairs(spark, sf_dir):
    return A.distinct_pairs(_docs(spark, sf_dir), "text", F.col("source"))


@register(_with(_W) + "SELECT (SELECT count(*) FROM w) AS emits, (SELECT count(*) FROM (SELECT DISTINCT doc_id, word FROM w)) AS combined")
def combiner_effect(spark, sf_dir):
    return A.combiner_effect(_docs(spark, sf_dir), "text")


def _vocab(spark, sf_dir):
    return tokens(_docs(spark, sf_dir), "text").distinct()


@register(_with(_W, _VOCAB, _HASH) + "SELECT word, hash::VARCHAR AS hash FROM h")
def djb2_hash(spark, sf_dir):
    return _vocab(spark, sf_dir).select("word", djb2(F.col("word")).cast("string").alias("hash"))


@register(_with(_W, _VOCAB, _HASH, _PARTS) + "SELECT word, partition FROM p")
def partition_assignment(spark, sf_dir):
    return _vocab(spark, sf_dir).select("word", djb2_mod(F.col("word"), N_PARTS).alias("partition"))


_KEYS = _with(_W, _VOCAB, _HASH, _PARTS, "k AS (SELECT partition, count(*) AS keys FROM p GROUP BY partition)")


@register(_KEYS + "SELECT partition, keys FROM k")
def partition_key_counts(spark, sf_dir):
    return partition_keys(partition_assignment(spark, sf_dir))


@register(_KEYS + "SELECT partition, keys FROM k ORDER BY keys DESC, partition LIMIT 10")
def top10_partitions(spark, sf_dir):
    return top_partitions(partition_key_counts(spark, sf_dir))


@register(
    _KEYS + f"SELECT round(sum(keys)::DOUBLE / {N_PARTS}, 4) AS avg_keys, "
    f"round(sqrt(greatest(sum(keys * keys)::DOUBLE - sum(keys)::DOUBLE * sum(keys)::DOUBLE / {N_PARTS}, 0) / {N_PARTS - 1}), 4) AS sd_keys FROM k"
)
def partition_balance(spark, sf_dir):
    return balance(partition_key_counts(spark, sf_dir), N_PARTS)


@register(_with(_W, _VOCAB) + f"SELECT ((((ascii(word) - 97) % {N_PARTS}) + {N_PARTS}) % {N_PARTS})::INT AS partition, count(*) AS keys FROM v GROUP BY 1")
def first_letter_partition_keys(spark, sf_dir):
    return partition_keys(_vocab(spark, sf_dir).select(first_letter_partition(F.col("word"), N_PARTS).alias("partition")))


@register(_with(_W, _VOCAB, _HASH, _PARTS) + "SELECT partition, word, row_number() OVER (PARTITION BY partition ORDER BY word) AS rank FROM p")
def sorted_within_partition(spark, sf_dir):
    order = W.partitionBy("partition").orderBy("word")
    return partition_assignment(spark, sf_dir).select("partition", "word", F.row_number().over(order).cast("bigint").alias("rank"))


@register(_with(_W, _VOCAB, _HASH, _PARTS) + "SELECT partition, min(word) AS word FROM p GROUP BY partition")
def first_key_per_partition(spark, sf_dir):
    return partition_assignment(spark, sf_dir).groupBy("partition").agg(F.min("word").alias("word"))


@register(_with(_W) + "SELECT doc_id, word, count(*) AS n FROM w WHERE word LIKE 'lic%' OR regexp_matches(word, '^[0-9]+$') GROUP BY doc_id, word")
def grep_filter(spark, sf_dir):
    words = tokens(_docs(spark, sf_dir), "text", "doc_id")
    return words.filter(F.col("word").startswith("lic") | F.col("word").rlike("^[0-9]+$")).groupBy("doc_id", "word").agg(F.count(F.lit(1)).alias("n"))


@register(_with(_W) + "SELECT length(word) AS n_letters, count(*) AS n, count(DISTINCT word) AS n_distinct FROM w GROUP BY 1")
def token_lengths(spark, sf_dir):
    return A.word_count(_docs(spark, sf_dir), "text").groupBy(F.length("word").cast("bigint").alias("n_letters")).agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_distinct")
    )


@register(
    "SELECT count(*) AS docs, sum(octet_length(encode(text)))::BIGINT AS bytes, sum(ceil(octet_length(encode(text)) / 262144.0))::BIGINT AS chunks, "
    "sum(octet_length(encode(text)))::DOUBLE / sum(ceil(octet_length(encode(text)) / 262144.0))::BIGINT AS avg_chunk FROM documents"
)
def input_stats(spark, sf_dir):
    size = F.octet_length("text")
    sums = _docs(spark, sf_dir).agg(F.count(F.lit(1)).alias("docs"), F.sum(size).alias("bytes"), F.sum(F.ceil(size / 262144.0)).alias("chunks"))
    return sums.withColumn("avg_chunk", F.coalesce(F.try_divide(F.col("bytes").cast("double"), "chunks"), F.lit(0.0)))


@register(
    "SELECT l_returnflag, sum(l_quantity) AS total, min(l_quantity) AS least, max(l_quantity) AS most, count(*) AS n FROM lineitem GROUP BY l_returnflag"
)
def kv_sum_by_key(spark, sf_dir):
    mapper = lambda df: df.select(F.col("l_returnflag").alias("key"), F.col("l_quantity").alias("value"))
    aggs = [F.sum("value").alias("total"), F.min("value").alias("least"), F.max("value").alias("most"), F.count(F.lit(1)).alias("n")]
    return map_reduce(table(spark, sf_dir, "lineitem"), mapper, aggs).withColumnRenamed("key", "l_returnflag")


def _map_status(value: str, doc: str) -> Iterator[tuple[str, str]]:
    yield doc, value


def _drop_small(key: str, values: list[str]) -> list[str]:
    return [] if key == "1-URGENT" else values


def _count(key: str, values: Iterator[str], partition: int) -> Iterator[tuple[str, int]]:
    yield key, sum(1 for _ in values)


@register("SELECT o_orderpriority AS key, count(*) AS n FROM orders WHERE o_orderpriority <> '1-URGENT' GROUP BY 1")
def combiner_drops_key(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("doc"), F.col("o_orderstatus").alias("value"))
    return map_reduce(rows, _map_status, PythonReducer(_count, "key string, n bigint"), combiner=_drop_small, num_partitions=8)


def _where(key: str, values: Iterator[str], partition: int) -> Iterator[tuple[int, str]]:
    next(values)  # a reducer may leave the rest of its group unread
    yield partition, key


@register(_with(_W, _VOCAB) + "SELECT (ascii(word) % 7)::INT AS partition, word FROM v")
def custom_partitioner(spark, sf_dir):
    rows = _docs(spark, sf_dir).select(F.col("source").alias("doc"), F.col("text").alias("value"))
    place = python_partition(lambda key, n: ord(key[0]) % n)
    return map_reduce(rows, map_words, PythonReducer(_where, "partition int, word string"), combiner=dedup, partitioner=place, num_partitions=7)


def _words_of(name: str, col: str) -> Query:
    return lambda spark, sf_dir: A.word_count(table(spark, sf_dir, name), col)


for _name, _table, _col in (("html_words", "pages", "html"), ("conversation_words", "conversations", "text")):
    QUERIES[_name] = _words_of(_table, _col)
    ORACLE[_name] = f"SELECT word, count(*) AS n FROM (SELECT {_TOKENS.format(col=_col)} AS word FROM {_table}) GROUP BY word"


@register(
    "WITH w AS ("
    + " UNION ALL ".join(f"SELECT '{t}' AS source, {_TOKENS.format(col='text')} AS word FROM {t}" for t in ("documents", "benchmark", "conversations"))
    + ") "
    + _postings("source")
)
def multi_source_index(spark, sf_dir):
    parts = [table(spark, sf_dir, t).select(F.lit(t).alias("doc"), "text") for t in ("documents", "benchmark", "conversations")]
    return _joined(A.inverted_index(parts[0].unionByName(parts[1]).unionByName(parts[2]), "text", F.col("doc")))


