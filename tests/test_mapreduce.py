import pytest

from keyloom.apps.inverted_index import POSTINGS, dedup, map_words
from keyloom.apps.word_count import SUM, map_ones
from keyloom.operators import python_partition
from keyloom.operators.mapreduce import PythonReducer, group_reduce, map_reduce


def lines(spark):
    return spark.createDataFrame([("a.txt", "Foo bar"), ("a.txt", "foo"), ("b.txt", "BAR baz"), ("c", None), ("d", "")], "doc string, value string")


def rows(df):
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("n", [1, 7, 40])
@pytest.mark.parametrize("combiner", [None, dedup])
def test_index(spark, n, combiner):
    got = map_reduce(lines(spark), map_words, POSTINGS, combiner=combiner, num_partitions=n)
    assert rows(got) == [("bar", "a.txt, b.txt"), ("baz", "b.txt"), ("foo", "a.txt")]
    assert got.rdd.getNumPartitions() == n


def test_counts(spark):
    assert rows(map_reduce(lines(spark), map_ones, SUM, num_partitions=3)) == [("bar", 2), ("baz", 1), ("foo", 2)]


def test_empty_keys_and_values_stay(spark):
    out = map_reduce(lines(spark).limit(1), lambda v, d: [("", "")], PythonReducer(lambda k, vs, p: [(k, "|".join(vs))]), num_partitions=2)
    assert rows(out) == [("", "")]


def test_group_across_batches_is_reduced_once_in_key_order(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")
    pairs = spark.range(500).selectExpr("cast(id % 5 as string) key", "cast(id as string) value")
    seen = PythonReducer(lambda k, vs, p: [(k, sum(1 for _ in vs), p)], "key string, n int, p int")
    got = [tuple(r) for r in group_reduce(pairs, seen, 2, python_partition(lambda k, n: int(k))).collect()]
    assert [g for g in got if g[2] == 0] == [("0", 100, 0), ("2", 100, 0), ("4", 100, 0)]
    assert [g for g in got if g[2] == 1] == [("1", 100, 1), ("3", 100, 1)]
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_early_stop_and_out_of_range_partitions(spark):
    pairs = spark.range(40).selectExpr("cast(id % 4 as string) key", "'v' value")
    first = PythonReducer(lambda k, vs, p: [(k, next(vs), p)], "key string, v string, p int")
    got = group_reduce(pairs, first, 3, python_partition(lambda k, n: -1 if k == "0" else n + int(k)))
    assert rows(got) == [("0", "v", 2), ("1", "v", 1), ("2", "v", 2), ("3", "v", 0)]


def test_combiner_may_drop_a_key(spark):
    got = map_reduce(lines(spark), map_words, POSTINGS, combiner=lambda k, vs: [] if k == "bar" else vs, num_partitions=2)
    assert [k for k, _ in rows(got)] == ["baz", "foo"]


def test_a_partition_of_a_large_input_is_several_tasks(spark, monkeypatch, tmp_path):
    """Keys stay whole and in their partition, however many tasks it is."""
    from keyloom.operators import mapreduce

    monkeypatch.setattr(mapreduce, "TASK_BYTES", 1000)
    words = [f"w{i % 300}" for i in range(3000)]
    spark.createDataFrame([("d", " ".join(words[i : i + 10])) for i in range(0, 3000, 10)], "doc string, value string").write.parquet(str(tmp_path / "t"))
    place = python_partition(lambda k, n: int(k[1:]))
    seen = PythonReducer(lambda k, vs, p: [(k, sum(1 for _ in vs), p)], "key string, n int, p int")
    got = map_reduce(spark.read.parquet(str(tmp_path / "t")), map_words, seen, partitioner=place, num_partitions=7)
    assert got.rdd.getNumPartitions() > 7
    assert rows(got) == sorted((f"w{i}", 10, i % 7) for i in range(300))


@pytest.mark.parametrize("held", [1, 3, 10**6])
def test_combining_takes_more_than_a_piece(spark, monkeypatch, held):
    """One value a key and flush leaves the map task; the count of emits is that of the mapper."""
    from pyspark.sql import functions as F

    from keyloom.apps.word_count import add_up
    from keyloom.operators import mapreduce

    monkeypatch.setattr(mapreduce, "PIECE", 2)
    monkeypatch.setattr(mapreduce, "HELD", held)
    df = spark.createDataFrame([("a", "x y x z x"), ("b", "x y"), ("c", "")], "doc string, value string").coalesce(1)
    found = mapreduce.emitted(df, map_ones, add_up)
    assert found.agg(F.sum("emits")).first()[0] == 7
    assert mapreduce.pairs_only(found).count() == {1: 7, 3: 5, 10**6: 3}[held]
    assert rows(map_reduce(df, map_ones, SUM, combiner=add_up, num_partitions=2)) == [("x", 4), ("y", 2), ("z", 1)]
