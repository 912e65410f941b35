from pyspark.sql import functions as F

from keyloom.functions import atoi, djb2, djb2_mod, part_name, postings_line, tokens
from keyloom.operators import first_letter_partition


def words(spark, *texts):
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    return [r.word for r in tokens(df, "text").collect()]


def test_tokens(spark):
    assert words(spark, "it's A1_b2 -x-") == ["it", "s", "a1", "b2", "x"]
    assert words(spark, "café Straße") == ["caf", "stra", "e"]
    assert words(spark, "Kelvin İx") == ["elvin", "x"]
    assert words(spark, "bar\0baz", None, "", " -- ") == ["bar", "baz"]
    assert words(spark, "z" * 300, "z" * 255 + "y") == ["z" * 255] * 2


def python_djb2(s):
    h = 5381
    for c in s.encode():
        h = (h * 33 + (c - 256 if c > 127 else c)) % (1 << 64)
    return h


def test_djb2(spark):
    given = ["", "a", "foo", "é", "a long key, with more than eight bytes", "日本" * 9]
    df = spark.createDataFrame([(s,) for s in given], "s string")
    got = {r.s: (int(r.h), r.p) for r in df.select("s", djb2(F.col("s")).alias("h"), djb2_mod(F.col("s"), 40).alias("p")).collect()}
    assert got == {s: (python_djb2(s), python_djb2(s) % 40) for s in given}
    assert [got[s][0] for s in given[:3]] == [5381, 177670, 193491849]


def test_small_expressions(spark):
    df = spark.createDataFrame([("12",), (" +7x",), ("-3",), ("abc",), ("",), ("99999999999",)], "v string")
    assert [r[0] for r in df.select(atoi(F.col("v"))).collect()] == [12, 7, -3, 0, 0, 0]
    one = spark.createDataFrame([(7, "k", ["10", "2", "B", "a"])], "p int, k string, d array<string>")
    assert one.select(part_name(F.col("p")), postings_line(F.col("k"), F.col("d"))).first()[:] == ("part-00007.txt", "k -> [10, 2, B, a]")
    keys = spark.createDataFrame([("a",), ("9",), ("z",)], "k string")
    assert [r[0] for r in keys.select(first_letter_partition(F.col("k"), 7)).collect()] == [0, (57 - 97) % 7, 25 % 7]


def test_short_strings_are_hashed_without_lambdas(spark):
    from keyloom.functions import hashing

    given = [c * n for c in ("a", "z", "0", "\x7f", "\x01", "q7") for n in range(0, 14) if len(c * n) <= 13] + ["ab\0", "café", "K" * 3]
    df = spark.createDataFrame([(s,) for s in given], "s string")
    got = {r.s: (int(r.h), r.p) for r in df.select("s", djb2(F.col("s")).alias("h"), djb2_mod(F.col("s"), 7).alias("p")).collect()}
    assert got == {s: (python_djb2(s), python_djb2(s) % 7) for s in given}
    short = df.filter(hashing._is_short(F.col("s")))
    assert {r.s: r.h for r in short.select("s", hashing._short(F.col("s")).alias("h")).collect()} == {s: python_djb2(s) for s in given if s.isascii() and len(s) <= 9}
    assert "lambda" not in short.select(hashing._short(F.col("s")))._jdf.queryExecution().optimizedPlan().toString()


def test_table_functions_get_batches_bounded_by_bytes(spark):
    from keyloom.functions.udtf import register_udtfs

    names = ("spark.sql.execution.arrow.maxBytesPerBatch", "spark.sql.execution.arrow.maxRecordsPerBatch")
    for name in names:
        spark.conf.unset(name)
    register_udtfs(spark)
    assert [int(spark.conf.get(n)) for n in names] == [8 << 20, 4096]


def test_sharded_index_removes_repetitions_inside_a_row_first(spark):
    from keyloom.operators.aggregates import sharded_index

    df = spark.createDataFrame([("a", "x x y"), ("a", "y Y z"), ("b", "x")], "doc string, text string")
    out = sharded_index(df, "text", F.col("doc"), shards=1)
    assert sorted((r.word, r.docs) for r in out.collect()) == [("x", ["a", "b"]), ("y", ["a"]), ("z", ["a"])]
    assert "array_distinct(split" in out._jdf.queryExecution().optimizedPlan().toString()
