"""Word count of text files."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column
from pyspark.sql import functions as F

from keyloom.apps.inverted_index import map_words, native_mapper
from keyloom.operators.mapreduce import PythonReducer
from keyloom.plans.job import Job


def map_ones(value: str, doc: str) -> Iterator[tuple[str, str]]:
    for word, _ in map_words(value, doc):
        yield word, "1"


def add_up(key: str, values: list[str]) -> list[str]:
    return [str(sum(map(int, values)))]


def add(key: str, values: Iterator[str], partition: int) -> Iterator[tuple[str, int]]:
    yield key, sum(int(v) for v in values)


SUM = PythonReducer(add, "word string, n bigint")


def counts() -> list[Column]:
    return [F.count(F.lit(1)).alias("n")]


WORD_COUNT = Job(mapper=native_mapper, reducer=counts, line=lambda df: F.concat_ws(": ", "key", "n"))
