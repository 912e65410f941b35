"""Inverted index of text files, as a native job and as Python callables."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyloom.functions.text import postings_line, tokens
from keyloom.operators.mapreduce import PythonReducer
from keyloom.plans.job import Job

_WORD = re.compile(r"[0-9A-Za-z]+")


def map_words(value: str, doc: str) -> Iterator[tuple[str, str]]:
    for word in _WORD.findall(value):
        yield word[:255].lower(), doc


def dedup(key: str, values: list[str]) -> Iterable[str]:
    return dict.fromkeys(values)


def postings(key: str, values: Iterator[str], partition: int) -> Iterator[tuple[str, str]]:
    docs = sorted(set(values), key=str.encode)
    if docs:
        yield key, ", ".join(docs)


POSTINGS = PythonReducer(postings, "word string, postings string")


def native_mapper(df: DataFrame) -> DataFrame:
    return tokens(df, "value", "doc", into="key").withColumnRenamed("doc", "value")


def doc_sets() -> list[Column]:
    return [F.array_sort(F.collect_set("value")).alias("docs")]


INVERTED_INDEX = Job(mapper=native_mapper, reducer=doc_sets, line=lambda df: postings_line(F.col("key"), F.col("docs")))
