"""Table functions for SQL: a mapper as ``LATERAL`` call."""

from __future__ import annotations

import re

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from keyloom.functions.text import MAX_TOKEN
from keyloom.sources.tables import bounded_batches

_WORD = re.compile(r"[0-9A-Za-z]+")


class Words:
    """``words(text)``: one row ``(word)`` per token of a text, none for null."""

    def eval(self, text: str):
        for m in _WORD.finditer(text or ""):
            yield (m.group()[:MAX_TOKEN].lower(),)


def register_udtfs(spark: SparkSession) -> None:
    """The table functions; a worker holds a batch of texts, which is bounded by bytes."""
    bounded_batches(spark)
    spark.udtf.register("words", udtf(Words, returnType="word string", useArrow=True))
