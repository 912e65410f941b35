"""Column expressions over text; all run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_TOKEN = 255
#: ASCII only. One predicate: a class of ranges is a union of several, at whose type checks the JVM's threads contend (8 threads took 10 times as long).
_DELIMITERS = r"\P{Alnum}+"


def _normal(word: Column) -> Column:
    # Lower-case after extraction: lower() on raw text maps some non-ASCII letters to ASCII.
    return F.lower(F.left(word, F.lit(MAX_TOKEN)))


def token_array(text: Column) -> Column:
    """Array of ASCII alphanumeric tokens, lower case, at most 255 characters each."""
    return F.filter(F.transform(F.split(text, _DELIMITERS), _normal), lambda w: w != "")


def distinct_token_array(text: Column) -> Column:
    """Distinct tokens, each cut to ``MAX_TOKEN`` characters; lambdas over tokens, which are interpreted, only where one is longer."""
    own = F.replace(F.replace(text, F.lit("\u212a"), F.lit(" ")), F.lit("\u0130"), F.lit(" "))  # what lower() makes ASCII letters of
    lower = F.lower(own)
    plain = F.array_remove(F.array_distinct(F.split(lower, _DELIMITERS)), "")
    return F.when(text.rlike(rf"\p{{Alnum}}{{{MAX_TOKEN + 1}}}"), F.array_distinct(token_array(text))).otherwise(plain)


def tokens(df: DataFrame, text: str, *keep: str, into: str = "word") -> DataFrame:
    """One row per token of ``text``, with the columns ``keep`` beside it; null text gives none."""
    raw = df.select(*keep, F.explode(F.split(F.col(text), _DELIMITERS)).alias("_raw"))
    return raw.filter(F.col("_raw") != "").select(*keep, _normal(F.col("_raw")).alias(into))


def atoi(value: Column) -> Column:
    """Leading integer of a string, 0 where there is none (or where it does not fit 32 bits)."""
    digits = F.regexp_extract(value, r"^\s*([+-]?[0-9]+)", 1)
    return F.coalesce(digits.try_cast("int"), F.lit(0))


def part_name(partition: Column) -> Column:
    return F.format_string("part-%05d.txt", partition)


def postings_line(key: Column, docs: Column) -> Column:
    return F.concat(key, F.lit(" -> ["), F.array_join(docs, ", "), F.lit("]"))
