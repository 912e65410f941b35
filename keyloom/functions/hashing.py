"""The 64-bit times-33 string hash as a column expression.

The state is kept as two 32-bit halves in longs, so no step overflows under
ANSI arithmetic. Bytes at or above 0x80 count as signed, as on x86-64 Linux.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_LOW = (1 << 32) - 1
#: ASCII strings of up to so many characters hash to less than 2 ** 63.
_SHORT = 9


def _bytes(text: Column) -> Column:
    digits = F.hex(F.encode(text, "UTF-8"))
    count = F.length(digits) / 2
    index = F.when(count > 0, F.sequence(F.lit(1), count.cast("int"))).otherwise(F.array().cast("array<int>"))
    value = lambda i: F.conv(F.substring(digits, i * 2 - 1, F.lit(2)), 16, 10).cast("long")
    return F.transform(index, lambda i: F.when(value(i) > 127, value(i) - 256).otherwise(value(i)))


def _is_plain(text: Column) -> Column:
    return F.length(text) == F.octet_length(text)


def _is_short(text: Column) -> Column:
    return _is_plain(text) & (F.length(text) <= _SHORT)


def _short(text: Column) -> Column:
    """Of a short ASCII string, in generated code: with zeros for the characters that are missing, and so a power of 33 too much."""
    h = F.lit(5381).cast("long")
    for i in range(_SHORT):
        h = h * 33 + F.ascii(F.substring(text, i + 1, 1))
    powers = F.array(*[F.lit(33 ** (_SHORT - i)).cast("long") for i in range(_SHORT + 1)])
    return F.call_function("div", h, F.element_at(powers, F.length(text) + 1))


def _hashed(text: Column, finish: Callable[[Column], Column]) -> Column:
    """``finish`` of the last state. What is ASCII only needs no bytes: its characters are taken one by one, as lambdas are interpreted."""

    def fold(values: Column, value: Callable[[Column], Column]) -> Column:
        def step(acc: Column, x: Column) -> Column:
            low = acc["lo"] * 33 + value(x)
            high = acc["hi"] * 33 + F.shiftright(low, 32)
            return F.struct(high.bitwiseAND(F.lit(_LOW)).alias("hi"), low.bitwiseAND(F.lit(_LOW)).alias("lo"))

        start = F.struct(F.lit(0).cast("long").alias("hi"), F.lit(5381).cast("long").alias("lo"))
        return F.aggregate(values, start, step, finish)

    plain = _is_plain(text) & (text != "")  # an empty text splits into one empty string
    return F.when(plain, fold(F.split(text, ""), F.ascii)).otherwise(fold(_bytes(text), lambda c: c))


def djb2(text: Column) -> Column:
    """The unsigned hash as ``decimal(20,0)``."""

    def whole(state: Column) -> Column:
        return (state["hi"].cast("decimal(20,0)") * F.lit(1 << 32).cast("decimal(10,0)") + state["lo"].cast("decimal(20,0)")).cast("decimal(20,0)")

    return F.when(_is_short(text), _short(text).cast("decimal(20,0)")).otherwise(_hashed(text, whole))


def djb2_mod(text: Column, n: int) -> Column:
    """``hash mod n`` as int, without leaving 64-bit arithmetic."""
    mixed = _hashed(text, lambda state: (((state["hi"] % n) * ((1 << 32) % n) + state["lo"] % n) % n).cast("int"))
    return F.when(_is_short(text), (_short(text) % n).cast("int")).otherwise(mixed)
