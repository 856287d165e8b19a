"""Small column expressions: bins, code maps, digits, logits, safe division."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(value: str | Column) -> Column:
    return F.col(value) if isinstance(value, str) else value


def right_closed_bin(value: str | Column, edges: list[float]) -> Column:
    """Index of the right-closed bin ``(edges[i], edges[i+1]]``; -1 outside and for null."""
    value = _c(value)
    chain = F.when(value.isNull() | (value <= edges[0]), F.lit(-1))
    for index, upper in enumerate(edges[1:]):
        chain = chain.when(value <= upper, F.lit(index))
    return chain.otherwise(F.lit(-1))


def right_closed_band(value: str | Column, edges: list[float], names: list[str]) -> Column:
    """Name of the right-closed band; the last band has no upper end, null outside."""
    value = _c(value)
    chain = F.when(value.isNull() | (value <= edges[0]), F.lit(None).cast("string"))
    for upper, name in zip(edges[1:], names):
        chain = chain.when(value <= upper, F.lit(name))
    return chain.otherwise(F.lit(names[-1])) if len(names) == len(edges) else chain


def code_of(value: str | Column, codes: dict[str, int], default: int | None = 0) -> Column:
    """Integer code of a category; ``default`` for values outside the map."""
    value = _c(value)
    chain = F.when(F.lit(False), F.lit(0))
    for level, code in codes.items():
        chain = chain.when(value == level, F.lit(code))
    return chain if default is None else chain.otherwise(F.lit(default))


def decimal_digit(value: str | Column, exponent: int, shift: int = 4) -> Column:
    """Digit of ``|value|`` at ``10**exponent``, read from an integer; null gives 0."""
    scaled = F.rint(F.abs(_c(value).cast("double")) * float(10**shift)).cast("bigint")
    place = 10 ** (exponent + shift)
    shifted = F.call_function("div", scaled, F.lit(place).cast("bigint"))
    return F.coalesce(shifted % F.lit(10), F.lit(0)).cast("int")


def clip(value: str | Column, low, high) -> Column:
    """Value forced into [low, high]; null stays null."""
    value = _c(value)
    low = low if isinstance(low, Column) else F.lit(low)
    high = high if isinstance(high, Column) else F.lit(high)
    return F.when(value.isNotNull(), F.least(F.greatest(value, low), high))


def logit(probability: str | Column, eps: float = 1e-6) -> Column:
    p = clip(probability, eps, 1.0 - eps)
    return F.ln(p / (F.lit(1.0) - p))


def sigmoid(margin: str | Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-_c(margin)))


def ratio(numerator: Column, denominator: Column, undefined: float | None = None) -> Column:
    """Division that yields ``undefined`` where the denominator is 0."""
    value = F.try_divide(numerator.cast("double"), denominator.cast("double"))
    return value if undefined is None else F.coalesce(value, F.lit(float(undefined)))


def flag(condition: Column) -> Column:
    """0/1 column; null conditions count as 0."""
    return F.coalesce(condition, F.lit(False)).cast("int")


def text_key(columns: list[str | Column], sep: str = "|") -> Column:
    """Several values as one text that tells all combinations apart: the separator and the escape are escaped, null is ``\\N``."""

    def one(c: str | Column) -> Column:
        text = (F.col(c) if isinstance(c, str) else c).cast("string")
        return F.coalesce(F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit(sep), F.lit("\\" + sep)), F.lit("\\N"))

    return F.concat_ws(sep, *[one(c) for c in columns])
