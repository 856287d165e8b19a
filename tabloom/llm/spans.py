"""Regular-expression matches with their places, in plain SQL functions.

``split`` yields what lies between the matches and ``regexp_extract_all`` the matches; their lengths add up to the places, in
code points. Texts that do not match at all never build the arrays.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCK = 128
SPAN = "array<struct<start:int,stop:int,value:string>>"


def _lit(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def found(text: str, pattern: str, may: str | None = None, value: int = 0) -> Column:
    """Array of (start, stop, value) of the leftmost non-overlapping matches in column ``text``; ``value`` is a group.

    ``may`` is a cheaper SQL condition that every text with a match meets.
    """
    p = _lit(pattern)
    pieces = (
        f"zip_with(zip_with(slice(split({text}, {p}, -1), 1, size(regexp_extract_all({text}, {p}, 0))), regexp_extract_all({text}, {p}, 0), "
        f"(g, m) -> struct(length(g) as gap, length(m) as size)), regexp_extract_all({text}, {p}, {value}), (x, v) -> struct(x.gap as gap, x.size as size, v as value))"
    )
    # running totals in blocks: appending to one array per match would take quadratic time in texts with very many
    block = (
        f"aggregate(slice(p, {BLOCK} * k + 1, {BLOCK}), struct(0 as at, cast(array() as {SPAN}) as spans), (acc, x) -> struct(acc.at + x.gap + x.size as at, "
        "array_append(acc.spans, struct(acc.at + x.gap as start, acc.at + x.gap + x.size as stop, x.value as value)) as spans))"
    )
    shifted = "transform(c.spans, s -> struct(acc.at + s.start as start, acc.at + s.stop as stop, s.value as value))"
    spans = (
        f"transform(array({pieces}), p -> flatten(aggregate(transform(sequence(0, cast((size(p) - 1) div {BLOCK} as int)), k -> {block}), "
        f"struct(0 as at, cast(array() as array<{SPAN}>) as parts), (acc, c) -> struct(acc.at + c.at as at, array_append(acc.parts, {shifted}) as parts), acc -> acc.parts)))[0]"
    )
    return F.expr(f"case when {may or f'{text} rlike {p}'} then {spans} else cast(array() as {SPAN}) end")


def tagged(spans: str, kind: str, place: int) -> str:
    return f"transform({spans}, s -> struct(s.start as start, {place} as place, s.stop as stop, '{kind}' as kind))"


def listed(spans: str) -> str:
    """kind:start:end, comma-joined in array order."""
    return f"array_join(transform({spans}, s -> concat(s.kind, ':', s.start, ':', s.stop)), ',')"


def normal_tail(z: str) -> str:
    """Upper tail of the standard normal distribution, absolute error below 1e-7 (rational approximation), at least 1e-7."""
    t = f"(1 / (1 + 0.3275911 * abs({z}) / sqrt(2)))"
    poly = f"({t} * (0.254829592 + {t} * (-0.284496736 + {t} * (1.421413741 + {t} * (-1.453152027 + {t} * 1.061405429)))))"
    half = f"(0.5 * {poly} * exp(-({z}) * ({z}) / 2))"
    return f"greatest(1e-7, case when {z} >= 0 then {half} else 1 - {half} end)"
