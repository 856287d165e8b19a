"""Row aggregates over rating columns.

By default 0 means "not answered" and is left out, as null is; with
``zero_missing=False`` it is an ordinary value. The aggregates are sums and
``least``/``greatest`` over the columns rather than array lambdas, which are
interpreted and would leave generated code. They are built as SQL text because one
parsed expression is much cheaper to set up than hundreds of column objects.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def answered(rating: str | Column) -> Column:
    """The rating, or null for the missing code 0."""
    return F.nullif(F.col(rating) if isinstance(rating, str) else rating, F.lit(0))


def filled(rating: str) -> str:
    return f"coalesce({rating}, 0)"


def fill(ratings: list[str], prefix: str = "_a_") -> dict[str, Column]:
    """Columns without nulls (0 = not answered): one projection that keeps later expressions short."""
    return {f"{prefix}{r}": F.expr(filled(r)) for r in ratings}


def _present(rating: str, zero_missing: bool) -> str:
    return f"{filled(rating)} != 0" if zero_missing else f"{rating} is not null"


def _count(ratings: list[str], zero_missing: bool) -> str:
    return "(" + " + ".join(f"cast({_present(r, zero_missing)} as int)" for r in ratings) + ")"


def _sum(ratings: list[str]) -> str:
    return "(" + " + ".join(filled(r) for r in ratings) + ")"


def _squares(ratings: list[str]) -> str:
    return "(" + " + ".join(f"{filled(r)} * {filled(r)}" for r in ratings) + ")"


def count_where(ratings: list[str], test: str, zero_missing: bool = True) -> Column:
    """How many answered ratings satisfy ``test``, e.g. ``"<= 2"``."""
    terms = [f"cast({_present(r, zero_missing)} and {filled(r)} {test} as int)" for r in ratings]
    return F.expr(" + ".join(terms))


def answered_count(ratings: list[str], zero_missing: bool = True) -> Column:
    return F.expr(_count(ratings, zero_missing))


def mean_rating(ratings: list[str], zero_missing: bool = True) -> Column:
    """Mean of the answered ratings; null when none was answered."""
    return F.expr(f"try_divide(cast({_sum(ratings)} as double), cast({_count(ratings, zero_missing)} as double))")


def worst_rating(ratings: list[str]) -> Column:
    """Smallest answered rating; null when none was answered."""
    return F.expr("nullif(least(" + ", ".join(f"if({filled(r)} = 0, 2147483647, {filled(r)})" for r in ratings) + "), 2147483647)")


def best_rating(ratings: list[str]) -> Column:
    return F.greatest(*[F.col(r) for r in ratings])


def moments(ratings: list[str], zero_missing: bool = True) -> dict[str, Column]:
    """Count, sum and sum of squares of the answered ratings as columns ``_n``, ``_s``, ``_ss``."""
    return {"_n": F.expr(_count(ratings, zero_missing)), "_s": F.expr(_sum(ratings)), "_ss": F.expr(_squares(ratings))}


def mean_of_moments() -> Column:
    return F.expr("try_divide(cast(_s as double), cast(_n as double))")


def std_of_moments() -> Column:
    """Sample standard deviation; null below two answers."""
    return F.expr("if(_n >= 2, sqrt(cast(_n * _ss - _s * _s as double) / cast(_n * (_n - 1) as double)), null)")


def median_rating(ratings: list[str]) -> Column:
    """Median of the non-null ratings (mean of the middle two for an even count), 0 being a value."""
    ordered = f"array_sort(array_compact(array({', '.join(ratings)})))"
    n = _count(ratings, False)
    return F.expr(f"cast(get({ordered}, int(({n} - 1) div 2)) + get({ordered}, int({n} div 2)) as double) / 2")
