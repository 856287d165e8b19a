"""Row-wise derived columns and the few train-fitted ones that go with them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.functions import ratings as R
from tabloom.functions import scalars as S
from tabloom.operators.lookup import join_fitted
from tabloom.operators.profile import quantile_lookup
from tabloom.sources.survey import Roles

# Category codes, bin edges, band names, outlier percentiles.
CLASS_CODES = {"Business": 0, "Eco": 1, "Eco Plus": 2}
TRAVEL_CODES = {"Business travel": 0, "Personal Travel": 1}
CUSTOMER_CODES = {"Loyal Customer": 0, "disloyal Customer": 1}
AGE_EDGES = [0, 18, 25, 35, 45, 55, 65, 100]
DISTANCE_EDGES = [0, 500, 1000, 1500, 2000, 3000, 5000]
BAND_EDGES = [0, 1000, 3000, 5000]
BAND_NAMES = ["under_1000", "1000_to_3000", "3000_to_5000", "over_5000"]
DIGIT_EXPONENTS = range(-4, 4)

Builder = Callable[[Roles], Column]


def _zero_if_null(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(0.0))


def registry(boarding: str = "r6") -> dict[str, Builder]:
    """Named derived features; ``boarding`` is the rating crossed with the categories."""
    dep, arr = F.col("dep_delay"), _zero_if_null("arr_delay")
    age, distance = F.col("age"), F.col("distance")
    return {
        "mean_service_rating": lambda o: R.mean_of_moments(),
        "worst_service_rating": lambda o: R.worst_rating(o.ratings).cast("double"),
        "count_of_ratings_at_or_below_2": lambda o: R.count_where(o.ratings, "<= 2"),
        "count_of_5s": lambda o: R.count_where(o.ratings, "= 5"),
        "count_of_1s": lambda o: R.count_where(o.ratings, "= 1"),
        "rating_std": lambda o: R.std_of_moments(),
        "boarding_x_class": lambda o: F.col(boarding) * 10 + S.code_of("class", CLASS_CODES),
        "boarding_x_travel_type": lambda o: F.col(boarding) * 10 + S.code_of("travel_type", TRAVEL_CODES),
        "class_x_customer_type": lambda o: S.code_of("class", CLASS_CODES) * 10 + S.code_of("customer_type", CUSTOMER_CODES),
        "age_bin": lambda o: S.right_closed_bin("age", AGE_EDGES),
        "distance_bin": lambda o: S.right_closed_bin("distance", DISTANCE_EDGES),
        "any_delay": lambda o: S.flag((dep > 0) | (arr > 0)),
        "dep_delayed": lambda o: S.flag(dep > 0),
        "arr_delayed": lambda o: S.flag(arr > 0),
        "delay_over_15min": lambda o: S.flag((dep > 15) | (arr > 15)),
        "age_squared": lambda o: age * age,
        "distance_squared": lambda o: distance * distance,
        "age_over_distance": lambda o: S.ratio(age, distance + 1),
        "delay_over_distance": lambda o: S.ratio(dep + arr, distance + 1),
    }


def add_derived(frame: DataFrame, names: list[str], roles: Roles | None = None, builders: dict[str, Builder] | None = None) -> DataFrame:
    """All named derived columns; an unknown name is an error.

    The ratings are freed of nulls and their count, sum and sum of squares taken
    first, so that the generated code of each projection stays small enough to be
    compiled.
    """
    roles, builders = roles or Roles(), builders or registry()
    unknown = [n for n in names if n not in builders]
    if unknown:
        raise ValueError(f"unknown derived features {unknown}; known: {sorted(builders)}")
    filled = R.fill(roles.ratings)
    inner = replace(roles, ratings=list(filled))
    prepared = frame.withColumns(filled).withColumns(R.moments(inner.ratings))
    return prepared.withColumns({n: builders[n](inner) for n in names}).drop(*filled, "_n", "_s", "_ss")


def recode_missing(frame: DataFrame, ratings: list[str], delay: str, mean_fill: float, mean_name: str = "mean_service_rating") -> DataFrame:
    """0 to null in the ratings, null delay to 0, and the mean rating with a constant for rows without answers."""
    mean = F.coalesce(R.mean_rating(ratings), F.lit(float(mean_fill)))
    return frame.withColumn(mean_name, mean).withColumns({**{c: R.answered(c) for c in ratings}, delay: _zero_if_null(delay)})


def arrival_status(delay: str) -> Column:
    return F.when(F.col(delay).isNull(), "unknown").when(F.col(delay) > 0, "delayed").otherwise("on_time")


def outlier_flags(frame: DataFrame, train: DataFrame, columns: list[str], low: float = 0.01, high: float = 0.99) -> DataFrame:
    """``<c>_is_outlier`` from train percentiles; null counts as inside."""
    q = quantile_lookup(train, columns, [low, high])
    fitted = frame.withColumn("_q", q)
    flags = {
        f"{c}_is_outlier": S.flag((F.col(c) < F.col("_q")[c][0]) | (F.col(c) > F.col("_q")[c][1])) for c in columns
    }
    return fitted.withColumns(flags).drop("_q")


def percentile_clip(frame: DataFrame, train: DataFrame, columns: list[str], low: float, high: float) -> DataFrame:
    """Columns clipped at train percentiles, the same limits for every split."""
    fitted = frame.withColumn("_q", quantile_lookup(train, columns, [low, high]))
    return fitted.withColumns({c: S.clip(F.col(c).cast("double"), F.col("_q")[c][0], F.col("_q")[c][1]) for c in columns}).drop("_q")


def hard_cap_filter(frame: DataFrame, caps: dict[str, float]) -> DataFrame:
    """Rows within all caps; a null value is no reason to drop a row."""
    keep = F.lit(True)
    for c, cap in caps.items():
        keep = keep & (F.col(c).isNull() | (F.col(c) <= cap))
    return frame.where(keep)


def digit_name(column: str, exponent: int) -> str:
    return f"{column}_digit_{'m' if exponent < 0 else 'p'}{abs(exponent)}"


def add_digits(frame: DataFrame, columns: list[str]) -> DataFrame:
    return frame.withColumns({digit_name(c, e): S.decimal_digit(c, e) for c in columns for e in DIGIT_EXPONENTS})


def modular_keys(age: str = "age", distance: str = "distance", delay: str = "dep_delay") -> dict[str, Column]:
    a, d, m = F.col(age).cast("bigint"), F.col(distance).cast("bigint"), F.least(F.col(delay), F.lit(60)).cast("bigint")

    def whole(value: Column, by: int) -> Column:
        return F.call_function("div", value, F.lit(by).cast("bigint"))

    return {
        "distance_mod10": d % 10, "distance_mod100": d % 100, "distance_div10": whole(d, 10), "distance_mod1000": d % 1000,
        "age_mod10": a % 10, "age_div5": whole(a, 5), "delay_div5": whole(m, 5),
    }


def ratios_and_differences() -> dict[str, Column]:
    dep, arr, distance = F.col("dep_delay"), _zero_if_null("arr_delay"), F.col("distance")
    return {
        "delay_per_1000": S.ratio(dep + arr, distance / F.lit(1000.0)),
        "arrival_minus_departure": arr - dep,
        "total_delay": dep + arr,
        "delayed_both_ends": S.flag((dep > 0) & (arr > 0)),
        "delay_ratio": S.ratio(arr, dep + 1),
        "distance_per_age": S.ratio(distance, F.col("age") + 1),
    }


def rating_shape(ratings: list[str]) -> dict[str, Column]:
    """Shape of the raw ratings, 0 being an ordinary value here."""
    raw = {"zero_missing": False}
    return {
        "max_rating": R.best_rating(ratings),
        "median_rating": R.median_rating(ratings),
        "count_at_4_or_5": R.count_where(ratings, ">= 4", **raw),
        "count_at_3": R.count_where(ratings, "= 3", **raw),
    }


def add_rating_extras(frame: DataFrame, ratings: list[str], top_class: str = "Business") -> DataFrame:
    raw = {"zero_missing": False}
    return frame.withColumns(R.moments(ratings, **raw)).withColumns(
        {
            "count_at_5": R.count_where(ratings, "= 5", **raw),
            "spread": R.std_of_moments(),
            "count_at_0": R.count_where(ratings, "= 0", **raw),
            "mean_x_class": R.mean_of_moments() * S.flag(F.col("class") == top_class),
        }
    ).drop("_n", "_s", "_ss")


def add_zero_indicators(frame: DataFrame, ratings: list[str]) -> DataFrame:
    """``<r>_was_zero`` for ratings that ever hold 0; one row decides which."""
    seen = frame.agg(*[F.max(S.flag(F.col(c) == 0)).alias(c) for c in ratings]).first()
    return frame.withColumns({f"{c}_was_zero": S.flag(F.col(c) == 0) for c in ratings if seen[c]})


def pairwise_products(columns: list[str], max_pairs: int | None = None) -> dict[str, Column]:
    """Products of all column pairs; with ``max_pairs``, more pairs are an error, not a silent cut."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    if max_pairs is not None and len(pairs) > max_pairs:
        raise ValueError(f"{len(pairs)} products exceed max_pairs={max_pairs}")
    return {f"{a}_x_{b}": F.col(a) * F.col(b) for a, b in pairs}


def class_relative(frame: DataFrame, train: DataFrame, by: str, columns: list[str]) -> DataFrame:
    """``<c>_rel``: value minus the train mean of its class."""
    means = train.groupBy(by).agg(*[F.avg(c).alias(f"_m_{c}") for c in columns])
    joined = join_fitted(frame, means, [by])
    return joined.withColumns({f"{c}_rel": F.col(c) - F.col(f"_m_{c}") for c in columns}).drop(*[f"_m_{c}" for c in columns])


def standardise(frame: DataFrame, train: DataFrame, columns: list[str], sample: bool = True, eps: float = 0.0) -> DataFrame:
    """``<c>_z`` with train mean and standard deviation (+eps)."""
    spread = F.stddev_samp if sample else F.stddev_pop
    fitted = train.agg(
        F.struct(*[F.struct(F.avg(c).alias("m"), (spread(c) + eps).alias("s")).alias(c) for c in columns])
    ).scalar()
    rows = frame.withColumn("_f", fitted)
    return rows.withColumns({f"{c}_z": (F.col(c) - F.col(f"_f.{c}.m")) / F.col(f"_f.{c}.s") for c in columns}).drop("_f")


def impute_median(frame: DataFrame, train: DataFrame, columns: list[str]) -> DataFrame:
    """Nulls replaced by the exact train median."""
    fitted = frame.withColumn("_q", quantile_lookup(train, columns, [0.5]))
    return fitted.withColumns({c: F.coalesce(F.col(c).cast("double"), F.col("_q")[c][0]) for c in columns}).drop("_q")


def ordinal_bin(value: Column) -> Column:
    """Five ordered classes cut at 1.5, 2.5, 3.5 and 4.5 (left-closed)."""
    return F.when(value < 1.5, 0).when(value < 2.5, 1).when(value < 3.5, 2).when(value < 4.5, 3).otherwise(4)
