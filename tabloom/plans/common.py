"""Pieces shared by several query modules: SQL fragments and Spark twins of them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tabloom.plans.registry import rd
from tabloom.sources.survey import CATEGORICAL, CONTINUOUS, NUMERIC, RATINGS, RAW_FEATURES, SECOND_LABEL, SECOND_RULE, rating_rules

SEED = 42
FOLDS = 5
SMOOTHING = 20

TRAIN = "select * from survey where id % 10 < 7"
SECOND = (
    f"select k as id, {', '.join(RAW_FEATURES)}, {SECOND_LABEL} from (select k, {', '.join(SECOND_RULE)}, {', '.join(rating_rules('k', 'l_partkey'))} "
    "from (select l_orderkey * 8 + l_linenumber as k, * from lineitem) l) s"
)


def r(column: str | Column, digits: int = 6) -> Column:
    """Rounded double; the twin of ``registry.rd``."""
    column = F.col(column) if isinstance(column, str) else column
    return F.round(column.cast("double"), digits)


def hash_hex_sql(key: str = "id", seed: int | str = SEED) -> str:
    return f"md5(concat('{seed}:', cast({key} as varchar)))"


def hash_number_sql(key: str = "id", seed: int | str = SEED) -> str:
    return f"cast(('0x' || substr({hash_hex_sql(key, seed)}, 1, 8)) as bigint)"


def hash_fold_sql(key: str = "id", seed: int | str = SEED, k: int = FOLDS) -> str:
    return f"cast({hash_number_sql(key, seed)} % {k} as integer)"


def strat_fold_sql(seed: int | str = SEED, k: int = FOLDS, key: str = "id", label: str = "label") -> str:
    return f"cast((row_number() over (partition by {label} order by {hash_hex_sql(key, seed)}, {key}) - 1) % {k} as integer)"


# Train rows with stratified folds, as a SQL common table expression body.
FOLDED = f"select *, {strat_fold_sql()} as fold from survey where id % 10 < 7"


def unpivot_sql(source: str, columns: list[str], keep: list[str] = (), cast: str = "double") -> str:
    kept = "".join(f"{k}, " for k in keep)
    return " union all ".join(
        f"select {kept}'{c}' as feature, cast({c} as {cast}) as value from {source}" for c in columns
    )


def auc_sql(source: str, score: str, label: str = "label", by: list[str] = (), where: str = "true") -> str:
    """Tie-averaged AUC per group; the window runs over distinct scores."""
    g = "".join(f"{b}, " for b in by)
    part = f"partition by {', '.join(by)} " if by else ""
    group = f"group by {', '.join(by)}" if by else ""
    return (
        f"select {g}cast(sum(pos) as bigint) as n_pos, cast(sum(neg) as bigint) as n_neg, "
        f"sum(pos * (coalesce(below, 0) + neg / 2.0)) / (cast(sum(pos) as double) * sum(neg)) as auc from ("
        f"select *, sum(neg) over ({part}order by s rows between unbounded preceding and 1 preceding) as below from ("
        f"select {g}{score} as s, sum(cast({label} as bigint)) as pos, sum(1 - cast({label} as bigint)) as neg "
        f"from {source} where {where} and {score} is not null group by {g}{score}) c) w {group}"
    )


__all__ = [
    "SEED", "FOLDS", "SMOOTHING", "TRAIN", "FOLDED", "r", "rd", "hash_hex_sql", "hash_number_sql", "hash_fold_sql",
    "strat_fold_sql", "unpivot_sql", "auc_sql", "RATINGS", "CONTINUOUS", "CATEGORICAL", "NUMERIC",
]
