"""The wide survey table, derived from the order and customer tables.

Every value is a fixed arithmetic rule over order and customer keys, so the table
grows with its inputs: one row per order.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.sources.tables import read_table

# Column roles.
RATINGS = [f"r{i}" for i in range(1, 14)]
CONTINUOUS = ["age", "distance", "dep_delay", "arr_delay"]
CATEGORICAL = ["gender", "customer_type", "travel_type", "class"]
RAW_FEATURES = RATINGS + CONTINUOUS + CATEGORICAL
NUMERIC = RATINGS + CONTINUOUS

# Fixed values: (order factor, customer factor, divisor, modulus, offset) of r1..r13.
RATING_RULE = [
    (3, 5, 7, 6, 0), (7, 11, 5, 6, 0), (11, 3, 9, 6, 0), (13, 17, 4, 6, 0), (17, 7, 6, 6, 0),
    (5, 19, 8, 6, 0), (19, 13, 5, 6, 0), (23, 5, 7, 6, 0), (29, 11, 3, 6, 0), (31, 2, 9, 6, 0),
    (37, 23, 4, 5, 1), (41, 3, 8, 6, 0), (43, 29, 6, 6, 0),
]


@dataclass(frozen=True)
class Roles:
    """Which column plays which part; nothing in the library is tied to one table."""

    key: str = "id"
    label: str = "label"
    ratings: list[str] = field(default_factory=lambda: list(RATINGS))
    continuous: list[str] = field(default_factory=lambda: list(CONTINUOUS))
    categorical: list[str] = field(default_factory=lambda: list(CATEGORICAL))

    @property
    def features(self) -> list[str]:
        return self.ratings + self.continuous + self.categorical


def rating_rules(row: str, person: str) -> list[str]:
    return [
        f"cast(floor(({row} * {a} + {person} * {b}) / {d}) as bigint) % {m} + {off} as {name}" for name, (a, b, d, m, off) in zip(RATINGS, RATING_RULE)
    ]


#: The second table's other columns by the key ``k`` of a line and its part.
SECOND_RULE = [
    "7 + (l_partkey * 7) % 79 as age", "67 + 123 * (l_partkey % 40) as distance", "greatest(0, (k * 13) % 97 - 80) as dep_delay",
    "case when k % 211 = 0 then null else cast(greatest(0, (k * 13) % 97 - 82) as double) end as arr_delay",
    "case when l_suppkey % 2 = 0 then 'Female' else 'Male' end as gender",
    "case when l_quantity < 40 then 'Loyal Customer' else 'disloyal Customer' end as customer_type",
    "case when l_linestatus = 'F' then 'Personal Travel' else 'Business travel' end as travel_type",
    "case when l_returnflag = 'R' then 'Business' when l_returnflag = 'A' then 'Eco Plus' else 'Eco' end as class",
]
SECOND_LABEL = "case when 3 * r6 + r1 + r7 + r8 + case when class = 'Business' then 6 else 0 end + (k * 19) % 13 >= 27 then 1 else 0 end as label"


def second_survey(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second, independently collected table with the columns and label of the survey and rows of its own: one per line item."""
    lines = read_table(spark, sf_dir, "lineitem", ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_linestatus", "l_returnflag"])
    keyed = lines.selectExpr("l_orderkey * 8 + l_linenumber as k", "*")
    return keyed.selectExpr("k", *SECOND_RULE, *rating_rules("k", "l_partkey")).selectExpr("k as id", *RAW_FEATURES, SECOND_LABEL)


def survey(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order with id, 13 ratings, 4 continuous and 4 categorical columns, label."""
    orders = read_table(spark, sf_dir, "orders", ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"])
    customers = read_table(spark, sf_dir, "customer", ["c_custkey", "c_nationkey", "c_mktsegment"])
    nations = read_table(spark, sf_dir, "nation", ["n_nationkey"])
    joined = orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).join(
        nations, F.col("c_nationkey") == F.col("n_nationkey")
    )
    ratings = rating_rules("o_orderkey", "o_custkey")
    base = joined.selectExpr(
        "o_orderkey as id",
        "o_custkey",
        "7 + (o_custkey * 7) % 79 as age",
        "67 + 123 * (o_custkey % 40) as distance",
        "greatest(0, (o_orderkey * 13) % 97 - 80) as dep_delay",
        "if(o_orderkey % 211 = 0, null, cast(greatest(0, (o_orderkey * 13) % 97 - 82) as double)) as arr_delay",
        "if(n_nationkey % 2 = 0, 'Female', 'Male') as gender",
        "if(c_mktsegment in ('BUILDING', 'MACHINERY', 'HOUSEHOLD', 'FURNITURE'), 'Loyal Customer', 'disloyal Customer') as customer_type",
        "if(o_orderstatus = 'F', 'Personal Travel', 'Business travel') as travel_type",
        "case when o_orderpriority in ('1-URGENT', '2-HIGH') then 'Business' when o_orderpriority = '3-MEDIUM' then 'Eco Plus' else 'Eco' end as class",
        *ratings,
    )
    points = "3 * r6 + r1 + r7 + r8 + if(class = 'Business', 6, 0) + (id * 17) % 11"
    return base.selectExpr("*", f"if({points} >= 26, 1, 0) as label")


def is_train():
    """Labelled rows: seven ids out of ten, the 70/30 cut of the survey."""
    return F.col("id") % 10 < 7


def survey_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The survey with ``split`` = train / score; the label of rows to score is hidden."""
    return survey(spark, sf_dir).select(
        *[c for c in ["id", "o_custkey", *CONTINUOUS, *CATEGORICAL, *RATINGS]],
        F.when(is_train(), F.col("label")).alias("label"),
        F.when(is_train(), "train").otherwise("score").alias("split"),
    )
