"""Registry of queries and the SQL texts that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from tabloom.session import ship_package, tune

QueryFn = Callable[[SparkSession, str], DataFrame]

SURVEY_SQL = """
select *, case when 3*r6 + r1 + r7 + r8 + case when class = 'Business' then 6 else 0 end
               + (id*17) % 11 >= 26 then 1 else 0 end as label
from (
  select o_orderkey as id, o_custkey,
    7 + (o_custkey*7) % 79 as age, 67 + 123*(o_custkey % 40) as distance,
    greatest(0, (o_orderkey*13) % 97 - 80) as dep_delay,
    case when o_orderkey % 211 = 0 then null
         else cast(greatest(0, (o_orderkey*13) % 97 - 82) as double) end as arr_delay,
    case when n_nationkey % 2 = 0 then 'Female' else 'Male' end as gender,
    case when c_mktsegment in ('BUILDING','MACHINERY','HOUSEHOLD','FURNITURE')
         then 'Loyal Customer' else 'disloyal Customer' end as customer_type,
    case when o_orderstatus = 'F' then 'Personal Travel' else 'Business travel' end as travel_type,
    case when o_orderpriority in ('1-URGENT','2-HIGH') then 'Business'
         when o_orderpriority = '3-MEDIUM' then 'Eco Plus' else 'Eco' end as class,
    cast(floor((o_orderkey*3+o_custkey*5)/7) as bigint) % 6 as r1,
    cast(floor((o_orderkey*7+o_custkey*11)/5) as bigint) % 6 as r2,
    cast(floor((o_orderkey*11+o_custkey*3)/9) as bigint) % 6 as r3,
    cast(floor((o_orderkey*13+o_custkey*17)/4) as bigint) % 6 as r4,
    cast(floor((o_orderkey*17+o_custkey*7)/6) as bigint) % 6 as r5,
    cast(floor((o_orderkey*5+o_custkey*19)/8) as bigint) % 6 as r6,
    cast(floor((o_orderkey*19+o_custkey*13)/5) as bigint) % 6 as r7,
    cast(floor((o_orderkey*23+o_custkey*5)/7) as bigint) % 6 as r8,
    cast(floor((o_orderkey*29+o_custkey*11)/3) as bigint) % 6 as r9,
    cast(floor((o_orderkey*31+o_custkey*2)/9) as bigint) % 6 as r10,
    cast(floor((o_orderkey*37+o_custkey*23)/4) as bigint) % 5 + 1 as r11,
    cast(floor((o_orderkey*41+o_custkey*3)/8) as bigint) % 6 as r12,
    cast(floor((o_orderkey*43+o_custkey*29)/6) as bigint) % 6 as r13
  from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey) b
"""


@dataclass(frozen=True)
class Entry:
    name: str
    ops: tuple[str, ...]
    run: QueryFn
    sql: str | None
    note: str


ENTRIES: dict[str, Entry] = {}


def query(name: str, *ops: str, sql: str | None = None, note: str = ""):
    """Register ``fn(spark, sf_dir)`` under ``name`` for the inventory rows ``ops``."""

    def register(fn: QueryFn) -> QueryFn:
        if name in ENTRIES:
            raise ValueError(f"query {name} registered twice")

        @wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            tune(spark)
            ship_package(spark)
            return fn(spark, sf_dir)

        ENTRIES[name] = Entry(name, ops, run, sql, note)
        return fn

    return register


def survey_sql(select: str, **ctes: str) -> str:
    """SQL over the ``survey`` table; ``ctes`` follow it in the given order."""
    parts = [f"survey as ({SURVEY_SQL})"] + [f"{name} as ({body})" for name, body in ctes.items()]
    return "with " + ",\n".join(parts) + "\n" + select


def plain_sql(select: str, **ctes: str) -> str:
    parts = [f"{name} as ({body})" for name, body in ctes.items()]
    return ("with " + ",\n".join(parts) + "\n" if parts else "") + select


def rd(expr: str, digits: int = 6) -> str:
    """Rounded SQL expression without a negative zero."""
    return f"(round(cast({expr} as double), {digits}) + 0.0)"
