"""Mixing sources to target weights by hierarchical budgets.

Sources hang in a tree (domain, language, source). A leaf's capacity is ``epochs`` times its tokens, a node's the sum of its
children's. Budgets go down the tree: siblings share their parent's budget by weight, none above its capacity, and what a full
sibling cannot take is shared among the others by weight. As no parent gets more than its children can hold, a shortage leaves
a family only if all siblings are full, and then goes to the other children of the nearest ancestor.

Each leaf fills its budget from seeded epochs: whole passes over its documents, then a prefix in that epoch's order, cut
inside the last document. All arithmetic is in whole numbers (rounded down: less than a token a child stays unassigned).

DataFrame and SQL functions only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tabloom.llm.common import fitted

DIGITS = 3  # leading hexadecimal digits of the order key: 4096 parts of a leaf
WIDE = "decimal(19,0)"


@dataclass(frozen=True)
class Level:
    """One level of the tree: the node a document belongs to and that node's weight among its siblings (whole, 0 excludes)."""

    name: str
    node: Column
    weight: Column


def word_tokens(text: Column) -> Column:
    """Tokens of a text: its whitespace-separated words; null and empty texts have none."""
    shrunk = F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\x20\x09-\x0D]+", "a")
    return F.length(F.regexp_replace(shrunk, r"[\x20\x09-\x0D]+", "")).cast("long")


def share(budgets: DataFrame, children: DataFrame, parent: list[str]) -> DataFrame:
    """``children`` (``parent`` columns, name, capacity, weight) with their part ``budget`` of the parent's ``budget``.

    In order of capacity per weight, a child is full if the level that it and the later ones could reach is at least its own;
    the others share what the full ones leave, by weight. One row per node of the tree, never per document.
    """
    siblings = W.partitionBy(*parent)
    by_level = siblings.orderBy(F.col("capacity") / F.col("weight"), *[c for c in children.columns if c not in (*parent, "capacity", "weight")])
    earlier = by_level.rowsBetween(W.unboundedPreceding, -1)
    rows = (
        children.where("weight > 0").join(budgets.select(*parent, F.col("budget").alias("_all")), parent)
        .withColumn("_rest", F.col("_all") - F.coalesce(F.sum("capacity").over(earlier), F.lit(0)))
        .withColumn("_open", F.sum("weight").over(siblings) - F.coalesce(F.sum("weight").over(earlier), F.lit(0)))
        .withColumn("_full", F.expr(f"cast(capacity as {WIDE}) * cast(_open as {WIDE}) <= cast(_rest as {WIDE}) * cast(weight as {WIDE})"))
    )
    # `_rest` falls and `_open` falls along the order, so the first open child is the one with the largest of both
    for c in ("_rest", "_open"):
        rows = rows.withColumn(f"{c}_level", F.max(F.when(~F.col("_full"), F.col(c))).over(siblings))
    part = f"cast(cast(weight as {WIDE}) * cast(_rest_level as {WIDE}) div cast(_open_level as {WIDE}) as bigint)"
    return rows.withColumn("budget", F.expr(f"case when _full then capacity else {part} end")).drop(
        "_all", "_rest", "_open", "_full", "_rest_level", "_open_level"
    )


def leaf_budgets(leaves: DataFrame, levels: list[Level], budget_share: tuple[int, int], epochs: int) -> DataFrame:
    """One row per leaf: level columns, available tokens, budget."""
    names = [level.name for level in levels]
    nodes = leaves.withColumn("capacity", F.col("available") * epochs).withColumn("_root", F.lit(0))
    for level in levels:
        nodes = nodes.withColumn(f"_w_{level.name}", F.coalesce(level.weight.cast("long"), F.lit(0)))
    nodes = nodes.where(" and ".join(f"_w_{n} > 0" for n in names))
    up, down = budget_share
    budgets = leaves.agg(F.coalesce(F.sum("available"), F.lit(0)).alias("all")).select(F.lit(0).alias("_root"), F.expr(f"all * {up} div {down}").alias("budget"))
    total = nodes.groupBy("_root").agg(F.sum("capacity").alias("capacity"))
    budgets = budgets.join(total, "_root").select("_root", F.least("budget", "capacity").alias("budget"))
    for depth, name in enumerate(names):
        parent = ["_root", *names[:depth]]
        children = nodes.groupBy(*parent, name).agg(F.sum("capacity").alias("capacity"), F.max(f"_w_{name}").alias("weight"))
        budgets = share(budgets, children, parent).select(*parent, name, "budget")
    return leaves.join(budgets.drop("_root"), names, "left").select(*names, "available", F.coalesce("budget", F.lit(0)).cast("long").alias("budget"))


def _key(seed: int) -> Column:
    """Place of a document in its leaf's open epoch; a null id is marked, an empty one is not."""
    parts = (F.lit(str(seed)), F.col("whole_epochs").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("n_tokens").cast("string"), F.when(F.col("doc_id").isNull(), "null"))
    return F.md5(F.concat_ws(":", *parts).cast("binary"))


def placed(docs: DataFrame, levels: list[Level]) -> DataFrame:
    """doc_id, the level columns (null nodes become empty names), ``n_tokens`` and the whole row as ``_row``."""
    known = [F.coalesce(level.node.cast("string"), F.lit("")).alias(level.name) for level in levels]
    return docs.select("doc_id", *known, word_tokens(F.col("text")).alias("n_tokens"), F.struct(*docs.columns).alias("_row"))


def mix(docs: DataFrame, levels: list[Level], budget_share: tuple[int, int] = (3, 5), epochs: int = 2, seed: int = 7) -> DataFrame:
    """``docs`` with the level columns, n_tokens, whole_epochs (complete passes) and tail_tokens (tokens of the open epoch's
    prefix taken from this document) added; columns of these names are replaced. No row is dropped.

    Leaf orders are never sorted whole: a leaf is cut into 4096 parts by the leading digits of the order key, the parts' token
    sums show in which one the prefix ends, and only that part is ordered. Documents that equal in id and length share a
    place and get equal parts. An empty table, texts without tokens and excluded leaves give zeros.
    """
    names = [level.name for level in levels]
    rows = placed(docs, levels)
    narrow = fitted(rows.select("doc_id", *names, "n_tokens"), "tokens")
    leaves = narrow.groupBy(*names).agg(F.sum("n_tokens").alias("available"))
    leaf = fitted(
        leaf_budgets(leaves, levels, budget_share, epochs).select(
            *names,
            F.expr("case when available > 0 then budget div available else 0 end").cast("int").alias("whole_epochs"),
            F.expr("case when available > 0 then budget % available else 0 end").alias("_prefix"),
        ),
        "leaves",
    )
    keyed = narrow.join(leaf, names).withColumn("_key", _key(seed)).withColumn("_part", F.substring("_key", 1, DIGITS))
    sums = keyed.groupBy(*names, "_part", "_prefix").agg(F.sum("n_tokens").alias("size"))
    before = F.sum("size").over(W.partitionBy(*names).orderBy("_part")) - F.col("size")  # at most 4096 rows a leaf
    edge = fitted(
        leaf.join(
            sums.withColumn("_before", before).where("_before < _prefix and _prefix <= _before + size").select(*names, F.col("_part").alias("_edge"), "_before"), names, "left"
        ),
        "edges",
    )
    inside = keyed.drop("_prefix", "whole_epochs").join(edge.where("_edge is not null"), names).where("_part = _edge")
    places = inside.groupBy(*names, "_key", "doc_id", "n_tokens", "_prefix", "_before").agg(F.count("*").alias("copies"))
    reached = F.col("_before") + F.sum(F.col("copies") * F.col("n_tokens")).over(W.partitionBy(*names).orderBy("_key", "doc_id", "n_tokens")) - F.col("copies") * F.col("n_tokens")
    cut = places.withColumn("_reached", reached).select(
        *names, F.col("_key"), F.expr("greatest(0, least(n_tokens, (_prefix - _reached) div copies))").alias("_cut")
    )
    cut = fitted(cut.dropDuplicates([*names, "_key"]), "cut")
    out = rows.join(edge, names).withColumn("_key", _key(seed)).join(cut, [*names, "_key"], "left")
    part = F.substring("_key", 1, DIGITS)
    tail = F.when(F.col("_edge").isNull(), 0).when(part < F.col("_edge"), F.col("n_tokens")).when(part == F.col("_edge"), F.coalesce("_cut", F.lit(0))).otherwise(0)
    kept = [c for c in docs.columns if c not in (*names, "n_tokens", "whole_epochs", "tail_tokens")]
    return out.select(*[F.col("_row")[c].alias(c) for c in kept], *names, "n_tokens", F.col("whole_epochs").cast("long").alias("whole_epochs"), tail.cast("long").alias("tail_tokens"))


# The production tree over ``documents``. Weights are fixed values, stated once for the query and its SQL.
DOMAINS = {"web": ("012", 4), "books": ("345", 3), "code": ("678", 2), "forum": ("9", 1)}
LANGUAGES = {"en": 6, "de": 2, "fr": 2, "es": 2}
BUDGET_SHARE = (3, 5)
EPOCHS = 2
SEED = 7


def _cases(pairs: list[tuple[str, str]], other: str) -> str:
    return "case " + " ".join(f"when {c} then {v}" for c, v in pairs) + f" else {other} end"


DOMAIN_SQL = _cases([(f"right(source, 1) in ({', '.join(repr(d) for d in digits)})", f"'{name}'") for name, (digits, _) in DOMAINS.items()], "'other'")
DOMAIN_WEIGHT_SQL = _cases([(f"domain = '{name}'", str(weight)) for name, (_, weight) in DOMAINS.items()], "1")
LANG_WEIGHT_SQL = _cases([(f"lang = '{name}'", str(weight)) for name, weight in LANGUAGES.items()], "1")


def document_levels() -> list[Level]:
    """Domain by the last digit of the source's name, then language, then source (equal weights)."""
    return [
        Level("domain", F.expr(DOMAIN_SQL), F.expr(DOMAIN_WEIGHT_SQL)),
        Level("lang", F.col("lang"), F.expr(LANG_WEIGHT_SQL)),
        Level("source", F.col("source"), F.lit(1)),
    ]


def mix_documents(docs: DataFrame) -> DataFrame:
    return mix(docs, document_levels(), BUDGET_SHARE, EPOCHS, SEED)


def _share_sql(budgets: str, parent: str, name: str, weight: str) -> str:
    keys = f"{parent}, {name}" if parent else name
    over = f"(partition by {parent or 'true'}" if parent else "("
    join = f"join {budgets} using ({parent})" if parent else f"cross join {budgets}"
    return f"""
    select {keys}, cast(case when is_full then capacity else w * max(case when not is_full then rest end) over {over}) // max(case when not is_full then open end) over {over}) end as bigint) as budget
    from (select *, capacity * open <= rest * w as is_full from (
      select {keys}, capacity, w, budget - coalesce(sum(capacity) over ({over[1:]} order by capacity / w, {name} rows between unbounded preceding and 1 preceding), 0) as rest,
        sum(w) over {over}) - coalesce(sum(w) over ({over[1:]} order by capacity / w, {name} rows between unbounded preceding and 1 preceding), 0) as open
      from (select {keys}, cast(sum(capacity) as hugeint) as capacity, cast(max({weight}) as hugeint) as w from leaves group by {keys}) {join}))"""


SQL = f"""
with docs as (
  select doc_id, {DOMAIN_SQL} as domain, coalesce(lang, '') as lang, coalesce(source, '') as source,
    cast(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) as bigint) as n_tokens
  from documents),
leaves as (select domain, lang, source, sum(n_tokens) as available, sum(n_tokens) * {EPOCHS} as capacity from docs group by all),
b0 as (select cast(least(sum(available) * {BUDGET_SHARE[0]} // {BUDGET_SHARE[1]}, sum(capacity)) as hugeint) as budget from leaves),
b1 as ({_share_sql('b0', '', 'domain', DOMAIN_WEIGHT_SQL)}),
b2 as ({_share_sql('b1', 'domain', 'lang', LANG_WEIGHT_SQL)}),
b3 as ({_share_sql('b2', 'domain, lang', 'source', '1')}),
leaf as (
  select domain, lang, source, case when available > 0 then budget // available else 0 end as whole_epochs,
    case when available > 0 then budget % available else 0 end as prefix
  from leaves join b3 using (domain, lang, source)),
placed as (
  select *, md5('{SEED}:' || whole_epochs || ':' || coalesce(cast(doc_id as varchar), '') || ':' || n_tokens || case when doc_id is null then ':null' else '' end) as place
  from docs join leaf using (domain, lang, source)),
reached as (
  select *, count(*) over (partition by domain, lang, source, place) as copies,
    sum(n_tokens) over (partition by domain, lang, source order by place range between unbounded preceding and current row)
      - n_tokens * count(*) over (partition by domain, lang, source, place) as before
  from placed)
select doc_id, domain, lang, source, n_tokens, cast(whole_epochs as bigint) as whole_epochs,
  cast(greatest(0, least(n_tokens, (prefix - before) // copies)) as bigint) as tail_tokens
from reached
"""
