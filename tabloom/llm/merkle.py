"""Merkle manifest by time-forward processing.

Leaves are the rows, one tree per source, and one more tree over the roots of the sources. In a tree every ``RUN`` consecutive nodes of
a level become one node of the next, its digest the SHA-256 of theirs; the last run may be shorter, and a lone node is the root.

Nodes are labelled (level, place), children before parents. A task takes one block, ``RUN ** HEIGHT`` consecutive nodes of a level, works
through the labels in order and sends every digest to its parent through a priority queue ordered by label; what a label finds at the
head of the queue are its children. The part of the queue that outlives a block is Spark's sort: digests of block roots are shuffled to
(tree, block) and sorted by place, where the next round picks them up. The reversed sweep runs the same rounds backwards: a block receives
the proof suffix of its root, and a queue in descending label order passes every node's suffix, lengthened by its run, on to its children.

Places are exact without a window over a source: rows are range-sorted, numbered inside their partition, and the small counts per
(tree, partition) are accumulated. A round is one shuffle of the nodes it reads; a tree of n leaves needs log(n) / log(RUN ** HEIGHT) of
them, two up to 43 million leaves. A group never exceeds RUN ** HEIGHT nodes, however large its source.
"""

from __future__ import annotations

import hashlib
import heapq
import struct
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tabloom.llm.common import fitted

RUN = 3
HEIGHT = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
NODE = "tree string, n bigint, pos bigint, digest binary"


def digest_of(children: list[bytes]) -> bytes:
    """SHA-256 of the children's digests as hexadecimal text."""
    return hashlib.sha256("".join(c.hex() for c in children).encode()).digest()


def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(text: Column | None = None) -> Column:
    """Digest (binary) of a row of documents, with another text if one is given."""
    fields = [_field(text if name == "text" and text is not None else F.col(name)) for name in FIELDS]
    return F.unhex(F.sha2(F.concat(*fields), 256))


def levels_of(nodes: int) -> int:
    """Levels above ``nodes`` nodes until one remains."""
    levels = 0
    while nodes > 1:
        nodes = -(-nodes // RUN)
        levels += 1
    return levels


def climb(digests: list[bytes], levels: int) -> dict[tuple[int, int], list[bytes]]:
    """Time-forward sweep of one block: the children of every node above the leaves, by label; the root's label is (levels + 1, 0)."""
    queue = [((1, i // RUN), i, d) for i, d in enumerate(digests)] if levels else [((1, 0), 0, digests[0])]
    heapq.heapify(queue)
    runs: dict[tuple[int, int], list[bytes]] = {}
    while queue:
        label = queue[0][0]
        children = []
        while queue and queue[0][0] == label:
            children.append(heapq.heappop(queue)[2])
        runs[label] = children
        level, place = label
        if level <= levels:
            parent = (level + 1, place // RUN if level < levels else 0)
            heapq.heappush(queue, (parent, place, digest_of(children)))
    return runs


def descend(runs: dict[tuple[int, int], list[bytes]], levels: int, suffix: bytes) -> list[bytes]:
    """Reversed sweep of one block: the proof suffix of every leaf, in order.

    A suffix lists the runs on the way up, each as its length, the place of the own node in it, and all its digests.
    """
    if not levels:
        return [suffix]
    found = []
    queue: list[tuple[int, int, bytes]] = [(-levels, 0, suffix)]  # the latest label first
    while queue:
        level, place, upper = heapq.heappop(queue)
        run = runs[(-level, place)]
        whole = b"".join(run)
        for k in range(len(run)):
            lower = struct.pack(">II", len(run), k) + whole + upper
            if level == -1:
                found.append((place * RUN + k, lower))
            else:
                heapq.heappush(queue, (level + 1, place * RUN + k, lower))
    return [lower for _, lower in sorted(found)]


def proof_digest(suffix: bytes) -> bytes:
    """SHA-256 of the siblings named by a suffix, as hexadecimal text."""
    at, siblings = 0, []
    while at < len(suffix):
        length, k = struct.unpack_from(">II", suffix, at)
        at += 8
        siblings.append(suffix[at : at + 32 * k] + suffix[at + 32 * k + 32 : at + 32 * length])
        at += 32 * length
    return hashlib.sha256(b"".join(siblings).hex().encode()).digest()


def fold(digest: bytes, suffix: bytes) -> bytes:
    """The root that a leaf and its siblings lead to."""
    at = 0
    while at < len(suffix):
        length, k = struct.unpack_from(">II", suffix, at)
        at += 8
        run = suffix[at : at + 32 * k] + digest + suffix[at + 32 * k + 32 : at + 32 * length]
        digest = hashlib.sha256(run.hex().encode()).digest()
        at += 32 * length
    return digest


def placed(rows: DataFrame, order: list[Column]) -> DataFrame:
    """Stored ``rows`` with their place ``pos`` in their ``tree`` by ``order``, and its number of rows ``n``."""
    ordered = fitted(rows.orderBy("tree", *order).withColumn("at", F.monotonically_increasing_id()), "ordered")
    part = F.shiftright("at", 33)
    parts = ordered.groupBy("tree", part.alias("part")).agg(F.min("at").alias("first"), F.count("*").alias("rows"))
    tree = Window.partitionBy("tree")
    before = F.sum("rows").over(tree.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select("tree", "part", (F.coalesce(before, F.lit(0)) - F.col("first")).alias("shift"), F.sum("rows").over(tree).alias("n"))
    numbered = ordered.withColumn("part", part).join(fitted(parts, "parts"), ["tree", "part"])
    return numbered.withColumn("pos", F.col("at") + F.col("shift")).drop("at", "part", "shift")


def _blocks(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[tuple[tuple[str, int], int, list[tuple]]]:
    """(tree, block), nodes of the tree on this level, rows; the input is sorted by tree, block and place."""
    key, n, held = None, 0, []
    for batch in batches:
        for tree, block, size, *row in zip(*(batch.column(c).to_pylist() for c in ("tree", "block", "n", *columns))):
            if (tree, block) != key:
                if held:
                    yield key, n, held
                key, held = (tree, block), []
            n = size
            held.append(tuple(row))
    if held:
        yield key, n, held


def _dealt(rows: DataFrame, *inner: str) -> DataFrame:
    return rows.repartition("tree", "block").sortWithinPartitions("tree", "block", *inner)


def build(leaves: DataFrame, height: int = HEIGHT) -> list[DataFrame]:
    """Tables of nodes (``NODE``) from the leaves up, ``height`` levels apart; the last holds every tree's root."""
    width = RUN**height

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = []
        for (tree, block), n, rows in _blocks(batches, ["digest"]):
            levels = min(height, levels_of(n))
            root = climb([d for (d,) in rows], levels)[(levels + 1, 0)][0]
            done.append((tree, -(-n // width), block, root))
            if len(done) == 4096:
                yield pa.record_batch(dict(zip(("tree", "n", "pos", "digest"), map(list, zip(*done)))))
                done = []
        if done:
            yield pa.record_batch(dict(zip(("tree", "n", "pos", "digest"), map(list, zip(*done)))))

    tables = [leaves.select("tree", "n", "pos", "digest")]
    most = leaves.agg(F.max("n")).first()[0] or 0
    while most > 1:
        dealt = _dealt(tables[-1].withColumn("block", F.expr(f"pos div {width}")), "pos")
        tables.append(fitted(dealt.mapInArrow(run, NODE), "nodes"))
        most = -(-most // width)
    return tables


def _lowered(
    nodes: DataFrame, suffixes: DataFrame, extra: list[str], schema: str, emit: Callable[[list[tuple], list[bytes]], dict], height: int
) -> DataFrame:
    """``emit`` of every block's rows (digest, pos, *extra) and their suffixes; ``suffixes`` (tree, pos, suffix) are those of the blocks."""
    width = RUN**height
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (tree, _), n, rows in _blocks(batches, ["upper", "digest", "pos", *extra]):
            (upper, *_), members = rows[0], [row[1:] for row in rows[1:]]
            levels = min(height, levels_of(n))
            runs = climb([row[0] for row in members], levels)
            yield pa.RecordBatch.from_pydict({"tree": [tree] * len(members)} | emit(members, descend(runs, levels, upper)), schema=arrow)

    rows = nodes.select("tree", F.expr(f"pos div {width}").alias("block"), "n", F.lit(None).cast("binary").alias("upper"), "digest", "pos", *extra)
    heads = suffixes.select("tree", F.col("pos").alias("block"), F.lit(0).cast("long").alias("n"), F.col("suffix").alias("upper"), F.lit(-1).cast("long").alias("pos"))
    return _dealt(rows.unionByName(heads, allowMissingColumns=True), "pos").mapInArrow(run, schema)


def proofs(tables: list[DataFrame], suffixes: DataFrame, height: int = HEIGHT) -> DataFrame:
    """Suffixes (tree, pos, suffix) of the blocks that the leaves lie in, from those of the roots."""

    def emit(members: list[tuple], lower: list[bytes]) -> dict:
        return {"pos": [row[1] for row in members], "suffix": lower}

    for nodes in reversed(tables[1:-1]):
        suffixes = fitted(_lowered(nodes, suffixes, [], "tree string, pos bigint, suffix binary", emit, height), "suffixes")
    return suffixes


def manifest(docs: DataFrame, height: int = HEIGHT) -> DataFrame:
    """One row per row of ``docs``: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    The leaf is the digest of doc_id, source, lang, n_chars and text. Per source (null is a source of its own, and the first), leaves ascend
    by doc_id, null first, then by digest; rows equal in both are interchangeable. ``folded_root`` starts from the leaf of a tampered row
    where 2 divides the CRC-32 of doc_id's decimal text (never for a null doc_id): its text without line feeds. ``verified`` says whether it
    equals the root. Null and empty texts are different leaves. Other columns are ignored; an empty table gives no rows.
    """
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    leaves = fitted(
        docs.select(
            F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("")).alias("tree"), "doc_id",
            leaf_digest().alias("digest"),
            F.when(tampered & F.col("text").contains("\n"), leaf_digest(F.replace("text", F.lit("\n"), F.lit("")))).alias("altered"),
            F.monotonically_increasing_id().alias("tie"),
        ),
        "leaves",
    )
    low = placed(leaves, [F.col("doc_id").asc_nulls_first(), F.col("digest"), F.col("tie")]).drop("tie")
    low = fitted(low, "placed")
    trees = build(low, height)
    tops = placed(trees[-1].select(F.lit("").alias("tree"), F.col("tree").alias("source"), "digest"), [F.col("source")])
    tops = fitted(tops, "subroots")
    over = build(tops, height)
    top = over[-1].select("digest").first() or [b""]
    first = over[-1].select("tree", "pos", F.lit(b"").alias("suffix"))

    def named(members: list[tuple], lower: list[bytes]) -> dict:
        return {"source": [row[2] for row in members], "suffix": lower}

    schema = "tree string, source string, suffix binary"
    heads = fitted(_lowered(tops, proofs(over, first, height), ["source"], schema, named, height), "suffixes")
    heads = heads.select(F.col("source").alias("tree"), F.lit(0).cast("long").alias("pos"), "suffix")

    def proven(members: list[tuple], lower: list[bytes]) -> dict:
        digests, _, ids, altered = zip(*members)
        return {
            "doc_id": ids,
            "leaf": [d.hex() for d in digests],
            "proof_sha256": [proof_digest(s).hex() for s in lower],
            "folded_root": [fold(a or d, s).hex() for d, a, s in zip(digests, altered, lower)],
        }

    id_type = docs.schema["doc_id"].dataType.simpleString()
    schema = f"tree string, doc_id {id_type}, leaf string, proof_sha256 string, folded_root string"
    found = _lowered(low, proofs(trees, heads, height), ["doc_id", "altered"], schema, proven, height)
    subroots = trees[-1].select("tree", F.lower(F.hex("digest")).alias("subroot"))
    root = F.lit(bytes(top[0]).hex())
    return found.join(fitted(subroots, "subroots"), "tree").select(
        "doc_id", "leaf", "subroot", root.alias("root"), "proof_sha256", "folded_root", (F.col("folded_root") == root).alias("verified")
    )


SQL = """
with recursive crc_table as (
  select list(list_reduce(range(8), lambda c, k: case when c % 2 = 1 then xor(c // 2, 3988292384) else c // 2 end, i) order by i) as t
  from range(256) r(i)),
docs as (
  select doc_id, text, coalesce('=' || source, '') as tree,
    coalesce(strlen(doc_id::varchar) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
      || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::varchar) || ':' || n_chars, '-') as head,
    list_transform(string_split(doc_id::varchar, ''), lambda c: ascii(c)::bigint) as bytes from documents),
checked as (
  select *, xor(list_reduce(bytes, lambda c, b: xor(t[xor(c, b) % 256 + 1], c // 256), 4294967295::bigint), 4294967295) % 2 = 0 as hit
  from docs, crc_table),
leaves as (
  select *, row_number() over (partition by tree order by doc_id nulls first, leaf) - 1 as pos, count(*) over (partition by tree) as n
  from (select doc_id, tree, sha256(head || coalesce(strlen(text) || ':' || text, '-')) as leaf,
    case when hit then sha256(head || coalesce(strlen(replace(text, chr(10), '')) || ':' || replace(text, chr(10), ''), '-')) end as altered
    from checked)),
up as (
  select tree, 0 as lvl, n, pos, leaf as h from leaves
  union all
  select tree, lvl + 1, (n + 2) // 3, pos // 3, sha256(string_agg(h, '' order by pos)) from up where n > 1
  group by tree, lvl, n, pos // 3),
subroots as (select tree, h, row_number() over (order by tree) - 1 as pos, count(*) over () as n from up where n = 1),
top as (
  select 0 as lvl, n, pos, h from subroots
  union all
  select lvl + 1, (n + 2) // 3, pos // 3, sha256(string_agg(h, '' order by pos)) from top where n > 1 group by lvl, n, pos // 3),
nodes as (select tree, lvl, n, pos, h from up where n > 1 union all select 'top', lvl, n, pos, h from top where n > 1),
beside as (
  select a.tree, a.lvl, a.pos, coalesce(string_agg(b.h, '' order by b.pos) filter (b.pos < a.pos), '') as before,
    coalesce(string_agg(b.h, '' order by b.pos) filter (b.pos > a.pos), '') as after
  from nodes a join nodes b on a.tree = b.tree and a.lvl = b.lvl and a.pos // 3 = b.pos // 3 group by a.tree, a.lvl, a.pos),
fold as (
  select tree, pos as leaf_pos, tree as here, 0 as lvl, pos, coalesce(altered, leaf) as cur, '' as proof from leaves
  union all
  select f.tree, f.leaf_pos, case when b.pos is null then 'top' else f.here end,
    case when b.pos is null then 0 else f.lvl + 1 end, case when b.pos is null then s.pos else f.pos // 3 end,
    case when b.pos is null then f.cur else sha256(b.before || f.cur || b.after) end,
    case when b.pos is null then f.proof else f.proof || b.before || b.after end
  from fold f left join beside b on f.here = b.tree and f.lvl = b.lvl and f.pos = b.pos join subroots s on f.tree = s.tree
  where b.pos is not null or f.here <> 'top'),
ends as (select tree, leaf_pos, arg_max(cur, lvl) as cur, arg_max(proof, lvl) as proof from fold where here = 'top' group by all)
select l.doc_id, l.leaf, s.h as subroot, t.h as root, sha256(e.proof) as proof_sha256, e.cur as folded_root, e.cur = t.h as verified
from leaves l join subroots s on l.tree = s.tree join ends e on l.tree = e.tree and l.pos = e.leaf_pos, (select h from top where n = 1) t
"""
