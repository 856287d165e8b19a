"""Main text of web pages by site style trees.

The pages of a host are merged into one tree. Its element nodes are block elements at equal positions of equally laid out pages, its style
nodes the ways in which an element's children are laid out, its leaves runs of text. With m pages at a node, an element's presentation
importance is the entropy (base m) of the styles used below it, a leaf's content importance one minus the mean entropy of its words over
the pages: what every page repeats is worth nothing, what a page has alone is worth one. The composite importance of an element adds that
of its children, weighted by GAMMA to the power of its number of styles. A node seen on one page counts as important.

Text goes with noisy branches: a leaf is noisy if the mean of its own importance and that of the element it stands in is low, so that a
repeated line amid text that varies stays. Importance is relative, for a site whose pages are copies of each other repeats its article
too: a leaf only counts as noisy if the text around it, in the same article or on the same site, is important as a whole, and on enough
pages; and a page keeps its text if nothing else is left.

HTML's own landmarks are presentation nodes of known importance: menus, sidebars, forms, notices, comments and the like never hold the
article (see ``markup``), text beside a declared article does not either, and inside one more evidence is asked before a leaf is removed.

Pages are read once, inside the tasks. What meets between pages are counts by (node, style) and (leaf, word), summed before the shuffle,
so a host with a third of all pages is as many keys as its tree has nodes and words. Levels of the tree are joined one by one, from the
deepest up; no host's tree is gathered. Verdicts go back by layout: pages with the same nodes share one row.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.llm.common import fitted, packed
from tabloom.llm.markup import keyed, read_page
from tabloom.llm.words import SLICE_BYTES, folded_words, mix, slices, spans_hash

GAMMA = 0.9
LOW, PAGES = 0.3, 3  # a leaf outside a declared article
LOW_INSIDE, PAGES_INSIDE = 0.1, 10
HIGH = 0.5  # importance of the text around a noisy leaf
HELD = 1 << 20  # (leaf, word) pairs a task holds before it passes them on
ODD = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
NODE = "array<struct<node:bigint,parent:bigint,within:bigint,depth:int,style:bigint,scope:bigint>>"
BLOCK = "array<struct<node:bigint,state:int,text:string>>"


def _lists(rows: list[list[tuple]], names: tuple[str, ...], types: tuple[pa.DataType, ...]) -> pa.ListArray:
    flat = list(zip(*(row for page in rows for row in page))) or [()] * len(names)
    values = pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(flat, types)], names=list(names))
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0] + [len(page) for page in rows]), pa.int32()), values)


def read_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, layout, nodes and blocks of every page; null html is empty. A layout is the set of a page's nodes, host included."""
    host = F.lower(F.regexp_extract(F.col("url").cast("string"), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    long, small, text = pa.int64(), pa.int32(), pa.string()

    def emit(names: tuple[list, list], layouts: list[int], nodes: list, blocks: list) -> pa.RecordBatch:
        return pa.record_batch(
            {
                "page_id": pa.concat_arrays(names[0]), "url": pa.concat_arrays(names[1]), "layout": pa.array(layouts, long),
                "nodes": _lists(nodes, ("node", "parent", "within", "depth", "style", "scope"), (long, long, long, small, long, long)),
                "blocks": _lists(blocks, ("node", "state", "text"), (long, small, text)),
            }
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: tuple = (([], []), [], [], [])
            size = 0
            for i in range(batch.num_rows):
                html = batch.column("html")[i].as_py() or ""
                nodes, blocks = keyed(read_page(html), batch.column("host")[i].as_py())
                for column, name in zip(held[0], ("page_id", "url")):
                    column.append(batch.column(name).slice(i, 1))
                packed = struct.pack(f"<{len(nodes)}q", *sorted(n[0] for n in nodes))
                held[1].append(int.from_bytes(blake2b(packed, digest_size=8).digest(), "little", signed=True))
                held[2].append(nodes)
                held[3].append([b for b in blocks if b[1]])
                size += len(html)
                if size > 4 * SLICE_BYTES:
                    yield emit(*held)
                    held, size = (([], []), [], [], []), 0
            if held[1]:
                yield emit(*held)

    id_type, url_type = (pages.schema[c].dataType.simpleString() for c in ("page_id", "url"))
    schema = f"page_id {id_type}, url {url_type}, layout bigint, nodes {NODE}, blocks {BLOCK}"
    return pages.select("page_id", "url", host.alias("host"), "html").mapInArrow(run, schema)


def _word_counts(offsets: np.ndarray, nodes: np.ndarray, texts: pa.Array) -> tuple[np.ndarray, ...]:
    """Leaf, feature, occurrences n and n * ln n summed over some pages; features are the words and the whole text,
    as 32-bit fingerprints: in a leaf of a million words one in ten thousand shares its number, which an average does not feel."""
    part = next(slices(texts, 1 << 62))
    words = folded_words(part)
    data = part.data.astype(np.uint64) + np.uint64(1)
    block = np.concatenate([words.doc(), np.arange(len(texts))])
    feature = (np.concatenate([words.hash, spans_hash(data, part.offsets[:-1], part.offsets[1:], ODD[1])]) >> np.uint64(32)).astype(np.uint32)
    page = np.searchsorted(offsets, block, "right")
    leaf = nodes[block]
    key = mix(feature.astype(np.uint64) * ODD[0] + leaf.view(np.uint64) * ODD[1])
    order = np.lexsort((page, key))
    key, page = key[order], page[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (page[1:] != page[:-1])
    first = np.flatnonzero(new)
    n = np.diff(np.append(first, len(key)))
    at = order[first]
    return leaf[at], feature[at], n, n * np.log(n)


def _summed(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    leaf, feature, n, s = (np.concatenate(c) for c in zip(*parts))
    order = np.lexsort((feature, leaf))
    leaf, feature, n, s = (c[order] for c in (leaf, feature, n, s))
    new = np.ones(len(leaf), bool)
    new[1:] = (leaf[1:] != leaf[:-1]) | (feature[1:] != feature[:-1])
    first = np.flatnonzero(new)
    return leaf[first], feature[first], np.add.reduceat(n, first), np.add.reduceat(s, first)


def leaf_entropies(read: DataFrame) -> DataFrame:
    """node, entropy, features: mean over a leaf's features of their entropy (natural log) over the pages, and their number."""

    def emit(found: tuple[np.ndarray, ...]) -> pa.RecordBatch:
        leaf, feature, n, s = found
        return pa.record_batch({"node": pa.array(leaf), "feature": pa.array(feature.view(np.int32)), "n": pa.array(n), "s": pa.array(s)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple[np.ndarray, ...]] = []
        for batch in batches:
            column = batch.column("blocks")
            column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
            offsets = np.asarray(column.offsets) - column.offsets[0].as_py()
            flat = column.flatten()
            nodes, texts = np.asarray(flat.field("node")), flat.field("text")
            size = np.concatenate([[0], np.cumsum(np.asarray(pc.binary_length(texts)))])[offsets]
            lo = 0
            while lo < len(offsets) - 1:
                hi = max(lo + 1, int(np.searchsorted(size, size[lo] + SLICE_BYTES, "right")) - 1)
                a, b = offsets[lo], offsets[hi]
                if a < b:
                    parts.append(_word_counts(offsets[lo + 1 : hi + 1] - a, nodes[a:b], texts.slice(a, b - a)))
                lo = hi
                if sum(len(p[0]) for p in parts) > HELD:
                    parts = [_summed(parts)]
                    if len(parts[0][0]) > HELD // 2:
                        yield emit(parts.pop())
        if parts:
            yield emit(_summed(parts))

    counts = read.select("blocks").mapInArrow(run, "node bigint, feature int, n bigint, s double")
    words = counts.groupBy("node", "feature").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    return words.groupBy("node").agg(F.avg(F.log("n") - F.col("s") / F.col("n")).alias("entropy"), F.count("*").alias("features"))


def importances(read: DataFrame) -> DataFrame:
    """node, parent, pages, scope, leaf, features and composite importance of every node of all sites; null where no text lies below."""
    layouts = read.groupBy("layout").agg(F.count("*").alias("pages"), F.first("nodes").alias("nodes"))
    seen = layouts.select("pages", F.inline("nodes")).groupBy("node", "parent", "within", "depth", "style", "scope").agg(F.sum("pages").alias("pages"))
    seen = fitted(seen, "styles")
    n = F.col("pages")
    elements = seen.groupBy("node", "parent", "within", "depth").agg(
        F.sum(n).alias("pages"), F.count("*").alias("styles"), F.sum(n * F.log(n)).alias("spread"), F.max("style").alias("style"), F.max("scope").alias("scope")
    )
    elements = elements.join(leaf_entropies(read), "node", "left")
    m = F.col("pages")
    presentation = F.when(m > 1, F.log(m) - F.col("spread") / m).otherwise(0) / F.log(m)
    presentation = F.when(m > 1, presentation).otherwise(1.0)
    content = F.when(m > 1, 1 - F.col("entropy") / F.log(m)).otherwise(1.0)
    own = F.when(F.col("entropy").isNull(), presentation).otherwise(content)
    elements = fitted(elements.withColumn("own", own).withColumn("leaf", F.col("entropy").isNotNull()).drop("spread", "entropy"), "elements")
    deepest = elements.agg(F.max("depth")).first()[0]
    below, done = None, []
    for depth in range(-1 if deepest is None else deepest, -1, -1):
        here = elements.where(F.col("depth") == depth)
        if below is None:
            here = here.withColumn("lower", F.lit(None).cast("double"))
        else:
            children = below.groupBy(F.col("parent").alias("node"), F.col("within").alias("style")).agg(F.avg("composite").alias("c"))
            used = seen.where(F.col("depth") == depth).join(children, ["node", "style"])
            here = here.join(used.groupBy("node").agg((F.sum(F.col("pages") * F.col("c")) / F.sum("pages")).alias("lower")), "node", "left")
        weight = F.pow(F.lit(GAMMA), F.col("styles"))
        composite = F.when(F.col("leaf"), F.col("own")).otherwise((1 - weight) * F.col("own") + weight * F.col("lower"))
        below = fitted(here.select("node", "parent", "within", "pages", "scope", "leaf", "features", composite.alias("composite")), "level")
        done.append(below)
    found = done[0] if done else elements.withColumn("composite", F.col("own"))
    for level in done[1:]:
        found = found.unionByName(level)
    return found.select("node", "parent", "pages", "scope", "leaf", "features", "composite")


def noisy_leaves(found: DataFrame) -> DataFrame:
    """node, inside: leaves of low importance amid important text; ``inside`` if also a declared article loses them."""
    leaves = found.where("leaf")
    around = leaves.groupBy("scope").agg((F.sum(F.col("composite") * F.col("features")) / F.sum("features")).alias("around"))
    elements = found.where("not leaf").select(F.col("node").alias("parent"), F.col("composite").alias("element"))
    value = (F.col("composite") + F.col("element")) / 2
    low = leaves.where(f"pages >= {PAGES} and composite < {2 * LOW}").join(elements, "parent").withColumn("value", value)
    low = low.where(f"value < {LOW}").join(around.where(f"around >= {HIGH}"), "scope")
    return low.select("node", ((F.col("value") < LOW_INSIDE) & (F.col("pages") >= PAGES_INSIDE)).alias("inside"))


def main_text(pages: DataFrame) -> DataFrame:
    """One row per row of ``pages``: page_id, url, text, n_chars (code points).

    Blocks of the article in page order, joined by a line feed; character references decoded, white space (any of Unicode's, so also a
    no-break space) collapsed to one space. Null and empty html, and pages without an article, give empty text. A null url is a host of
    its own. Repeated rows give repeated results; an empty table none; other columns are ignored.
    """
    read = packed(read_pages(pages.select("page_id", "url", F.col("html").cast("string").alias("html"))), "pages")
    noise = fitted(noisy_leaves(importances(read)), "noise")
    leaves = read.groupBy("layout").agg(F.first("blocks.node").alias("node")).select("layout", F.explode(F.array_distinct("node")).alias("node"))
    verdicts = leaves.join(noise, "node").groupBy("layout").agg(
        F.collect_set("node").alias("noisy"), F.array_compact(F.collect_set(F.when(F.col("inside"), F.col("node")))).alias("surely")
    )  # no more than the leaves of a page
    judged = read.join(fitted(verdicts, "verdicts"), "layout", "left")

    def stays(b):
        gone = F.when(b["state"] == 2, F.array_contains("surely", b["node"])).otherwise(F.array_contains("noisy", b["node"]))
        return ~F.coalesce(gone, F.lit(False))

    kept = F.filter("blocks", stays)
    kept = F.when(F.size(kept) > 0, kept).otherwise(F.col("blocks"))
    judged = judged.withColumn("text", F.array_join(F.transform(kept, lambda b: b["text"]), "\n"))
    return judged.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
