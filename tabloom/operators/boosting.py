"""Histogram gradient boosting for 0/1 labels, many models in one pass.

Rows are binned once and stored in chunks: one small code per feature, missing values and unknown levels with bins of their own. In a pass
over the chunks every task adds gradients and curvatures by node, feature and bin with NumPy, the sums meet by model in a shuffle, and the
task that receives them decides the splits, so the driver sees one line per node. Models that differ in rows (folds), start margins or
seeds share the passes: cross-validation costs as many jobs as one fit. Leaf values come with the split, and the validation loss with the
next tree's first pass.

A tree would need a pass per level, because a level's sums depend on the splits above it. So the driver first grows it on a bounded sample
of ``SAMPLE`` rows; the pass adds the sums of that tree's leaves over all rows, from which those of all its nodes follow. A proposed split
stands if its gain over all rows is within ``tolerance`` of the best one's; otherwise the best one is taken and the nodes below it wait for
the next pass. Sums, gains and leaf values always come from all rows, the sample only saves passes.

Margins are recomputed in the tasks from the trees grown since the chunks were last stored; every ``REFRESH`` trees the chunks are stored
again with current margins. Categories are split on native levels, ordered by gradient over curvature in the node.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.operators.lookup import fitted
from tabloom.session import shuffle_partitions

CHUNK = 16_384
SAMPLE = 65_536
REFRESH = 4


@dataclass(frozen=True)
class Bins:
    """Cut points of numeric features and levels of categorical ones. Code 0 is missing; of a category's codes the last is any other level."""

    numeric: dict[str, list[float]]
    categorical: dict[str, list[str]]

    @property
    def features(self) -> list[str]:
        return [*self.numeric, *self.categorical]

    @property
    def width(self) -> int:
        return max([len(v) + 2 for v in (*self.numeric.values(), *self.categorical.values())], default=1)

    def without(self, feature: str) -> Bins:
        return Bins({c: v for c, v in self.numeric.items() if c != feature}, {c: v for c, v in self.categorical.items() if c != feature})


def fit_bins(frame: DataFrame, numeric: list[str], categorical: list[str], bins: int = 64, levels: int = 254) -> Bins:
    """Distinct approximate quantiles, and the ``levels`` most frequent levels of each category; the rest share a bin."""
    cuts: dict[str, list[float]] = {}
    if numeric:
        shares = [i / bins for i in range(1, bins)]
        value = {c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")) for c in numeric}
        row = frame.agg(*[F.percentile_approx(value[c], shares, 10_000).alias(c) for c in numeric]).first()
        cuts = {c: sorted(set(row[c] or [])) for c in numeric}
    found: dict[str, list[str]] = {c: [] for c in categorical}
    if categorical:
        text = frame.select(*[F.col(c).cast("string").alias(c) for c in categorical])
        counts = fitted(text.unpivot([], categorical, "feature", "level").where("level is not null").groupBy("feature", "level").count(), "levels")
        parts = [counts.where(F.col("feature") == c).orderBy(F.desc("count"), "level").limit(levels) for c in categorical]
        top = parts[0]
        for part in parts[1:]:
            top = top.unionByName(part)
        for row in top.collect():  # at most `levels` rows per category
            found[row.feature].append(row.level)
    return Bins(cuts, {c: sorted(v) for c, v in found.items()})


def encode_batch(batch: pa.RecordBatch, bins: Bins) -> np.ndarray:
    """Codes of a batch, feature by feature."""
    out = np.zeros((len(bins.features), batch.num_rows), np.uint8 if bins.width <= 256 else np.uint16)
    for i, (name, cuts) in enumerate(bins.numeric.items()):
        x = np.asarray(batch.column(name).cast(pa.float64()).to_numpy(zero_copy_only=False))
        out[i] = np.where(np.isnan(x), 0, np.searchsorted(np.asarray(cuts), x, "right") + 1)
    for i, (name, levels) in enumerate(bins.categorical.items(), len(bins.numeric)):
        column = batch.column(name).cast(pa.string())
        place = pc.fill_null(pc.index_in(column, pa.array(levels, pa.string())), len(levels)).to_numpy(zero_copy_only=False) + 1
        out[i] = np.where(np.asarray(pc.is_null(column)), 0, place)
    return out


@dataclass
class Tree:
    """Splits by heap number (children of i are 2i and 2i + 1): feature, codes that go left; values of all nodes."""

    feature: dict[int, int] = field(default_factory=dict)
    left: dict[int, list[int]] = field(default_factory=dict)
    value: dict[int, float] = field(default_factory=lambda: {1: 0.0})

    def routes(self, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Arrays by heap number: feature (-1 for a leaf), code goes left, value."""
        size = max(self.value) + 1
        feature, left, value = np.full(size, -1), np.zeros((size, width), bool), np.zeros(size)
        for node, f in self.feature.items():
            feature[node] = f
            left[node, self.left[node]] = True
        for node, v in self.value.items():
            value[node] = v
        return feature, left, value


def nodes_of(codes: np.ndarray, routes: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    """The node that every row ends in."""
    feature, left, _ = routes
    n, width = codes.shape[1], left.shape[1]
    if feature[1] < 0:
        return np.ones(n, np.int64)
    inner = np.flatnonzero(feature >= 0)
    following = np.repeat(np.arange(len(feature)), width).reshape(-1, width)  # a leaf follows itself
    following[inner] = 2 * inner[:, None] + ~left[inner]
    node = following[1].take(codes[feature[1]])
    flat, table, start, rows = codes.reshape(-1), following.reshape(-1), np.maximum(feature, 0) * n, np.arange(n)
    for _ in range(int(inner.max()).bit_length() - 1):
        node = table.take(node * width + flat.take(start.take(node) + rows))
    return node


@dataclass(frozen=True)
class Settings:
    rounds: int = 100
    depth: int = 4
    rate: float = 0.1
    l2: float = 1.0
    min_child: float = 1.0  # least curvature of a child
    min_gain: float = 0.0
    subsample: float = 1.0
    columns: float = 1.0  # share of the features a tree may use
    patience: int = 0  # rounds without a lower validation loss; 0 never stops early
    tolerance: float = 0.1  # share of the best gain that a proposed split may miss


@dataclass
class Boosted:
    """A fitted model; ``losses`` are (fit, validation) per round, the first before any tree. ``best`` trees are used."""

    bins: Bins
    base: float
    trees: list[Tree]
    losses: list[tuple[float, float]]
    best: int

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @classmethod
    def from_json(cls, text: str) -> Boosted:
        raw = json.loads(text)
        trees = [Tree(*({int(k): v for k, v in t[part].items()} for part in ("feature", "left", "value"))) for t in raw["trees"]]
        return cls(Bins(**raw["bins"]), raw["base"], trees, [tuple(x) for x in raw["losses"]], raw["best"])


def margins_of(models: list[Boosted], margin: str | None = None) -> Column:
    """Array of margins, one per model; ``margin`` names an array column of start margins that takes the place of the base."""
    bins = models[0].bins
    names = [*bins.features, *([margin] if margin else [])]
    trees = [[t.routes(bins.width) for t in m.trees[: m.best]] for m in models]
    bases = np.array([m.base for m in models])

    def run(*columns: pa.Array) -> pa.Array:
        batch = pa.RecordBatch.from_arrays(list(columns), names=names)
        codes = encode_batch(batch, bins)
        shape = (batch.num_rows, len(trees))
        found = np.tile(bases, (batch.num_rows, 1)) if margin is None else np.array(batch.column(margin).flatten(), np.float64).reshape(shape)
        for m, own in enumerate(trees):
            for routes in own:
                found[:, m] += routes[2][nodes_of(codes, routes)]
        return pa.ListArray.from_arrays(pa.array(np.arange(0, found.size + 1, shape[1]), pa.int32()), pa.array(found.ravel()))

    inputs = [F.col(c).cast("double") for c in bins.numeric] + [F.col(c).cast("string") for c in bins.categorical]
    return F.arrow_udf(run, "array<double>")(*inputs, *([F.col(margin)] if margin else []))


def score_boosted(models: list[Boosted], frame: DataFrame, keep: list[str], margin: str | None = None) -> DataFrame:
    """``keep`` and ``margins``, one per model."""
    return frame.select(*keep, margins_of(models, margin).alias("margins"))


def binned(frame: DataFrame, bins: Bins, label: str, key: str, fold: str | None, n_models: int, weight: str | None = None, margin: str | None = None) -> DataFrame:
    """Chunks of rows: n, codes, y, w, fold, draw (a hash of the key), margin (model by model; missing unless given)."""
    given = {
        "_y": F.col(label).cast("double"), "_w": F.col(weight).cast("double") if weight else F.lit(1.0),
        "_fold": F.col(fold).cast("int") if fold else F.lit(-1), "_draw": F.xxhash64(key), "_margin": F.col(margin) if margin else F.lit(None).cast("array<double>"),
    }
    rows = frame.where(F.col(label).isNotNull()).select(*bins.features, *[c.alias(n) for n, c in given.items()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK):
                part = batch.slice(at, CHUNK)
                y, w, own, draw = (np.ascontiguousarray(part.column(c).to_numpy(zero_copy_only=False)) for c in ("_y", "_w", "_fold", "_draw"))
                start = b"" if margin is None else np.asarray(part.column("_margin").flatten()).reshape(-1, n_models).T.tobytes()
                values = [np.ascontiguousarray(encode_batch(part, bins)), y.astype(np.float64), w.astype(np.float64), own.astype(np.int32), draw.astype(np.int64)]
                yield pa.RecordBatch.from_pydict({"n": [part.num_rows]} | dict(zip(PARTS, ([v.tobytes()] for v in values))) | {"margin": [start]}, schema=ARROW)

    return rows.repartition(shuffle_partitions(frame.sparkSession)).mapInArrow(run, CHUNKS)


PARTS = ("codes", "y", "w", "fold", "draw")
CHUNKS = "n int, codes binary, y binary, w binary, fold binary, draw binary, margin binary"
ARROW = pa.schema([("n", pa.int32()), *((c, pa.binary()) for c in (*PARTS, "margin"))])


def _chunks(batches: Iterator[pa.RecordBatch], bins: Bins) -> Iterator[tuple]:
    kinds = (np.uint8 if bins.width <= 256 else np.uint16, np.float64, np.float64, np.int32, np.int64, np.float64)
    for batch in batches:
        for i in range(batch.num_rows):
            codes, *rest = (np.frombuffer(batch.column(c)[i].as_buffer(), k) for c, k in zip((*PARTS, "margin"), kinds))
            n = batch.column("n")[i].as_py()
            yield codes.reshape(-1, n), *rest[:-1], rest[-1].reshape(-1, n)


@dataclass(frozen=True)
class Work:
    """What a pass needs to know of one model: rows left out (by fold), base, trees since the chunks were stored, the growing tree with the
    proposed splits, the nodes whose splits are open and the leaves below them."""

    held: int | None
    base: float
    trees: list[tuple]
    growing: Tree
    open: list[int]
    leaves: list[int]
    columns: np.ndarray
    seed: int
    settings: Settings
    first: bool


def _kept(draw: np.ndarray, share: float, seed: int) -> np.ndarray:
    """Rows of a tree's sample."""
    if share >= 1:
        return np.ones(len(draw), bool)
    mixed = (draw.view(np.uint64) ^ np.uint64(seed)) * np.uint64(0x9E3779B97F4A7C15)
    mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (mixed >> np.uint64(11)).astype(np.float64) < share * 2.0**53


def _margin(codes: np.ndarray, stored: np.ndarray, m: int, work: Work) -> np.ndarray:
    out = stored[m].copy() if len(stored) else np.full(codes.shape[1], work.base)
    for routes in work.trees:
        out += routes[2][nodes_of(codes, routes)]
    return out


def _histograms(codes: np.ndarray, y, w, margin: np.ndarray, use: np.ndarray, node: np.ndarray, leaves: list[int], columns: np.ndarray, width: int) -> np.ndarray:
    """Gradient and curvature by leaf, feature and bin over the rows of ``use`` that end in one of ``leaves``."""
    place = np.full(max(int(node.max(initial=1)), *leaves) + 1, -1)
    place[leaves] = np.arange(len(leaves))
    at = place[node]
    use = np.flatnonzero(use & (at >= 0))
    p = 1 / (1 + np.exp(-margin[use]))
    g, h = w[use] * (p - y[use]), w[use] * p * (1 - p)
    sums = np.zeros((len(leaves), 2, len(codes), width))
    base = at[use] * width
    for f in columns:
        cell = base + codes[f].take(use)
        sums[:, 0, f] = np.bincount(cell, g, len(leaves) * width).reshape(-1, width)
        sums[:, 1, f] = np.bincount(cell, h, len(leaves) * width).reshape(-1, width)
    return sums


def _sums(chunks: DataFrame, works: dict[int, Work], bins: Bins) -> DataFrame:
    """(model, node, sums): gradient and curvature by feature and bin; node 0 holds fit and validation loss and weight."""
    width = bins.width
    growing = {m: work.growing.routes(width) for m, work in works.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], np.ndarray] = {}
        for codes, y, w, fold, draw, stored in _chunks(batches, bins):
            for m, work in works.items():
                margin = _margin(codes, stored, m, work)
                fit = fold != work.held if work.held is not None else np.ones(len(y), bool)
                if work.first:
                    loss = w * (np.logaddexp(0, margin) - y * margin)
                    values = np.array([loss[fit].sum(), w[fit].sum(), loss[~fit].sum(), w[~fit].sum()])
                    total[m, 0] = total.get((m, 0), 0) + values
                use = fit & _kept(draw, work.settings.subsample, work.seed)
                for node, values in zip(work.leaves, _histograms(codes, y, w, margin, use, nodes_of(codes, growing[m]), work.leaves, work.columns, width)):
                    total[m, node] = total.get((m, node), 0) + values
        for (m, node), values in total.items():
            yield pa.record_batch({"model": pa.array([m], pa.int32()), "node": pa.array([node], pa.int32()), "sums": pa.array([values.tobytes()], pa.binary())})

    return chunks.mapInArrow(run, "model int, node int, sums binary")


def best_split(g: np.ndarray, h: np.ndarray, columns: np.ndarray, n_numeric: int, settings: Settings) -> tuple | None:
    """(gain, feature, codes that go left, (G, H) left, (G, H) right) of one node's sums by feature and bin."""
    total_g, total_h = g[columns[0]].sum(), h[columns[0]].sum()
    worth = _worth(settings.l2)
    best = None
    for f in columns:
        used = np.flatnonzero(h[f] > 0)
        if len(used) < 2:
            continue
        if f < n_numeric:
            orders = [used] if used[0] != 0 else [used, np.append(used[1:], 0)]  # missing values to the left, then to the right
        else:
            orders = [used[np.argsort(g[f, used] / (h[f, used] + settings.l2), kind="stable")]]
        for order in orders:
            left_g, left_h = np.cumsum(g[f, order])[:-1], np.cumsum(h[f, order])[:-1]
            gain = worth(left_g, left_h) + worth(total_g - left_g, total_h - left_h) - worth(total_g, total_h)
            gain = np.where((left_h >= settings.min_child) & (total_h - left_h >= settings.min_child), gain, -np.inf)
            k = int(gain.argmax())
            if gain[k] > settings.min_gain and (best is None or gain[k] > best[0] + 1e-12):
                cut = order[: k + 1]
                if f < n_numeric and cut.max() > 0:
                    cut = np.concatenate([cut[cut == 0], np.arange(1, cut.max() + 1)])  # bins that are empty here lie between their neighbours
                best = (float(gain[k]), int(f), cut.tolist(), (float(left_g[k]), float(left_h[k])), (float(total_g - left_g[k]), float(total_h - left_h[k])))
    return best


def _worth(l2: float):
    return lambda g, h: g * g / (h + l2)


def decide(work: Work, sums: dict[int, np.ndarray], n_numeric: int) -> tuple[list[tuple], list[int]]:
    """Splits (node, feature, codes that go left, left and right sums) of the open nodes and what lies below them, and the nodes still open.

    ``sums`` are those of the leaves of the proposed tree; a node's are the sums of its leaves'.
    """
    settings, worth = work.settings, _worth(work.settings.l2)
    made, waiting, todo = [], [], list(work.open)
    while todo:
        node = todo.pop()
        below = [s for leaf, s in sums.items() if leaf >= node and leaf >> (leaf.bit_length() - node.bit_length()) == node]
        if not below:
            continue
        g, h = sum(below)
        best = best_split(g, h, work.columns, n_numeric, settings)
        if best is None:
            continue
        gain, *split = best
        f = work.growing.feature.get(node)
        if f is not None:
            left = work.growing.left[node]
            sides = [(float(g[f, left].sum()), float(h[f, left].sum()))]
            sides.append((float(g[f].sum()) - sides[0][0], float(h[f].sum()) - sides[0][1]))
            if min(side[1] for side in sides) >= settings.min_child:
                own = worth(*sides[0]) + worth(*sides[1]) - worth(g[f].sum(), h[f].sum())
                if own > settings.min_gain and own >= (1 - settings.tolerance) * gain:
                    split = [f, left, *sides]
                else:
                    f = None
            else:
                f = None
        made.append((node, *split))
        if node.bit_length() < settings.depth:
            (waiting if f is None else todo).extend((2 * node, 2 * node + 1))
    return made, waiting


def propose(tree: Tree, open_: list[int], sample: tuple, margin: np.ndarray, use: np.ndarray, columns: np.ndarray, bins: Bins, settings: Settings) -> tuple[Tree, list[int]]:
    """The tree grown on below its open nodes by the sample's rows, and the leaves below the open nodes."""
    codes, y, w, *_ = sample
    grown = Tree(dict(tree.feature), dict(tree.left), dict.fromkeys(tree.value, 0.0))
    scaled = Settings(**{**asdict(settings), "min_child": settings.min_child * len(y) / sample[-1]})
    frontier, leaves = list(open_), []
    while frontier:
        node = nodes_of(codes, grown.routes(bins.width))
        sums = _histograms(codes, y, w, margin, use, node, frontier, columns, bins.width)
        lower = []
        for at, (g, h) in zip(frontier, sums):
            found = best_split(g, h, columns, len(bins.numeric), scaled) if at.bit_length() < settings.depth else None
            if found is None:
                leaves.append(at)
                continue
            grown.feature[at], grown.left[at] = found[1], found[2]
            grown.value |= {2 * at: 0.0, 2 * at + 1: 0.0}
            lower += [2 * at, 2 * at + 1]
        frontier = lower
    return grown, leaves


def _splits(sums: DataFrame, works: dict[int, Work], bins: Bins) -> list[tuple[int, list]]:
    """(model, [losses or None, splits, open nodes]): sums meet by model, one line a model comes back."""
    size, width, n_numeric = len(bins.features), bins.width, len(bins.numeric)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, dict[int, np.ndarray]] = {}
        for batch in batches:
            for m, node, raw in zip(batch.column("model").to_pylist(), batch.column("node").to_pylist(), batch.column("sums")):
                values = np.frombuffer(raw.as_buffer(), np.float64)
                own = total.setdefault(m, {})
                own[node] = values + own[node] if node in own else values
        for m, own in total.items():
            losses = own.pop(0).tolist() if 0 in own else None
            made, waiting = decide(works[m], {node: v.reshape(2, size, width) for node, v in own.items()}, n_numeric)
            yield pa.record_batch({"model": pa.array([m], pa.int32()), "found": pa.array([json.dumps([losses, made, waiting])])})

    tasks = min(shuffle_partitions(sums.sparkSession), len(works))
    rows = sums.repartition(tasks, "model").mapInArrow(run, "model int, found string").collect()  # a line per model
    return [(r.model, json.loads(r.found)) for r in rows]


def _sample(chunks: DataFrame, bins: Bins) -> tuple:
    """Codes, labels, weights, folds, hashes and stored margins of about ``SAMPLE`` rows, by hash, and the number of all rows."""
    rows = chunks.agg(F.sum("n")).first()[0] or 0
    share = SAMPLE / max(rows, SAMPLE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for codes, y, w, fold, draw, stored in _chunks(batches, bins):
            keep = _kept(draw, share, 1)
            if not keep.any():
                continue  # of a large table a short chunk may have no row in the sample
            values = [np.ascontiguousarray(x[..., keep]).tobytes() for x in (codes, y, w, fold, draw, stored)]
            yield pa.RecordBatch.from_pydict(dict(zip(ARROW.names, [[int(keep.sum())], *([v] for v in values)])), schema=ARROW)

    found = list(_chunks(iter(chunks.mapInArrow(run, CHUNKS).toArrow().to_batches()), bins))  # about SAMPLE rows
    return *(np.concatenate(x, axis=-1) for x in zip(*found)), rows


def fit_boosted(
    frame: DataFrame, bins: Bins, label: str, settings: Settings, seed: int, key: str = "id", fold: str | None = None, held: list[int | None] = (None,),
    weight: str | None = None, margin: str | None = None,
) -> list[Boosted]:
    """One model per entry of ``held``: the value of ``fold`` whose rows it does not learn from (they give the validation loss).

    ``margin`` names an array column with a start margin per model; without it models start from the log odds of their rows. A null
    label is not learned from. Models are the same for the same rows whatever their partitioning, up to the order of sums.
    """
    if margin is None:
        y = F.col(label).cast("double")
        w = F.col(weight).cast("double") if weight else F.lit(1.0)
        rows = frame.where(y.isNotNull()).groupBy(F.col(fold).alias("fold") if fold else F.lit(-1).alias("fold")).agg(F.sum(y * w).alias("s"), F.sum(w).alias("n")).collect()
        bases = []
        for own in held:
            s, n = (sum(r[c] for r in rows if r.fold != own or own is None) for c in ("s", "n"))
            rate = min(max(s / n if n else 0.5, 1e-6), 1 - 1e-6)
            bases.append(float(np.log(rate / (1 - rate))))
    else:
        bases = [0.0] * len(held)
    chunks = fitted(binned(frame, bins, label, key, fold, len(held), weight, margin), "chunks")
    models = [Boosted(bins, base, [], [], 0) for base in bases]
    sample = _sample(chunks, bins) if settings.rounds else None
    if sample is not None and not len(sample) > 1:
        return models
    near = None if sample is None else [sample[5][m].copy() if len(sample[5]) else np.full(len(sample[1]), b) for m, b in enumerate(bases)]
    stored = [0] * len(held)  # trees that the stored margins already hold
    live = list(range(len(held)))
    width, size = bins.width, len(bins.features)
    for n in range(settings.rounds + 1):
        growing, waiting, first = {m: Tree() for m in live}, {m: [1] for m in live}, True
        columns = {m: np.sort(np.random.Generator(np.random.PCG64([seed, m, n])).permutation(size)[: max(1, round(settings.columns * size))]) for m in live}
        while any(waiting.values()):
            works = {}
            for m in (m for m in live if waiting[m]):
                draw_seed = (seed << 20) + (m << 12) + n
                tree, leaves = growing[m], waiting[m]
                if n < settings.rounds:
                    use = _kept(sample[4], settings.subsample, draw_seed) & (sample[3] != held[m] if held[m] is not None else True)
                    tree, leaves = propose(tree, leaves, sample, near[m], use, columns[m], bins, settings)
                trees = [t.routes(width) for t in models[m].trees[stored[m] :]]
                works[m] = Work(held[m], bases[m], trees, tree, waiting[m], leaves, columns[m], draw_seed, settings, first)
            waiting = dict.fromkeys(live, [])
            for m, (losses, made, still) in _splits(_sums(chunks, works, bins), works, bins):
                if losses is not None:
                    fit_loss, fit_w, held_loss, held_w = losses
                    models[m].losses.append((fit_loss / fit_w if fit_w else 0.0, held_loss / held_w if held_w else float("nan")))
                waiting[m] = still
                for node, feature, left, *sides in made:
                    growing[m].feature[node], growing[m].left[node] = feature, left
                    for child, (g, h) in zip((2 * node, 2 * node + 1), sides):
                        growing[m].value[child] = -settings.rate * g / (h + settings.l2)
            if first:
                for m in list(live):
                    _settle(models[m], settings)
                    if n == settings.rounds or _stops(models[m], settings) or not growing[m].feature:
                        live.remove(m)
                waiting = {m: waiting[m] for m in live}
                first = False
        for m in live:
            models[m].trees.append(growing[m])
            routes = growing[m].routes(width)
            near[m] += routes[2][nodes_of(sample[0], routes)]
        if not live:
            break
        if any(len(models[m].trees) - stored[m] >= REFRESH for m in live):
            chunks = fitted(_refreshed(chunks, bins, bases, [[t.routes(width) for t in model.trees[s:]] for model, s in zip(models, stored)]), "chunks")
            stored = [len(model.trees) for model in models]
    return models


def _settle(model: Boosted, settings: Settings) -> None:
    """All trees so far count, or those up to the lowest validation loss if the model may stop early."""
    model.best = len(model.losses) - 1
    if settings.patience and not any(np.isnan(v) for _, v in model.losses):
        model.best = int(np.argmin([v for _, v in model.losses]))


def _stops(model: Boosted, settings: Settings) -> bool:
    return bool(settings.patience) and len(model.losses) - 1 - model.best >= settings.patience


def _refreshed(chunks: DataFrame, bins: Bins, bases: list[float], trees: list[list[tuple]]) -> DataFrame:
    """The chunks with the margins of the models as they are now."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, (codes, *_, margin) in enumerate(_chunks(iter([batch]), bins)):
                out = margin.copy() if len(margin) else np.repeat(np.array(bases)[:, None], codes.shape[1], axis=1)
                for m, own in enumerate(trees):
                    for routes in own:
                        out[m] += routes[2][nodes_of(codes, routes)]
                row = batch.slice(i, 1)
                yield row.set_column(row.schema.get_field_index("margin"), "margin", pa.array([out.tobytes()], pa.binary()))

    return chunks.mapInArrow(run, CHUNKS)


def _param(name: str, doc: str, kind) -> Param:
    return Param(Params._dummy(), name, doc, kind)


class _BoosterParams(Params):
    numericCols = _param("numericCols", "numeric features", TypeConverters.toListString)
    categoricalCols = _param("categoricalCols", "categorical features", TypeConverters.toListString)
    labelCol = _param("labelCol", "0/1 label", TypeConverters.toString)
    keyCol = _param("keyCol", "row key that row samples are drawn from", TypeConverters.toString)
    weightCol = _param("weightCol", "weight, empty for none", TypeConverters.toString)
    validationIndicatorCol = _param("validationIndicatorCol", "rows that decide when to stop, empty for none", TypeConverters.toString)
    maxIter = _param("maxIter", "trees at most", TypeConverters.toInt)
    maxDepth = _param("maxDepth", "levels of a tree", TypeConverters.toInt)
    maxBins = _param("maxBins", "bins of a numeric feature", TypeConverters.toInt)
    stepSize = _param("stepSize", "learning rate", TypeConverters.toFloat)
    regParam = _param("regParam", "L2 penalty of leaf values", TypeConverters.toFloat)
    minChildWeight = _param("minChildWeight", "least curvature of a child", TypeConverters.toFloat)
    subsamplingRate = _param("subsamplingRate", "share of the rows a tree sees", TypeConverters.toFloat)
    featureShare = _param("featureShare", "share of the features a tree may use", TypeConverters.toFloat)
    patience = _param("patience", "rounds without a lower validation loss before it stops", TypeConverters.toInt)
    seed = _param("seed", "seed", TypeConverters.toInt)

    def settings(self) -> Settings:
        names = ("maxIter", "maxDepth", "stepSize", "regParam", "minChildWeight", "subsamplingRate", "featureShare", "patience")
        rounds, depth, rate, l2, child, rows, columns, patience = (self.getOrDefault(n) for n in names)
        early = patience if self.getOrDefault("validationIndicatorCol") else 0
        return Settings(rounds, depth, rate, l2, child, 0.0, rows, columns, early)


class HistogramBooster(Estimator, _BoosterParams, DefaultParamsReadable, DefaultParamsWritable):
    """The boosting above as a pipeline stage over plain feature columns."""

    @keyword_only
    def __init__(
        self, *, numericCols=(), categoricalCols=(), labelCol="label", keyCol="id", weightCol="", validationIndicatorCol="", maxIter=100, maxDepth=4,
        maxBins=64, stepSize=0.1, regParam=1.0, minChildWeight=1.0, subsamplingRate=1.0, featureShare=1.0, patience=10, seed=0,
    ):
        super().__init__()
        given = self._input_kwargs
        self._setDefault(
            numericCols=[], categoricalCols=[], labelCol="label", keyCol="id", weightCol="", validationIndicatorCol="", maxIter=100, maxDepth=4,
            maxBins=64, stepSize=0.1, regParam=1.0, minChildWeight=1.0, subsamplingRate=1.0, featureShare=1.0, patience=10, seed=0,
        )
        self._set(**{k: list(v) if isinstance(v, tuple) else v for k, v in given.items()})

    def _fit(self, dataset: DataFrame) -> HistogramBoosterModel:
        value = self.getOrDefault
        flag = value("validationIndicatorCol")
        bins = fit_bins(dataset.where(~F.col(flag)) if flag else dataset, value("numericCols"), value("categoricalCols"), value("maxBins"))
        frame = dataset.withColumn("_held", F.col(flag).cast("int") if flag else F.lit(0))
        (model,) = fit_boosted(
            frame, bins, value("labelCol"), self.settings(), value("seed"), value("keyCol"), "_held", [1 if flag else None], value("weightCol") or None
        )
        return self._copyValues(HistogramBoosterModel(model))


class HistogramBoosterModel(Model, _BoosterParams, MLWritable, MLReadable):
    """Adds ``probability``, a vector of the probabilities of 0 and 1."""

    def __init__(self, model: Boosted | None = None):
        super().__init__()
        self.model = model

    @property
    def treeWeights(self) -> list[float]:
        return [1.0] * self.model.best

    def _transform(self, dataset: DataFrame) -> DataFrame:
        p = 1 / (1 + F.exp(-F.element_at(margins_of([self.model]), 1)))
        return dataset.withColumn("_p1", p).withColumn("probability", array_to_vector(F.array(1 - F.col("_p1"), F.col("_p1")))).drop("_p1")

    def write(self) -> MLWriter:
        return _BoosterWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _BoosterReader(cls)


class _BoosterWriter(MLWriter):
    def __init__(self, stage: HistogramBoosterModel):
        super().__init__()
        self.stage = stage

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.stage, path, self.sparkSession, extraMetadata={"model": self.stage.model.to_json()})


class _BoosterReader(MLReader):
    def __init__(self, cls: type):
        super().__init__()
        self.cls = cls

    def load(self, path: str) -> HistogramBoosterModel:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        stage = self.cls(Boosted.from_json(metadata["model"]))
        stage._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(stage, metadata)
        return stage
