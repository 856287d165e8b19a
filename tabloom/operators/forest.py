"""Classification forests for many target columns at once.

Every column can be the target of its own forest, predicted from the others. All targets, folds and trees grow together: rows are binned
once, and a level of all trees is a few passes over the same chunks. A task counts classes by node, feature and bin with NumPy, counts meet
by tree in a shuffle, and the task that receives them picks the splits by the Gini gain, so the driver sees one line per tree. ``BATCH``
bounds the counts that a task holds: trees that do not fit go into the next pass.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.operators.boosting import CHUNK, Bins, Tree, _kept, encode_batch, nodes_of
from tabloom.operators.lookup import fitted
from tabloom.session import shuffle_partitions

BATCH = 32 << 20  # bytes of counts in a task
CHUNKS = "n int, codes binary, classes binary, fold binary, draw binary"
ARROW = pa.schema([("n", pa.int32()), *((c, pa.binary()) for c in ("codes", "classes", "fold", "draw"))])


@dataclass(frozen=True)
class Targets:
    """Classes of every target, and the value that each class stands for: bins of long numeric columns, levels of categories, and the
    numbers themselves (their values) of short numeric columns."""

    bins: Bins
    values: dict[str, list[float]]

    @property
    def names(self) -> list[str]:
        return list(self.values)

    def size(self, target: str) -> int:
        return len(self.values[target])

    def classes(self, batch: pa.RecordBatch) -> np.ndarray:
        """Class of every row, target by target; -1 for a level never learned, -2 for a missing value."""
        coded = dict(zip(self.bins.features, encode_batch(batch, self.bins).astype(np.int16)))
        found = np.zeros((len(self.values), batch.num_rows), np.int16)
        for i, (name, values) in enumerate(self.values.items()):
            if name in coded:
                code = coded[name]
                found[i] = np.where(code == 0, -2, np.where(code > len(values), -1, code - 1))
            else:
                x = np.asarray(batch.column(name).cast(pa.float64()).to_numpy(zero_copy_only=False))
                at = np.searchsorted(values, x)
                same = np.append(values, np.nan)[at] == x
                found[i] = np.where(np.isnan(x), -2, np.where(same, at, -1))
        return found


@dataclass(frozen=True)
class Growing:
    """One tree: its target (place among the targets), rows left out by fold, sample, and what has grown."""

    target: int
    held: int | None
    columns: np.ndarray
    seed: int
    tree: Tree
    open: tuple[int, ...]


def _chunked(frame: DataFrame, bins: Bins, targets: Targets, draw: list[str], fold: str | None) -> DataFrame:
    names = list(dict.fromkeys([*bins.features, *targets.names]))
    rows = frame.select(*names, (F.col(fold).cast("int") if fold else F.lit(-1)).alias("_fold"), F.xxhash64(*draw).alias("_draw"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK):
                part = batch.slice(at, CHUNK)
                fold_, draw_ = (np.ascontiguousarray(part.column(c).to_numpy(zero_copy_only=False)) for c in ("_fold", "_draw"))
                values = [encode_batch(part, bins), targets.classes(part), fold_.astype(np.int32), draw_.astype(np.int64)]
                yield pa.RecordBatch.from_pydict(dict(zip(ARROW.names, [[part.num_rows], *([np.ascontiguousarray(v).tobytes()] for v in values)])), schema=ARROW)

    return rows.repartition(shuffle_partitions(frame.sparkSession)).mapInArrow(run, CHUNKS)


def gini_split(counts: np.ndarray, columns: np.ndarray, n_numeric: int) -> tuple | None:
    """(feature, codes that go left, class counts left, class counts right) of the best split of counts by column, bin and class."""
    total = counts[0].sum(axis=0)
    whole = (total.astype(float) ** 2).sum() / max(total.sum(), 1)
    best, split = 1e-9, None
    top = int(total.argmax())
    for i, f in enumerate(columns):
        used = np.flatnonzero(counts[i].any(axis=1))
        if len(used) < 2:
            continue
        order = used if f < n_numeric else used[np.argsort(counts[i, used, top] / counts[i, used].sum(axis=1), kind="stable")]
        left = np.cumsum(counts[i, order], axis=0)[:-1].astype(float)
        right = total - left
        gain = (left**2).sum(axis=1) / left.sum(axis=1) + (right**2).sum(axis=1) / right.sum(axis=1) - whole
        k = int(gain.argmax())
        if gain[k] > best + 1e-12:
            cut = np.arange(order[k] + 1) if f < n_numeric else order[: k + 1]
            best, split = float(gain[k]), (int(f), cut.tolist(), left[k].astype(int).tolist(), right[k].astype(int).tolist())
    return split


def _pass(chunks: DataFrame, work: dict[int, Growing], sizes: list[int], bins: Bins) -> list[tuple[int, list]]:
    """(tree, splits of its open nodes)."""
    width, n_numeric = bins.width, len(bins.numeric)
    routes = {m: g.tree.routes(width) for m, g in work.items()}
    code_type = np.uint8 if width <= 256 else np.uint16

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for i in range(batch.num_rows):
                codes, classes, fold, draw = (np.frombuffer(batch.column(c)[i].as_buffer(), t) for c, t in zip(ARROW.names[1:], (code_type, np.int16, np.int32, np.int64)))
                codes, classes = codes.reshape(-1, len(fold)), classes.reshape(-1, len(fold))
                for m, g in work.items():
                    own, size = classes[g.target], sizes[g.target]
                    use = (own >= 0) & _kept(draw, 0.7, g.seed)
                    if g.held is not None:
                        use &= fold != g.held
                    node = nodes_of(codes, routes[m])
                    place = np.full(max(int(node.max(initial=1)), *g.open) + 1, -1)
                    place[list(g.open)] = np.arange(len(g.open))
                    rows = np.flatnonzero(use & (place[node] >= 0))
                    cells = len(g.open) * width * size
                    if m not in total:
                        total[m] = np.zeros((len(g.columns), cells), np.int64)
                    base = place[node[rows]] * (width * size) + own[rows]
                    for i, f in enumerate(g.columns):
                        total[m][i] += np.bincount(np.multiply(codes[f].take(rows), size, dtype=np.int64) + base, minlength=cells)
        for m, found in total.items():
            g = work[m]
            found = found.reshape(len(g.columns), len(g.open), width, sizes[g.target]).swapaxes(0, 1)
            yield pa.record_batch({"model": pa.array([m], pa.int32()), "counts": pa.array([found.tobytes()], pa.binary())})

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for m, raw in zip(batch.column("model").to_pylist(), batch.column("counts")):
                found = np.frombuffer(raw.as_buffer(), np.int64)
                total[m] = total[m] + found if m in total else found
        for m, found in total.items():
            g = work[m]
            counts = found.reshape(len(g.open), len(g.columns), width, sizes[g.target])
            made = [(node, *s) for node, own in zip(g.open, counts) if (s := gini_split(own, g.columns, n_numeric)) is not None]
            root = counts[0, 0].sum(axis=0).tolist() if g.open == (1,) else None
            yield pa.record_batch({"model": pa.array([m], pa.int32()), "found": pa.array([json.dumps([root, made])])})

    counted = chunks.mapInArrow(count, "model int, counts binary").repartition(min(shuffle_partitions(chunks.sparkSession), len(work)), "model")
    return [(r.model, json.loads(r.found)) for r in counted.mapInArrow(split, "model int, found string").collect()]  # a line per tree


def grow(
    frame: DataFrame, bins: Bins, targets: Targets, draw: list[str], seed: int, trees: int, depth: int, share: float = 0.7, fold: str | None = None,
    held: list[int | None] = (None,),
) -> dict[tuple[str, int], list[tuple[Tree, dict[int, list[int]]]]]:
    """Forests by (target, place in ``held``): every tree with the class counts of its nodes.

    A tree sees about 70 % of the rows (by hash of ``draw``) and a ``share`` of the features, never its target. ``held`` lists values of
    ``fold`` whose rows a forest does not learn from. Missing values of a target are not learned from.
    """
    chunks = fitted(_chunked(frame, bins, targets, draw, fold), "chunks")
    names = targets.names
    sizes = [targets.size(t) for t in names]
    growing: dict[int, Growing] = {}
    leaves: dict[int, dict[int, list[int]]] = {}
    keys = []
    for t, name in enumerate(names):
        for h, own in enumerate(held):
            for n in range(trees):
                m = len(keys)
                keys.append((name, h))
                free = np.array([i for i, f in enumerate(bins.features) if f != name])
                columns = np.sort(np.random.Generator(np.random.PCG64([seed, m])).permutation(free)[: -(-int(100 * share * len(free)) // 100)])
                growing[m] = Growing(t, own, columns, (seed << 24) + m, Tree(), (1,))
                leaves[m] = {}
    for _ in range(depth):
        todo = [m for m, g in growing.items() if g.open and len(g.columns)]
        while todo:
            batch, held_bytes = {}, 0
            while todo and (not batch or held_bytes < BATCH):
                m = todo.pop()
                batch[m] = growing[m]
                held_bytes += 8 * len(growing[m].open) * len(growing[m].columns) * bins.width * sizes[growing[m].target]
            for m, (root, made) in _pass(chunks, batch, sizes, bins):
                g = growing[m]
                if root is not None:
                    leaves[m][1] = root
                lower = []
                for node, feature, left, *sides in made:
                    g.tree.feature[node], g.tree.left[node] = feature, left
                    for child, counts in zip((2 * node, 2 * node + 1), sides):
                        g.tree.value[child] = 0.0
                        leaves[m][child] = counts
                        lower.append(child)
                growing[m] = Growing(g.target, g.held, g.columns, g.seed, g.tree, tuple(sorted(lower)))
    forests: dict[tuple[str, int], list] = {}
    for m, key in enumerate(keys):
        forests.setdefault(key, []).append((growing[m].tree, leaves[m]))
    return forests


def distributions(forests: list[tuple[Tree, dict[int, list[int]]]], codes: np.ndarray, width: int, size: int) -> np.ndarray:
    """Mean class distribution of the trees for every row; a tree that learned nothing has no say, without any it is uniform."""
    total, n = np.zeros((codes.shape[1], size)), 0
    for tree, counts in forests:
        if not counts:
            continue
        table = np.zeros((max(max(counts), max(tree.value)) + 1, size))
        for node, own in counts.items():
            table[node] = np.array(own) / max(1, sum(own))
        total += table[nodes_of(codes, tree.routes(width))]
        n += 1
    return total / n if n else np.full((codes.shape[1], size), 1 / max(1, size))
