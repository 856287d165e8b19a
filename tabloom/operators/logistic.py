"""Logistic members of all folds fitted in shared passes over chunks of rows.

``spark.ml`` prepares, stores and walks through the fit rows once per fold. Here rows are stored once, every column in the narrowest type that
holds its values; a task adds the losses and gradients of all folds up as matrix products, and the driver, which takes one line per task, makes
the same steps: filling by medians, codes, scales, L-BFGS with its line search, start values and stop rules are those of ``spark.ml``.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Generator, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.operators.lookup import fitted

CHUNK_ROWS = 1 << 16
BLOCK_ROWS = 2048  # what a core's cache holds
ONE_THREAD = 1 << 18  # matrix products up to this size stay in the task's own thread
FEW_LEVELS = 16  # a category with no more has a column per level in the products
SAFE = 40.0  # the product of 16 exponentials of this size is still a number
HEAD = 8  # bytes before the values of a packed column
NARROW = ("b", "h", "i")


def _pack(values: np.ndarray) -> bytes:
    """Numbers, NaN where missing, in the narrowest type that holds them; the smallest integer of a type stands for a missing one."""
    gone = np.isnan(values)
    seen = values[~gone]
    kind = "d"
    if (seen == np.floor(seen)).all():
        low, high = (seen.min(), seen.max()) if len(seen) else (0, 0)
        kind = next((k for k in NARROW if np.iinfo(k).min < low and high <= np.iinfo(k).max), "d")
    if kind != "d":
        values = np.where(gone, np.iinfo(kind).min, values)
    return kind.encode().ljust(HEAD) + values.astype(kind).tobytes()


def _unpack(packed: pa.BinaryScalar) -> tuple[np.ndarray, np.ndarray | None]:
    """The values as they are stored, and which are missing if any is."""
    buffer = packed.as_buffer()
    kind = bytes(buffer[:1]).decode()
    values = np.frombuffer(buffer, kind, offset=HEAD)
    gone = np.isnan(values) if kind == "d" else values == np.iinfo(kind).min
    return values, gone if gone.any() else None


@dataclass(frozen=True)
class Chunk:
    """Rows of one chunk, fold by fold: columns and where they are missing, codes per category, labels, and where the rows of each held fold end."""

    x: list[np.ndarray]
    gone: list[np.ndarray | None]
    codes: list[np.ndarray]
    y: np.ndarray
    ends: np.ndarray

    def folds(self) -> list[slice]:
        """The rows of each held fold, then those of all others."""
        return [slice(a, b) for a, b in zip([0, *self.ends[:-1]], self.ends)]

    def centred(self, centres: np.ndarray, rows: slice, out: np.ndarray) -> dict[int, np.ndarray]:
        """Columns less their centres, 0 where missing; returns the missing rows of columns that have some."""
        for j, x in enumerate(self.x):
            out[j] = x[rows]
        out[: len(self.x)] -= centres[:, None]
        missing = {j: np.flatnonzero(gone[rows]) for j, gone in enumerate(self.gone) if gone is not None}
        for j, at in missing.items():
            out[j, at] = 0.0
        return missing


def _chunks(frame: DataFrame, numeric: list[str], categorical: list[str], label: str, fold: str, held: list[int], levels: list[list[str]]) -> DataFrame:
    """The rows in stored chunks; a missing or unknown category has the code after the last one."""
    sets = [pa.array(found, pa.string()) for found in levels]

    def packed(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(batches).combine_chunks()
        numbers = rows["numbers"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(rows.num_rows, -1).T
        y, folds = numbers[-2], numbers[-1]
        if ((y != 0.0) & (y != 1.0)).any():
            raise ValueError("labels must be 0 or 1")
        group = np.full(len(y), len(held), np.int16)
        for place, f in enumerate(held):
            group[folds == f] = place
        order = np.argsort(group, kind="stable")
        x = [_pack(v[order]) for v in numbers[:-2]]
        codes = [pc.fill_null(pc.index_in(rows[f"c{j}"], found), len(found)).to_numpy().astype(np.int32)[order].tobytes() for j, found in enumerate(sets)]
        ends = np.cumsum(np.bincount(group, minlength=len(held) + 1)).astype(np.int64)
        columns = {
            "kinds": pa.array(["".join(chr(p[0]) for p in x)]), "x": pa.array([x], pa.list_(pa.binary())), "codes": pa.array([codes], pa.list_(pa.binary())),
            "y": pa.array([y[order].astype(np.int8).tobytes()], pa.binary()), "ends": pa.array([ends.tobytes()], pa.binary()),
        }
        return pa.record_batch(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, rows = [], 0
        for batch in batches:
            waiting.append(batch)
            rows += batch.num_rows
            if rows >= CHUNK_ROWS:
                yield packed(waiting)
                waiting, rows = [], 0
        if rows:
            yield packed(waiting)

    # one array of all numbers: Spark measures every column of a batch at every row
    numbers = F.array(*[F.col(c).cast("double") for c in (*numeric, label, fold)])
    rows = frame.where(F.col(fold).isNotNull()).select(numbers.alias("numbers"), *[F.col(c).cast("string").alias(f"c{j}") for j, c in enumerate(categorical)])
    return fitted(rows.mapInArrow(run, "kinds string, x array<binary>, codes array<binary>, y binary, ends binary"), "chunks")


def _summed(chunks: DataFrame, part: Callable[[Chunk], np.ndarray]) -> np.ndarray | None:
    """The sum of ``part`` over all chunks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for x, codes, y, ends in zip(*(batch.column(c) for c in ("x", "codes", "y", "ends"))):
                values = [_unpack(v) for v in x]
                own = [np.frombuffer(c.as_buffer(), np.int32) for c in codes]
                found = part(Chunk([v for v, _ in values], [g for _, g in values], own, np.frombuffer(y.as_buffer(), np.int8), np.frombuffer(ends.as_buffer(), np.int64)))
                total = found if total is None else total + found
        if total is not None:
            yield pa.record_batch({"shape": pa.array([list(total.shape)], pa.list_(pa.int64())), "sums": pa.array([total.tobytes()], pa.binary())})

    lines = chunks.select("x", "codes", "y", "ends").mapInArrow(run, "shape array<bigint>, sums binary").collect()  # one per task
    return sum(np.frombuffer(r.sums).reshape(r.shape) for r in lines) if lines else None


def _ordered(values: np.ndarray, bits: int) -> np.ndarray:
    """Unsigned integers of ``bits`` bits that are ordered like the values."""
    if bits < 64:
        return (values.astype(np.int64) + (1 << bits - 1)).astype(np.uint64)
    raw = (values.astype(np.float64) + 0.0).view(np.uint64)
    return np.where(raw >> np.uint64(63) == 1, ~raw, raw | np.uint64(1 << 63))


def _valued(key: int, bits: int) -> float:
    if bits < 64:
        return float(key - (1 << bits - 1))
    raw = key ^ (1 << 63) if key >> 63 else key ^ (1 << 64) - 1
    return float(np.array([raw], np.uint64).view(np.float64)[0])


def _medians(chunks: DataFrame, numeric: list[str], held: int) -> np.ndarray:
    """The lower median of every column over the fit rows of every held fold, exact: its bits are found eight at a time by counting."""
    kinds = [r.kinds for r in chunks.select("kinds").distinct().collect()]  # few: one letter per column
    bits = [max(8 * np.dtype(k[j]).itemsize for k in kinds) if kinds else 8 for j in range(len(numeric))]
    prefix, rank = np.zeros((held, len(numeric)), object), np.zeros((held, len(numeric)), object)
    for shift in range(max(bits, default=0) - 8, -1, -8):
        at = [j for j, b in enumerate(bits) if b > shift]
        wanted = {j: sorted(set(prefix[:, j])) for j in at}
        most = max(map(len, wanted.values()))

        def counted(chunk: Chunk, at=at, wanted=wanted, most=most, shift=shift) -> np.ndarray:
            out = np.zeros((len(at), most, held + 1, 256))
            for n, j in enumerate(at):
                for g, rows in enumerate(chunk.folds()):
                    seen = chunk.x[j][rows] if chunk.gone[j] is None else chunk.x[j][rows][~chunk.gone[j][rows]]
                    keys = _ordered(seen, bits[j])
                    high, low = keys >> np.uint64(shift) >> np.uint64(8), (keys >> np.uint64(shift) & np.uint64(255)).astype(np.int64)
                    for m, found in enumerate(wanted[j]):
                        out[n, m, g] = np.bincount(low if shift + 8 >= bits[j] else low[high == np.uint64(found)], minlength=256)
            return out

        sums = _summed(chunks, counted)
        for n, j in enumerate(at):
            for f in range(held):
                counts = np.zeros(256) if sums is None else np.delete(sums[n, wanted[j].index(prefix[f, j])], f, axis=0).sum(axis=0)
                below = np.cumsum(counts).astype(np.int64)
                if shift + 8 >= bits[j]:
                    rank[f, j] = -(-int(below[-1]) // 2)
                if not below[-1]:
                    raise ValueError(f"no value of {numeric[j]} to take a median of")
                digit = int(np.searchsorted(below, rank[f, j]))
                rank[f, j] -= int(below[digit - 1]) if digit else 0
                prefix[f, j] = prefix[f, j] << 8 | digit
    return np.array([[_valued(prefix[f, j], bits[j]) for j in range(len(numeric))] for f in range(held)]).reshape(held, len(numeric))


class _Failed(Exception):
    """A step that cannot be made."""


def _direction(grad: np.ndarray, history: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The L-BFGS direction; the newest pair of step and change of gradient comes first."""
    out, found = grad.copy(), []
    scale = 1.0
    if history:
        step, change = history[0]
        with np.errstate(divide="ignore", invalid="ignore"):
            product = step @ change
            if product < 0 or np.isnan(product):
                raise _Failed
            scale = product / (change @ change)
    for step, change in history:
        with np.errstate(divide="ignore", invalid="ignore"):
            a = (step @ out) / (step @ change)
        if np.isnan(a):
            raise _Failed
        found.append(a)
        out -= a * change
    out *= scale
    for (step, change), a in zip(reversed(history), reversed(found)):
        out += (a - (change @ out) / (step @ change)) * step
    return -out


def _between(left: tuple[float, float, float], right: tuple[float, float, float]) -> float:
    """Where the cubic through both ends (place, slope, value) has its minimum, not too near to either."""
    (t0, d0, v0), (t1, d1, v1) = left, right
    a = d0 + d1 - 3 * (v0 - v1) / (t0 - t1)
    inner = a * a - d0 * d1
    b = math.sqrt(inner) if inner >= 0 else math.nan
    width = t1 - t0
    bottom = d1 - d0 + 2 * b
    t = t1 - width * (d1 + b - a) / bottom if bottom else math.nan
    return t0 + 0.1 * width if t < t0 + 0.1 * width else t0 + 0.9 * width if t > t0 + 0.9 * width else t


Search = Generator[np.ndarray, tuple[float, np.ndarray], tuple]


def _searched(x: np.ndarray, value: float, grad: np.ndarray, direction: np.ndarray, t: float) -> Search:
    """A step along the direction, ``t`` tried first, that meets the strong Wolfe conditions: (step, point, value, gradient)."""
    seen: tuple = ()

    def at(t: float) -> Search:
        nonlocal seen
        point = x + direction * t
        found = yield point
        seen = (t, point, *found)
        return t, float(found[1] @ direction), found[0]

    low = (0.0, float(grad @ direction), value)
    slope = low[1]
    if slope > 0:
        raise _Failed

    def zoom(low: tuple, high: tuple) -> Search:
        for _ in range(10):
            here = yield from at(_between(high, low) if low[0] > high[0] else _between(low, high))
            if here[2] > value + 1e-4 * here[0] * slope or here[2] >= low[2]:
                high = here
                continue
            if abs(here[1]) <= 0.9 * abs(slope):
                return
            if here[1] * (high[0] - low[0]) >= 0:
                high = low
            low = here
        raise _Failed

    for i in range(10):
        here = yield from at(t)
        if math.isinf(here[2]) or math.isnan(here[2]):
            t /= 2.0
            continue
        if here[2] > value + 1e-4 * t * slope or (here[2] >= low[2] and i > 0):
            yield from zoom(low, here)
            return seen
        if abs(here[1]) <= 0.9 * abs(slope):
            return seen
        if here[1] >= 0:
            yield from zoom(here, low)
            return seen
        low = here
        t *= 1.5
    raise _Failed


def minimised(start: np.ndarray, rounds: int, tol: float, memory: int = 10) -> Search:
    """L-BFGS that asks for value and gradient of the points it yields and returns the last one, with the steps and stop rules of ``spark.ml``'s."""
    x = start
    value, grad = yield x
    history, recent, first, done, failed = [], [math.inf], value, 0, False
    while True:
        if done >= rounds or np.linalg.norm(grad) <= max(tol * value, 1e-8) or (len(recent) >= 2 and abs(value - max(recent)) <= tol * abs(first)):
            return x
        try:
            direction = _direction(grad, history)
            step, point, new, slope = yield from _searched(x, value, grad, direction, 1.0 if done else 1.0 / float(np.linalg.norm(direction)))
            if step * np.linalg.norm(grad) < 1e-10:
                raise _Failed
        except _Failed:
            if failed:
                return x
            history, failed = [], True
            continue
        history = [(point - x, slope - grad), *history][:memory]
        x, value, grad, done, failed = point, new, slope, done + 1, False
        recent = [*recent, value][-20:]


@dataclass(frozen=True)
class Linear:
    """Fitted members of the held folds: what a missing number is filled with, centres and weights of numbers, weights of levels and of unknown ones."""

    numeric: list[str]
    categorical: list[str]
    centres: list[float]
    medians: list[list[float]]
    weights: list[list[float]]
    levels: list[list[dict[str, float]]]
    others: list[list[float]]
    intercepts: list[float]

    def probability(self, member: Column) -> Column:
        """Of a positive label, by the member of the given place; one expression serves all of them."""

        def of(values: list[float]) -> Column:
            return F.lit(values)[member]

        margin = of(self.intercepts)
        for j, c in enumerate(self.numeric):
            x = F.col(c).cast("double")
            filled = F.coalesce(F.nanvl(x, F.lit(None).cast("double")), of([m[j] for m in self.medians]))
            margin = margin + of([w[j] for w in self.weights]) * (filled - F.lit(self.centres[j]))
        for k, c in enumerate(self.categorical):
            names = sorted({v for own in self.levels for v in own[k]})
            others = [o[k] for o in self.others]
            known = of(others)
            if names:
                table = F.map_from_arrays(F.lit(names), F.lit([[own[k].get(v, o) for own, o in zip(self.levels, others)] for v in names]))
                known = F.coalesce(F.try_element_at(table, F.col(c).cast("string"))[member], known)
            margin = margin + known
        return 1 - 1 / (1 + F.exp(margin))


@dataclass(frozen=True)
class _Scaled:
    """Standardised features of every model: numbers first, then a column per level and one for unknown levels of each category."""

    medians: np.ndarray
    means: np.ndarray
    inverse: np.ndarray  # 0 for a column that is the same in all fit rows

    def raw(self, points: np.ndarray, models: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Weights and constants for features as they are."""
        weights = points[:, :-1] * self.inverse[models]
        return weights, points[:, -1] - (weights * self.means[models]).sum(axis=1)


def _scaled(chunks: DataFrame, medians: np.ndarray, centres: np.ndarray, sizes: list[int], held: int) -> tuple[_Scaled, np.ndarray, np.ndarray]:
    """Means and scales of all models' features, their numbers of fit rows and of positive ones, in one pass."""
    numbers, width = len(centres), len(centres) + sum(sizes)

    def moments(chunk: Chunk) -> np.ndarray:
        out = np.zeros((held + 1, 2 + 3 * numbers + held * numbers + sum(sizes)))
        for g, rows in enumerate(chunk.folds()):
            x = np.empty((numbers, rows.stop - rows.start))
            missing = chunk.centred(centres, rows, x)
            gone = [len(missing.get(j, ())) for j in range(numbers)]
            differ = []
            for own in medians:
                for j, m in enumerate(own):
                    other = chunk.x[j][rows] != m
                    other[missing.get(j, slice(0))] = False
                    differ.append(np.count_nonzero(other))
            counts = [np.bincount(c[rows], minlength=n) for c, n in zip(chunk.codes, sizes)]
            out[g] = np.concatenate([[x.shape[1], chunk.y[rows].sum()], x.sum(axis=1), (x * x).sum(axis=1), gone, differ, *counts])
        return out

    sums = _summed(chunks, moments)
    if sums is None:
        raise ValueError("no rows to fit on")
    means, inverse, rows, positive = np.zeros((held, width)), np.zeros((held, width)), np.zeros(held), np.zeros(held)
    for f in range(held):
        fit = np.delete(sums, f, axis=0).sum(axis=0)
        n, rows[f], positive[f] = fit[0], fit[0], fit[1]
        first, second, gone = fit[2 : 2 + 3 * numbers].reshape(3, numbers)
        differ = fit[2 + 3 * numbers : 2 + (3 + held) * numbers].reshape(held, numbers)[f]
        counts = fit[2 + (3 + held) * numbers :]
        filled = medians[f] - centres
        first, second = first + gone * filled, second + gone * filled * filled
        means[f] = np.concatenate([first, counts]) / n
        spread = np.concatenate([np.where(differ > 0, np.maximum(second - first * first / n, 0.0), 0.0), counts * (n - counts) / n])
        np.divide(1.0, np.sqrt(spread / max(n - 1, 1)), out=inverse[f], where=spread > 0)
    return _Scaled(medians, means, inverse), rows, positive


def _losses(chunks: DataFrame, scaled: _Scaled, centres: np.ndarray, sizes: list[int], points: dict[int, np.ndarray]) -> dict[int, tuple[float, np.ndarray]]:
    """Summed log loss of the models at their points, and its gradient, in one pass."""
    models = list(points)
    weights, constants = scaled.raw(np.array([points[f] for f in models]), models)
    numbers, width = len(centres), weights.shape[1]
    starts = np.cumsum([numbers, *sizes])[:-1]
    filled = scaled.medians[models] - centres
    dense = [(k, start, size) for k, (start, size) in enumerate(zip(starts, sizes)) if size <= FEW_LEVELS]
    sparse = [(k, start, size) for k, (start, size) in enumerate(zip(starts, sizes)) if size > FEW_LEVELS]
    columns = [*range(numbers), *(c for _, start, size in dense for c in range(start, start + size)), width]
    table = np.column_stack([weights, constants])
    block = max(256, min(BLOCK_ROWS, ONE_THREAD // (len(models) * len(columns))))

    def part(chunk: Chunk) -> np.ndarray:
        out = np.zeros((len(models), width + 2))
        space = np.ones((len(columns), block)), np.empty((2, len(models) * (block + 16)))  # fresh memory would cost more than the sums
        for g, rows in enumerate(chunk.folds()):
            use = [n for n, f in enumerate(models) if f != g]  # the models that are fitted on this fold
            if use:
                for at in range(rows.start, rows.stop, block):
                    added(chunk, slice(at, min(at + block, rows.stop)), use, out, *space)
        return out

    def added(chunk: Chunk, rows: slice, use: list[int], out: np.ndarray, x: np.ndarray, space: np.ndarray) -> None:
        n, k16 = rows.stop - rows.start, -(-(rows.stop - rows.start) // 16)
        x = x[:, :n]
        missing, line = chunk.centred(centres, rows, x), numbers
        for k, _, size in dense:
            for level in range(size):
                np.equal(chunk.codes[k][rows], level, out=x[line])
                line += 1
        sign = 1.0 - 2.0 * chunk.y[rows]
        margin = np.matmul(table[np.ix_(use, columns)], x, out=space[0, : len(use) * n].reshape(len(use), n))
        for k, start, size in sparse:
            margin += np.take(table[use, start : start + size], chunk.codes[k][rows], axis=1)
        for j, where in missing.items():
            margin[:, where] += (table[use, j] * filled[use, j])[:, None]
        margin *= sign  # large where a row is on the wrong side
        if margin.max() > SAFE:
            out[use, width + 1] += np.logaddexp(0.0, margin).sum(axis=1)
            rest = np.exp(-np.logaddexp(0.0, -margin))
        else:
            rest = np.exp(margin, out=margin)
            more = space[1, : len(use) * 16 * k16].reshape(len(use), -1)
            more[:, n:] = 1.0
            np.add(rest, 1.0, out=more[:, :n])
            rest /= more[:, :n]
            for half in (8 * k16, 4 * k16, 2 * k16, k16):  # a sum of logarithms is the logarithm of a product
                more[:, :half] *= more[:, half : 2 * half]
            out[use, width + 1] += np.log(more[:, :k16]).sum(axis=1)
        rest *= sign
        out[np.ix_(use, columns)] += rest @ x.T
        for j, where in missing.items():
            out[use, j] += rest[:, where].sum(axis=1) * filled[use, j]
        for k, start, size in sparse:
            for r, m in zip(rest, use):
                out[m, start : start + size] += np.bincount(chunk.codes[k][rows], r, size)

    sums = _summed(chunks, part)
    found = {}
    for n, f in enumerate(models):
        grad = (sums[n, :width] - scaled.means[f] * sums[n, width]) * scaled.inverse[f]
        found[f] = (sums[n, width + 1], np.append(grad, sums[n, width]))
    return found


def fit_folds(frame: DataFrame, numeric: list[str], categorical: list[str], label: str, fold: str, held: list[int], penalty: float, rounds: int, tol: float) -> Linear:
    """Logistic members, one per held fold, fitted on the rows of all other folds; all of them share the passes.

    Rows without a fold belong to none. A fold whose fit rows have one label only gives that label with certainty.
    """
    found = frame.agg(F.lit(0), *[F.collect_set(F.col(c).cast("string")) for c in categorical]).first()  # as many values as a member has indicators
    levels = [sorted(v) for v in found[1:]]
    sizes = [len(v) + 1 for v in levels]
    chunks = _chunks(frame, numeric, categorical, label, fold, held, levels)
    medians = _medians(chunks, numeric, len(held))
    centres = medians[0].copy()
    scaled, rows, positive = _scaled(chunks, medians, centres, sizes, len(held))
    if not rows.all():
        raise ValueError("no rows to fit on")
    width = len(numeric) + sum(sizes)
    solved = {f: np.append(np.zeros(width), math.inf if p else -math.inf) for f, (n, p) in enumerate(zip(rows, positive)) if p in (0, n)}
    searches = {f: minimised(np.append(np.zeros(width), math.log(positive[f] / (rows[f] - positive[f]))), rounds, tol) for f in range(len(held)) if f not in solved}
    points = {f: next(search) for f, search in searches.items()}
    while points:
        losses, wanted = _losses(chunks, scaled, centres, sizes, points), {}
        for f, (value, grad) in losses.items():
            inner = np.append(points[f][:-1], 0.0)  # the intercept is not drawn to 0
            try:
                wanted[f] = searches[f].send((value / rows[f] + penalty / 2 * (inner @ inner), grad / rows[f] + penalty * inner))
            except StopIteration as end:
                solved[f] = end.value
        points = wanted
    members = [_member(scaled, solved[f], f, numeric, levels) for f in range(len(held))]
    return Linear(numeric, categorical, centres.tolist(), medians.tolist(), *(list(v) for v in zip(*members)))


def _member(scaled: _Scaled, point: np.ndarray, f: int, numeric: list[str], levels: list[list[str]]) -> tuple[list[float], list[dict[str, float]], list[float], float]:
    """Weights of numbers, of levels and of unknown ones, and the intercept for centred numbers."""
    weights, constants = scaled.raw(point[None], [f])
    own, at, known, others = weights[0].tolist(), len(numeric), [], []
    for names in levels:
        others.append(own[at + len(names)])
        # a level that no fit row has is an unknown one
        known.append({v: own[at + i] for i, v in enumerate(names) if scaled.means[f][at + i] > 0})
        at += len(names) + 1
    return own[: len(numeric)], known, others, float(constants[0])
