"""Blends and stacks over a prediction table.

Fits that need several passes (Newton steps, weight searches) form their sums as matrix
products inside the tasks and send only totals to the driver, never rows; all folds, member
subsets and candidate weights of a pass share one job.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.functions.scalars import logit, sigmoid
from tabloom.operators.lookup import fitted
from tabloom.operators.ranks import auc, rank_transform
from tabloom.session import shuffle_partitions


def mean_logit_blend(predictions: DataFrame, keep: list[str], p: str = "p") -> DataFrame:
    """Unweighted mean of the member logits, as a probability."""
    return predictions.groupBy(*keep).agg(F.avg(logit(p)).alias("margin")).withColumn("p", sigmoid("margin"))


def weighted_blend(predictions: DataFrame, keep: list[str], weights: dict[str, float], p: str = "p") -> DataFrame:
    """Weighted mean of member probabilities; members without a weight count 0."""
    total = float(sum(weights.values()))
    chain = F.when(F.lit(False), F.lit(0.0))
    for member, weight in weights.items():
        chain = chain.when(F.col("member") == member, F.lit(weight / total))
    return predictions.groupBy(*keep).agg(F.sum(chain.otherwise(F.lit(0.0)) * F.col(p)).alias("p"))


def weight_grid(wide: DataFrame, a: str, b: str, weights: list[float], keep: list[str]) -> DataFrame:
    """(keep, weight, p) for every weight of ``a`` against ``b``."""
    options = F.array(*[F.struct(F.lit(w).alias("weight"), (F.lit(w) * F.col(a) + F.lit(1 - w) * F.col(b)).alias("p")) for w in weights])
    return wide.select(*keep, F.inline(options))


def _dot(values: list[Column], weights: Column) -> Column:
    total = F.lit(0.0)
    for i, v in enumerate(values):
        total = total + v * F.get(weights, F.lit(i))
    return total


@dataclass
class StackFit:
    members: list[str]
    weights: np.ndarray  # one per member of the table, then the bias
    loss: float = float("nan")
    gradient: float = float("inf")
    iterations: int = 0
    rows: int = 0


def _matrix_pass(rows: DataFrame, members: list[str], label: str, fold: str, trials: list[tuple[int | None, np.ndarray]], work, width: int) -> np.ndarray:
    """Sum over all rows of what ``work(z, y, own, trials)`` gives per batch: one line of ``width`` numbers per trial.

    ``z`` is the batch's member matrix. Tasks keep one line per trial, lines of a trial are added up by one task, and only
    the totals reach the driver: nothing is repeated per row.
    """
    k = len(members)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(trials), width))
        for batch in batches:
            z = np.column_stack([np.asarray(batch.column(m), np.float64) for m in members]) if k else np.zeros((batch.num_rows, 0))
            total += work(z, np.asarray(batch.column("_y"), np.float64), np.asarray(batch.column("_fold")), trials)
        yield pa.record_batch({"trial": pa.array(range(len(trials)), pa.int32()), "line": pa.array(list(total), pa.list_(pa.float64()))})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for trial, line in zip(batch.column("trial").to_pylist(), batch.column("line")):
                total[trial] = total.get(trial, 0.0) + np.asarray(line.values)
        yield pa.record_batch({"trial": pa.array(list(total), pa.int32()), "line": pa.array(list(total.values()), pa.list_(pa.float64()))})

    schema = "trial int, line array<double>"
    lines = rows.select(F.col(label).cast("double").alias("_y"), F.col(fold).cast("int").alias("_fold"), *members).mapInArrow(run, schema)
    out = np.zeros((len(trials), width))
    for row in lines.repartition(min(len(trials), shuffle_partitions(rows.sparkSession)), "trial").mapInArrow(add, schema).collect():  # one row per trial
        out[row.trial] = row.line
    return out


def _logistic_sums(z: np.ndarray, y: np.ndarray, own: np.ndarray, trials: list[tuple[int | None, np.ndarray]]) -> np.ndarray:
    """Per trial: rows, log loss, gradient and Hessian of the logistic model with a bias."""
    z = np.column_stack([z, np.ones(len(z))])
    lines = []
    for out, w in trials:
        x, t = (z, y) if out is None else (z[own != out], y[own != out])
        eta = x @ w
        p = 1.0 / (1.0 + np.exp(-np.clip(eta, -700, 700)))
        loss = np.logaddexp(0.0, eta).sum() - t @ eta
        lines.append(np.concatenate([[len(t), loss], x.T @ (p - t), (x.T @ (x * (p * (1 - p))[:, None])).ravel()]))
    return np.array(lines)


def newton_fits(
    rows: DataFrame, members: list[str], label: str, fold: str, tasks: dict[object, tuple[int | None, list[str]]],
    C: float = 1.0, tol: float = 1e-8, max_iter: int = 60,
) -> dict[object, StackFit]:
    """L2-penalised logistic fits on member logits with an unpenalised bias (mean loss + |w|^2 / (2 C n)).

    A task is (fold left out or None, members used). From zero weights every task takes damped Newton steps: the damping
    shrinks tenfold after a step that lowers the objective and grows tenfold after one that does not, which is then taken
    back. All tasks share one pass over the rows per step. A task still above ``tol`` after ``max_iter`` passes is an error.
    """
    k = len(members) + 1
    names = list(tasks)
    free = {n: np.flatnonzero([m in tasks[n][1] for m in members] + [True]) for n in names}
    at = {n: np.zeros(k) for n in names}
    damping = dict.fromkeys(names, 0.0)
    held: dict[object, tuple] = {}  # accepted point: weights, objective, gradient, Hessian, rows
    steps = dict.fromkeys(names, 0)
    done: dict[object, StackFit] = {}
    for _ in range(max_iter):
        open_ = [n for n in names if n not in done]
        if not open_:
            break
        sums = _matrix_pass(rows, members, label, fold, [(tasks[n][0], at[n]) for n in open_], _logistic_sums, 2 + k + k * k)
        for n, line in zip(open_, sums):
            count, w = line[0], at[n]
            if count == 0:
                raise ValueError(f"stack {n}: no rows to fit on")
            shrink = np.append(np.full(k - 1, 1.0 / (C * count)), 0.0)
            value = line[1] / count + 0.5 * float(shrink @ (w * w))
            if n in held and value > held[n][1] + 1e-15:
                damping[n] = max(damping[n] * 10, 1e-6)
            else:
                gradient = line[2 : 2 + k] / count + shrink * w
                held[n] = (w, value, gradient, line[2 + k :].reshape(k, k) / count + np.diag(shrink), int(count))
                damping[n] = 0.0 if damping[n] < 1e-9 else damping[n] / 10
                steps[n] += 1
            w, value, gradient, curve, count = held[n]
            steep = float(np.abs(gradient[free[n]]).max())
            if steep < tol:
                done[n] = StackFit(tasks[n][1], w, value, steep, steps[n] - 1, count)
                continue
            inner = curve[np.ix_(free[n], free[n])]
            move = np.zeros(k)
            move[free[n]] = np.linalg.lstsq(inner + damping[n] * np.diag(np.diag(inner)), gradient[free[n]], rcond=None)[0]
            at[n] = w - move
    stuck = {str(n): float(np.abs(held[n][2][free[n]]).max()) for n in names if n not in done}
    if stuck:
        raise RuntimeError(f"stacks did not settle within {max_iter} passes, largest gradients {stuck}")
    return done


def logit_table(wide: DataFrame, members: list[str], keep: list[str]) -> DataFrame:
    """Member logits as a stored table, read once per Newton pass."""
    return fitted(wide.select(*keep, *[logit(m).alias(m) for m in members]), "logits")


def apply_stack(rows: DataFrame, members: list[str], fit: StackFit) -> Column:
    """Probability of a stack for a table of member logits, bias included."""
    return sigmoid(_dot([F.col(m) for m in members] + [F.lit(1.0)], F.array(*[F.lit(float(x)) for x in fit.weights])))


def nested_stack_scores(
    rows: DataFrame, members: list[str], label: str, fold: str, folds: int, subsets: dict[str, list[str]], keep: list[str], C: float = 1.0
) -> tuple[DataFrame, dict[object, StackFit]]:
    """(keep, label, fold, stack, p): each row scored by weights fitted on the other folds, for every member subset.

    The fits also hold each subset's weights over all rows, under (subset, None), for rows to score.
    """
    tasks = {(s, f): (f, chosen) for s, chosen in subsets.items() for f in [*range(folds), None]}
    fits = newton_fits(rows, members, label, fold, tasks, C)
    table = F.array(
        *[
            F.struct(
                F.lit(s).alias("stack"),
                F.array(*[F.array(*[F.lit(float(x)) for x in fits[(s, f)].weights]) for f in range(folds)]).alias("w"),
            )
            for s in subsets
        ]
    )
    spread = rows.select(*keep, label, fold, *members, F.inline(table))
    score = sigmoid(_dot([F.col(m) for m in members] + [F.lit(1.0)], F.get(F.col("w"), F.col(fold))))
    return spread.select(*keep, label, fold, "stack", score.alias("p")), fits


def nested_stack_aucs(rows: DataFrame, members: list[str], label: str, fold: str, folds: int, subsets: dict[str, list[str]]) -> dict[str, float]:
    scores, _ = nested_stack_scores(rows, members, label, fold, folds, subsets, [])
    table = auc(scores.withColumn("p", F.round("p", 9)), "p", label, by=["stack"])
    return {row.stack: row.auc for row in table.collect()}  # one row per subset


def greedy_selection(rows: DataFrame, members: list[str], label: str, fold: str, folds: int, min_gain: float = 1e-7) -> list[tuple[int, str, float]]:
    """Members in the order in which each lifts the nested score most: (step, member, auc)."""
    chosen: list[str] = []
    best, trail = -1.0, []
    while len(chosen) < len(members):
        options = {m: [*chosen, m] for m in members if m not in chosen}
        scores = nested_stack_aucs(rows, members, label, fold, folds, options)
        name = max(sorted(scores), key=lambda m: scores[m])
        if scores[name] - best < min_gain:
            break
        chosen.append(name)
        best = scores[name]
        trail.append((len(chosen), name, best))
    return trail


def leave_group_out(rows: DataFrame, members: list[str], label: str, fold: str, folds: int, groups: dict[str, list[str]]) -> dict[str, float]:
    """Nested score with all members and without each group."""
    subsets = {"all": members, **{f"without {g}": [m for m in members if m not in out] for g, out in groups.items()}}
    return nested_stack_aucs(rows, members, label, fold, folds, subsets)


def rank_members(predictions: DataFrame) -> DataFrame:
    """Scores replaced by their average rank / n within each member."""
    return rank_transform(predictions, ["member"], "p", "rank")


def _binned_aucs(rows: DataFrame, members: list[str], label: str, fold: str, trials: list[tuple[int | None, np.ndarray]], bins: int) -> list[float]:
    """AUC of every trial blend on scores cut into ``bins``, from two histograms per trial."""

    def histograms(z: np.ndarray, y: np.ndarray, own: np.ndarray, trials: list) -> np.ndarray:
        score = z @ np.stack([w for _, w in trials], axis=1)
        cell = np.clip((score * bins).astype(np.int64), 0, bins - 1) + bins * (y > 0).astype(np.int64)[:, None]
        lines = [np.bincount(cell[:, t] if out is None else cell[own != out, t], minlength=2 * bins) for t, (out, _) in enumerate(trials)]
        return np.array(lines, np.float64)

    found = []
    for line in _matrix_pass(rows, members, label, fold, trials, histograms, 2 * bins):
        neg, pos = line[:bins], line[bins:]
        below = np.cumsum(neg) - neg
        found.append(float((pos * (below + neg / 2)).sum() / (pos.sum() * neg.sum())))
    return found


def exact_aucs(rows: DataFrame, members: list[str], label: str, fold: str, finalists: dict[object, tuple[int | None, np.ndarray]]) -> dict[object, float]:
    """Exact AUC of a few blends, ties averaged, on the rows outside each one's left-out fold."""
    names = list(finalists)
    entries = F.array(
        *[
            F.struct(F.lit(i).alias("t"), F.lit(-1 if out is None else out).alias("o"), F.array(*[F.lit(float(x)) for x in w]).alias("w"))
            for i, (out, w) in enumerate(finalists.values())
        ]
    )
    spread = rows.select(label, F.col(fold).alias("_fold"), *members, F.explode(entries).alias("c")).where(F.col("_fold") != F.col("c.o"))
    scored = spread.select(label, F.col("c.t").alias("t"), F.round(_dot([F.col(m) for m in members], F.col("c.w")), 12).alias("p"))
    return {names[r.t]: r.auc for r in auc(scored, "p", label, by=["t"]).collect()}  # one row per finalist


def coordinate_ascent(
    rows: DataFrame, members: list[str], label: str, fold: str, tasks: dict[object, int | None], grid: int = 21, sweeps: int = 4, bins: int = 10_000
) -> dict[object, np.ndarray]:
    """Non-negative weights summing to one that maximise AUC, per task (fold left out or None).

    Every member's candidate weights of all tasks are tried in one pass. Inside a sweep candidates are compared on binned
    AUCs; what a sweep ends with replaces what it began with only if its exact AUC is higher.
    """
    weights = {t: np.full(len(members), 1.0 / len(members)) for t in tasks}
    values = np.linspace(0.0, 1.0, grid)
    settled: set = set()
    for _ in range(sweeps):
        begun = {t: w / w.sum() for t, w in weights.items()}
        for i in range(len(members)):
            trials, owners = [], []
            for t, out in tasks.items():
                if t in settled:
                    continue
                for v in [weights[t][i], *values]:
                    w = weights[t].copy()
                    w[i] = v
                    if w.sum() > 0:
                        trials.append((out, w / w.sum()))
                        owners.append((t, w))
            scores = _binned_aucs(rows, members, label, fold, trials, bins)
            best: dict[object, tuple[float, np.ndarray]] = {}
            for (t, w), score in zip(owners, scores):
                if t not in best or score > best[t][0] + 1e-12:
                    best[t] = (score, w)
            for t, (_, w) in best.items():
                weights[t] = w
        ended = {t: weights[t] / weights[t].sum() for t in tasks if t not in settled}
        finalists = {(t, which): (tasks[t], w) for t in ended for which, w in (("begun", begun[t]), ("ended", ended[t]))}
        exact = exact_aucs(rows, members, label, fold, finalists)
        for t in ended:
            if exact[t, "ended"] <= exact[t, "begun"]:
                weights[t] = begun[t]
                settled.add(t)
        if len(settled) == len(tasks):
            break
    return {t: w / w.sum() for t, w in weights.items()}


def blend_with(rows: DataFrame, members: list[str], fold: str, weights: dict[int, np.ndarray]) -> Column:
    """Weighted sum with the weights of the row's own fold."""
    table = F.array(*[F.array(*[F.lit(float(x)) for x in weights[f]]) for f in sorted(weights)])
    return _dot([F.col(m) for m in members], F.get(table, F.col(fold)))


def choose_best(scores: DataFrame, name: str, value: str) -> DataFrame:
    """The name with the highest value (ties: smallest name)."""
    return scores.orderBy(F.desc(value), name).limit(1).select(name, value)


def view_decisions(view_scores: DataFrame, baseline: float | Column, min_gain: float) -> DataFrame:
    """(view, auc, gain, decision, is_best): accepted when the nested gain reaches ``min_gain``."""
    base = baseline if isinstance(baseline, Column) else F.lit(float(baseline))
    repeated = view_scores.groupBy("view").count().where("count > 1").limit(1).count()
    if repeated:
        raise ValueError("view names must be unique")
    decided = view_scores.withColumn("gain", F.col("auc") - base).withColumn("decision", F.when(F.col("gain") >= min_gain, "ACCEPT").otherwise("REJECT"))
    accepted = F.when(F.col("decision") == "ACCEPT", F.col("auc"))
    best = decided.agg(F.max_by("view", accepted)).scalar()
    return decided.withColumn("is_best", F.coalesce((F.col("view") == best) & (F.col("decision") == "ACCEPT"), F.lit(False)))
