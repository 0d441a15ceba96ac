"""DPO over frozen features: a linear head on the differences of two responses, beside stored log-probabilities.

The margin of a pair is beta * (own + w . delta), where own = (policy_chosen - ref_chosen) - (policy_rejected -
ref_rejected) is what the stored log-probabilities give. The loss is the mean softplus of the negative margin, plus l2 / 2
times the square of w. Each step is one pass that sums gradients in batches; one vector for each task reaches the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import ConfigError, DataError
from ..session import checkpointed


@dataclass
class Fitted:
    weights: np.ndarray
    best_step: int
    steps: int
    stopped_early: bool
    #: step, train_loss, and loss and accuracy on the validation side
    curve: list[tuple[int, float, float, float]] = field(default_factory=list)


def margins(delta: np.ndarray, own: np.ndarray, w: np.ndarray, beta: float) -> np.ndarray:
    return beta * (own + delta @ w)


def sums(delta: np.ndarray, own: np.ndarray, w: np.ndarray, beta: float) -> tuple[np.ndarray, float, float, int]:
    """Of these pairs: the gradient's sum, the loss's, right answers (ties for half) and their number."""
    m = margins(delta, own, w, beta)
    slope = -beta / (1 + np.exp(np.clip(m, -50, 50)))
    return delta.T @ slope, float(np.logaddexp(0, -m).sum()), float((m > 0).sum() + 0.5 * (m == 0).sum()), len(m)


def _pass(rows: DataFrame, w: np.ndarray, beta: float) -> tuple[np.ndarray, float, float, int]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(w) + 3)
        for b in batches:
            if len(b):
                delta = b.column(0).flatten().to_numpy().reshape(len(b), -1)
                g, loss, right, n = sums(delta, b.column(1).to_numpy(), w, beta)
                total += np.r_[g, loss, right, n]
        yield pa.RecordBatch.from_arrays([pa.array([total], pa.list_(pa.float64()))], names=["total"])

    parts = rows.select("delta", "own").mapInArrow(run, "total array<double>").collect()  # one row for each task
    total = np.sum([r.total for r in parts], axis=0) if parts else np.zeros(len(w) + 3)
    n = max(1, int(total[-1]))
    return total[:-3] / n, total[-3] / n, total[-2] / n, int(total[-1])


def fit(train: DataFrame, val: DataFrame, beta: float = 0.1, l2: float = 1e-3, steps: int = 50, rate: float = 1.0, every: int = 5, patience: int = 3, least_gain: float = 0.0) -> Fitted:
    """Fits on train and selects by accuracy on val; both have delta (array of doubles) and the four log-probabilities.

    Step 0 is measured and not selected: there the head adds nothing. Every `every` steps the validation side is read; after
    `patience` readings without a gain of more than least_gain the fit ends. Steps are scaled by the root of squared gradients.
    """
    if beta <= 0 or steps < 1 or every < 1:
        raise ConfigError("beta, steps and every must be positive")
    own = F.col("policy_chosen") - F.col("ref_chosen") - F.col("policy_rejected") + F.col("ref_rejected")
    a, b = (checkpointed(x.select(F.transform("delta", lambda v: v.cast("double")).alias("delta"), own.cast("double").alias("own"))) for x in (train, val))
    first = a.first()
    if first is None:
        raise DataError("there are no pairs to train on")
    w = np.zeros(len(first.delta))
    square = np.zeros_like(w)
    _, loss, right, _ = _pass(b, w, beta)
    out = Fitted(w, 0, 0, False, [(0, _pass(a, w, beta)[1], loss, right)])
    best, stale = None, 0
    for step in range(1, steps + 1):
        g, loss, _, _ = _pass(a, w, beta)
        g = g + l2 * w
        square += g * g
        w = w - rate * g / (np.sqrt(square) + 1e-12)
        out.steps = step
        if step % every == 0 or step == steps:
            _, val_loss, right, _ = _pass(b, w, beta)
            out.curve.append((step, loss, val_loss, right))
            if best is None or right > best + least_gain:
                best, stale, out.weights, out.best_step = right, 0, w, step
            else:
                stale += 1
                if stale >= patience:
                    out.stopped_early = True
                    break
    return out


def report(spark, fitted: Fitted) -> DataFrame:
    """step, train_loss, val_loss, val_accuracy, selected."""
    return spark.createDataFrame([(*map(float, c[1:]), c[0], c[0] == fitted.best_step) for c in fitted.curve], "train_loss double, val_loss double, val_accuracy double, step int, selected boolean").select("step", "train_loss", "val_loss", "val_accuracy", "selected")


# --- minibatches ------------------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Plan:
    """How a fit by minibatches goes: `accumulate` batches of batch_size pairs make a step, whose rate follows the schedule."""

    epochs: int = 1
    batch_size: int = 64
    accumulate: int = 1
    rate: float = 0.5
    schedule: str = "constant"
    warmup: int = 0
    beta: float = 0.1
    l2: float = 1e-3
    seed: int = 0
    #: Steps between two readings of the validation side, each of which is also a snapshot; readings without gain that end a fit.
    every: int = 10
    patience: int = 3
    least_gain: float = 0.0

    def check(self) -> None:
        if min(self.epochs, self.batch_size, self.accumulate, self.every, self.patience) < 1 or self.beta <= 0 or self.rate <= 0:
            raise ConfigError("epochs, batch_size, accumulate, every, patience, beta and rate must be positive")


@dataclass
class _State:
    step: int
    weights: np.ndarray
    square: np.ndarray
    best_weights: np.ndarray
    best_step: int
    best: float | None
    stale: int
    curve: list[tuple[int, float, float, float]]

    SCHEMA = "step int, weights array<double>, square array<double>, best_weights array<double>, best_step int, best double, stale int, curve array<array<double>>"

    def row(self) -> tuple:
        lists = (x.tolist() for x in (self.weights, self.square, self.best_weights))
        return (self.step, *lists, self.best_step, None if self.best is None else float(self.best), self.stale, [[float(v) for v in c] for c in self.curve])

    @classmethod
    def of(cls, r) -> _State:
        return cls(r.step, np.array(r.weights), np.array(r.square), np.array(r.best_weights), r.best_step, r.best, r.stale, [(int(c[0]), *c[1:]) for c in r.curve])


def _epoch(train: DataFrame, key: str, plan: Plan, epoch: int) -> DataFrame:
    """batch, step (from 0 in its epoch), at, delta, own: one permutation of the pairs, stored in the order of its steps."""
    from .tokens import epoch_batches

    rows = epoch_batches(train, key, plan.seed, epoch, plan.batch_size)
    rows = rows.select(F.col("batch").cast("long").alias("batch"), F.floor(F.col("batch") / plan.accumulate).cast("long").alias("step"), F.col(key).alias("at"), "delta", "own")
    return checkpointed(rows.repartitionByRange("step").sortWithinPartitions("step", "batch", "at"))


def _step(rows: DataFrame, step: int, w: np.ndarray, beta: float) -> tuple[np.ndarray, float]:
    """Mean gradient and loss of a step. A batch's pairs are summed in the order of their keys and batches in theirs, so it is the
    same to the last bit however the rows lie."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("at")
        delta = table.column("delta").combine_chunks().flatten().to_numpy().reshape(len(table), -1)
        g, loss, _, n = sums(delta, table.column("own").to_numpy(), w, beta)
        return pa.table({"batch": table.column("batch")[:1], "total": pa.array([np.r_[g, loss, n]], pa.list_(pa.float64()))})

    parts = rows.where(F.col("step") == step).groupBy("batch").applyInArrow(run, "batch long, total array<double>").collect()  # a row a batch
    total = np.sum([r.total for r in sorted(parts, key=lambda r: r.batch)], axis=0)
    return total[:-2] / total[-1], total[-2] / total[-1]


def fit_batches(train: DataFrame, val: DataFrame, key: str, plan: Plan | None = None, snapshots=None, stop_after: int | None = None) -> Fitted:
    """As fit(), by minibatches of one permutation of train for each epoch; keys (unique) name the pairs.

    With snapshots (see sources.snapshots) the state is stored at every reading, and a fit that finds one goes on from there: it ends
    with the very weights of a fit that was never stopped. stop_after ends a fit early, as a lost driver would.
    """
    from .tokens import schedule_factor

    plan = plan or Plan()
    plan.check()
    own = F.col("policy_chosen") - F.col("ref_chosen") - F.col("policy_rejected") + F.col("ref_rejected")
    own = own.cast("double").alias("own")
    a, b = (checkpointed(x.select(key, F.transform("delta", lambda v: v.cast("double")).alias("delta"), own)) for x in (train, val))
    n, first = a.count(), a.first()
    if first is None:
        raise DataError("there are no pairs to train on")
    each = -(-n // (plan.batch_size * plan.accumulate))
    total = each * plan.epochs
    spark = a.sparkSession
    factors = [r.f for r in spark.range(total).select(schedule_factor(F.col("id"), plan.schedule, plan.warmup, total).alias("f")).collect()]  # one a step
    zero = np.zeros(len(first.delta))
    stored = snapshots is not None and snapshots.steps()
    if stored:
        state = _State.of(snapshots.load("latest").first())
    else:
        _, loss, right, _ = _pass(b, zero, plan.beta)
        state = _State(0, zero, zero.copy(), zero, 0, None, 0, [(0, _pass(a, zero, plan.beta)[1], loss, right)])
    rows, epoch = None, -1
    while state.step < total and state.stale < plan.patience and (stop_after is None or state.step < stop_after):
        if state.step // each != epoch:
            epoch = state.step // each
            rows = _epoch(a, key, plan, epoch)
        g, loss = _step(rows, state.step % each, state.weights, plan.beta)
        g = g + plan.l2 * state.weights
        state.square = state.square + g * g
        state.weights = state.weights - plan.rate * factors[state.step] * g / (np.sqrt(state.square) + 1e-12)
        state.step += 1
        if state.step % plan.every == 0 or state.step == total:
            _, val_loss, right, _ = _pass(b, state.weights, plan.beta)
            state.curve.append((state.step, loss, val_loss, right))
            if state.best is None or right > state.best + plan.least_gain:
                state.best, state.stale, state.best_weights, state.best_step = right, 0, state.weights, state.step
            else:
                state.stale += 1
            if snapshots is not None:
                snapshots.save(spark.createDataFrame([state.row()], _State.SCHEMA).coalesce(1), state.step, float(right))
    return Fitted(state.best_weights, state.best_step, state.step, state.stale >= plan.patience and state.step < total, state.curve)
