"""Hidden Markov model over observed classes, trained by Spark E-steps."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import lexicon as lx
from .kernel import EPS
from .passes import expected_counts
from .runs import Segments

SMOOTHING = 1e-3


def normal_rows(m: np.ndarray) -> np.ndarray:
    """Rows to sum one; an empty row becomes uniform."""
    sums = m.sum(axis=-1, keepdims=True)
    return np.where(sums > 0, m / np.where(sums > 0, sums, 1.0), 1.0 / m.shape[-1])


@dataclass(frozen=True)
class Training:
    """`log_likelihood` is the one before the last update of the parameters."""

    log_likelihood: float
    converged: bool
    iterations: int
    last_delta: float | None


@dataclass(frozen=True)
class DiscreteModel:
    classes: list[str]
    start: np.ndarray
    trans: np.ndarray
    emit: np.ndarray
    names: dict[int, str] = field(default_factory=dict)
    topology: str = "left_to_right"
    min_forward: float = 0.05
    training: Training | None = None
    width: int = 1

    @classmethod
    def initial(cls, n: int = 3, classes: list[str] | None = None, topology: str = "left_to_right",
                min_forward: float = 0.05) -> "DiscreteModel":
        """Start and moves by topology; emissions lean to the classes each state stands for."""
        classes = list(classes or lx.OBSERVED_CLASSES)
        forward = topology == "left_to_right"
        start = np.eye(n)[0] if forward else np.full(n, 1.0 / n)
        trans = normal_rows(np.triu(np.ones((n, n))) if forward else np.ones((n, n)))
        emit = np.ones((n, len(classes)))
        for state, bumps in lx.EMISSION_BUMPS:
            for name, extra in bumps.items():
                if state < n and name in classes:
                    emit[state, classes.index(name)] += extra
        names = {i: f"state_{i}" for i in range(n)}
        return cls(classes, start, trans, normal_rows(emit), names, topology, min_forward)

    @property
    def n(self) -> int:
        return len(self.start)

    @property
    def log_start(self) -> np.ndarray:
        return np.log(np.maximum(self.start, EPS))

    @property
    def log_trans(self) -> np.ndarray:
        return np.log(np.maximum(self.trans, EPS))

    # what the passes need
    @property
    def stats_size(self) -> int:
        return 1 + self.n + self.n**2 + self.n * len(self.classes)

    def emission(self, values: np.ndarray):
        at = values[:, 0].astype(np.int64)
        return self.emit.T[at], np.log(np.maximum(self.emit, EPS)).T[at], 0.0

    def gather(self, values: np.ndarray, gamma: np.ndarray) -> np.ndarray:
        at = values[:, 0].astype(np.int64)
        return np.concatenate([np.bincount(at, weights=g, minlength=len(self.classes)) for g in gamma.T])

    # training
    def enforce(self, trans: np.ndarray) -> np.ndarray:
        """Forbid moves back, and keep a floor under each next-state count."""
        if self.topology == "left_to_right":
            trans = np.triu(trans)
            for i in range(self.n - 1):
                trans[i, i + 1] = max(trans[i, i + 1], self.min_forward)
        return normal_rows(trans)

    def updated(self, stats: np.ndarray) -> "DiscreteModel":
        n = self.n
        start, moves, emits = stats[1:1 + n], stats[1 + n:1 + n + n * n], stats[1 + n + n * n:]
        return replace(
            self,
            start=normal_rows(start + SMOOTHING),
            trans=self.enforce(moves.reshape(n, n) + SMOOTHING),
            emit=normal_rows(emits.reshape(n, -1) + SMOOTHING),
        )

    def fit(self, seg: Segments, max_iter: int = 300, tol: float = 1e-4) -> "DiscreteModel":
        """EM; each iteration is one Spark job over the held segments."""
        model, before, delta, done = self, None, None, False
        steps, ll = 0, float("-inf")
        for steps in range(1, max(1, max_iter) + 1):
            stats = expected_counts(seg, model)
            ll = float(stats[0])
            model = model.updated(stats)
            if before is not None:
                delta = ll - before
                if abs(delta) < tol:
                    done = True
                    break
            before = ll
        return replace(model, training=Training(ll, done, steps, delta))

    def reordered(self, order: list[int], names: dict[int, str]) -> "DiscreteModel":
        if sorted(order) != list(range(self.n)):
            raise ValueError(f"not a state order: {order}")
        at = np.asarray(order)
        return replace(self, start=self.start[at], trans=self.trans[at][:, at], emit=self.emit[at], names=names)


def class_number(cls: Column, classes: list[str]) -> Column:
    """Class to its place in the list; unseen and null count as unknown."""
    spare = classes.index("unknown") if "unknown" in classes else 0
    pairs = [F.lit(x) for i, c in enumerate(classes) for x in (c, i)]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), F.coalesce(cls, F.lit("unknown"))), F.lit(spare)).cast("int")
