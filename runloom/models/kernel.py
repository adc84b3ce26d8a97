"""Numpy steps that run inside Spark tasks, on bounded slices of segments.

A segment is a bounded piece of a run. Rows of all segments of a slice lie one
after another; `Slice` knows where each begins. Steps loop over the position in
the segment and handle all segments of the slice at once.

A segment in the middle of a long run gets the state distribution that enters
it, so that its posteriors equal those of one pass over the whole run.

Starts and transitions are those of one model, or have one more axis in front with
an entry per segment: then each segment has a model of its own, and a segment that
several models share (seeds, say) is listed once for each of them.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

EPS = 1e-12
#: Least sum that is divided by where emissions have no floor of their own.
TINY = 1e-300


@dataclass
class Slice:
    starts: np.ndarray
    lengths: np.ndarray

    def __post_init__(self) -> None:
        self.by_length = np.argsort(-self.lengths, kind="stable")
        sorted_lengths = self.lengths[self.by_length]
        longest = int(sorted_lengths[0]) if len(sorted_lengths) else 0
        # how many segments still have a row at position t
        self.alive = np.searchsorted(-sorted_lengths, -np.arange(longest), side="left")
        self.first = self.starts[self.by_length]

    @property
    def lasts(self) -> np.ndarray:
        return self.starts + self.lengths - 1

    def rows(self, t: int) -> np.ndarray:
        return self.first[: self.alive[t]] + t

    def segments(self, t: int) -> np.ndarray:
        return self.by_length[: self.alive[t]]


def own(table: np.ndarray, axes: int, seg: np.ndarray) -> np.ndarray:
    """The entries of these segments, where a table with `axes` axes per model has one per segment."""
    return table if table.ndim == axes else table[seg]


def ahead_of(v: np.ndarray, trans: np.ndarray, seg: np.ndarray) -> np.ndarray:
    return v @ trans if trans.ndim == 2 else (v[:, None, :] @ trans[seg])[:, 0]


def before(v: np.ndarray, trans: np.ndarray, seg: np.ndarray) -> np.ndarray:
    return v @ trans.T if trans.ndim == 2 else (trans[seg] @ v[:, :, None])[:, :, 0]


def forward_backward(b: np.ndarray, cut: Slice, prior: np.ndarray, trans: np.ndarray, leave: np.ndarray, floor: float = EPS):
    """Scaled forward–backward. `prior` is the state distribution before the
    first emission of each segment, `leave` the backward weight after its last.

    Returns posteriors, the forward vectors, b·beta, and the scale of each row.
    """
    total, n = b.shape
    alpha, beta, scale = np.empty((total, n)), np.empty((total, n)), np.empty(total)
    steps = len(cut.alive)
    for t in range(steps):
        rows = cut.rows(t)
        ahead = prior[cut.segments(0)] if t == 0 else ahead_of(alpha[rows - 1], trans, cut.segments(t))
        joint = ahead * b[rows]
        size = np.maximum(joint.sum(axis=1), floor)
        alpha[rows], scale[rows] = joint / size[:, None], size
    beta[cut.lasts] = leave
    for t in range(steps - 2, -1, -1):
        rows = cut.rows(t + 1)
        beta[rows - 1] = before(b[rows] * beta[rows], trans, cut.segments(t + 1)) / scale[rows][:, None]
    gamma = alpha * beta
    gamma /= np.maximum(gamma.sum(axis=1, keepdims=True), floor)
    return gamma, alpha, b * beta, scale


def expected_moves(alpha, weighted, cut: Slice, trans, enter, continues, mult) -> np.ndarray:
    """Expected transition counts, each step normalized, including the step into
    a segment that continues a run."""
    inside = np.ones(len(alpha), dtype=bool)
    inside[cut.starts] = False
    after = np.flatnonzero(inside)
    per_row = np.repeat(mult, cut.lengths)
    pairs = [(alpha[after - 1], weighted[after], per_row[after])]
    if continues.any():
        pairs.append((enter[continues], weighted[cut.starts[continues]], mult[continues]))
    out = np.zeros_like(trans)
    for u, v, weight in pairs:
        size = np.maximum(((u @ trans) * v).sum(axis=1), EPS)
        out += trans * ((u * (weight / size)[:, None]).T @ v)
    return out


def moves_of_segment(alpha, weighted, trans, enter) -> np.ndarray:
    """Expected transition counts of one segment, with the step into it where `enter` is given."""
    u = alpha[:-1] if enter is None else np.concatenate([enter[None], alpha[:-1]])
    v = weighted[1:] if enter is None else weighted
    size = np.maximum(((u @ trans) * v).sum(axis=1), TINY)
    return trans * ((u / size[:, None]).T @ v)


def best_paths(log_b, cut: Slice, log_start, log_trans, enter_state, exit_state) -> np.ndarray:
    """Most likely state per row. A segment inside a run has its entering and
    leaving states fixed (≥ 0); otherwise -1. Ties go to the lowest state."""
    total, n = log_b.shape
    delta, back = np.empty((total, n)), np.zeros((total, n), dtype=np.int16)
    steps = len(cut.alive)
    for t in range(steps):
        rows = cut.rows(t)
        if t == 0:
            entering = enter_state[cut.segments(0)]
            seg = cut.segments(0)
            entered = log_trans[np.maximum(entering, 0)] if log_trans.ndim == 2 else log_trans[seg, np.maximum(entering, 0)]
            delta[rows] = np.where((entering >= 0)[:, None], entered, own(log_start, 1, seg)) + log_b[rows]
        else:
            scores = delta[rows - 1][:, :, None] + own(log_trans, 2, cut.segments(t))
            back[rows] = scores.argmax(axis=1)
            delta[rows] = scores.max(axis=1) + log_b[rows]
    path = np.empty(total, dtype=np.int32)
    path[cut.lasts] = np.where(exit_state >= 0, exit_state, delta[cut.lasts].argmax(axis=1))
    for t in range(steps - 2, -1, -1):
        rows = cut.rows(t + 1)
        path[rows - 1] = back[rows, path[rows]]
    return path


def transfer(b, cut: Slice, start, trans, opens) -> np.ndarray:
    """Per segment the matrix that carries a forward vector across it, up to scale.

    The first segment of a run ignores what enters it: all its rows are equal.
    """
    n = b.shape[1]
    m = np.empty((len(cut.starts), n, n))
    for t in range(len(cut.alive)):
        rows, seg = cut.rows(t), cut.segments(t)
        if t == 0:
            first = np.broadcast_to(own(start, 1, seg)[..., None, :], (len(seg), n, n))
            m[seg] = np.where(opens[seg][:, None, None], first, own(trans, 2, seg)) * b[rows][:, None, :]
        else:
            m[seg] = (m[seg] @ own(trans, 2, seg)) * b[rows][:, None, :]
        m[seg] /= np.maximum(m[seg].sum(axis=(1, 2), keepdims=True), 1e-300)
    return m


def best_transfer(log_b, cut: Slice, log_start, log_trans, opens) -> np.ndarray:
    """The same for best-path scores: entry (i, j) is the best score from i to j."""
    n = log_b.shape[1]
    d = np.empty((len(cut.starts), n, n))
    for t in range(len(cut.alive)):
        rows, seg = cut.rows(t), cut.segments(t)
        if t == 0:
            first = np.broadcast_to(own(log_start, 1, seg)[..., None, :], (len(seg), n, n))
            d[seg] = np.where(opens[seg][:, None, None], first, own(log_trans, 2, seg)) + log_b[rows][:, None, :]
        else:
            d[seg] = (d[seg][:, :, :, None] + own(log_trans, 2, seg)[..., None, :, :]).max(axis=2) + log_b[rows][:, None, :]
    return d


def unit(v: np.ndarray) -> np.ndarray:
    return v / max(v.sum(), 1e-300)


def multiply(ms: np.ndarray) -> np.ndarray:
    out = ms[0]
    for m in ms[1:]:
        out = unit(out @ m)
    return unit(out)


def multiply_best(ds: np.ndarray) -> np.ndarray:
    out = ds[0]
    for d in ds[1:]:
        out = (out[:, :, None] + d[None]).max(axis=1)
    return out


def link(ms, ds, enter, leave, score, exit_state):
    """Walk the segments of one group: what enters and leaves each of them."""
    count, n, _ = ms.shape
    enters, leaves = np.empty((count, n)), np.empty((count, n))
    v = enter
    for k in range(count):
        enters[k], v = v, unit(v @ ms[k])
    w = leave
    for k in range(count - 1, -1, -1):
        leaves[k], w = w, unit(ms[k] @ w)
    scores = np.empty((count, n))
    s = score
    for k in range(count):
        scores[k] = s
        s = (s[:, None] + ds[k]).max(axis=0)
        s = s - s.max()
    entry, leaving = np.empty(count, dtype=np.int64), np.empty(count, dtype=np.int64)
    state = int(s.argmax()) if exit_state < 0 else int(exit_state)
    for k in range(count - 1, -1, -1):
        leaving[k] = state
        state = int((scores[k] + ds[k][:, state]).argmax())
        entry[k] = state
    return enters, leaves, scores, entry, leaving
