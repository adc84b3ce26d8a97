"""Gaussian models of many series at once: EM keyed by series, state count and seed.

A fit is one row: the series' key, the state count, the seed and what its present
phase works with (moments of the series, then means by a few rounds of k-means, then
EM). A phase's step is the same for every series: `gather` sums over the rows of a
segment, the sums of all segments of a series are added, and `advance` makes the next
fit of them.

* A series within one segment needs nobody else's sums: its fits go on in the task
  that holds it, side by side, until each has ended.
* The fits of longer series advance together, one pass over the segments per step.
  A segment meets all fits of its series inside the task, so what is shuffled does not
  grow with the state counts and seeds. Sums are added by Spark per fit. Fits that have
  ended leave the next pass. What enters a segment comes from products of transfer
  matrices, multiplied up in bounded groups (`passes.links`).

Both ways run the same `gather` and `advance`, on segments of any length, so the
result does not depend on where a series is cut. A fit whose covariance is singular or
whose likelihood is not finite starts again with `diag`, and is `failed` if that breaks
down, too.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field, replace
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ordered import Ordering
from ..session import Shelf, park
from . import kernel, passes
from .gaussian import GaussianModel
from .runs import SEGMENT, cut_runs

#: Rounds of k-means before EM, and rows that are worked on side by side.
ROUNDS = 5
SIDE_BY_SIDE = 1 << 19
LIVE = ("moments", "means", "em")
STATE = "n_states int, seed int, covariance string, phase string, turn int, before double, values array<double>, log_likelihood double, n_rows bigint"


@dataclass(frozen=True)
class Rules:
    """When EM ends."""

    max_iter: int = 200
    tol: float = 1e-4


@dataclass(frozen=True)
class Fit:
    n: int
    seed: int
    covariance: str
    phase: str = "moments"
    turn: int = 0
    before: float | None = None
    values: np.ndarray = field(default_factory=lambda: np.empty(0))
    log_likelihood: float | None = None
    n_rows: int = 0

    @property
    def live(self) -> bool:
        return self.phase in LIVE

    def row(self) -> tuple:
        return (self.n, self.seed, self.covariance, self.phase, self.turn, self.before, self.values.tolist(), self.log_likelihood, self.n_rows)

    def model(self, d: int) -> GaussianModel:
        n = self.n
        start, trans, means, covs = np.split(self.values, np.cumsum([n, n * n, n * d]))
        return GaussianModel(start, trans.reshape(n, n), means.reshape(n, d), covs.reshape(n, d, d), self.covariance)

    def with_model(self, model: GaussianModel, **more) -> "Fit":
        return replace(self, phase="em", values=np.concatenate([x.ravel() for x in (model.start, model.trans, model.means, model.covs)]), **more)

    # what is summed before EM
    def gather(self, x: np.ndarray) -> np.ndarray:
        if self.phase == "moments":
            return np.concatenate([[len(x)], x.sum(axis=0), (x.T @ x).ravel()])
        _, centres, mid, wide, _ = self.centres(x.shape[1])
        if self.turn == 0:
            way, ends, _ = first_bins(x.shape[1], self.n, self.seed)
            bins = np.searchsorted(mid + wide * ends, x @ way, side="right")
        else:
            bins = ((x[:, None] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)
        of_bin = bins[None] == np.arange(self.n)[:, None]
        return np.concatenate([of_bin.sum(axis=1), (of_bin.astype(float) @ x).ravel()])

    def centres(self, d: int):
        variances, centres, rest = np.split(self.values, np.cumsum([d, self.n * d]))
        return variances, centres.reshape(self.n, d), rest[0], rest[1], rest[2]

    # what follows from the sums
    def advance(self, sums: np.ndarray, d: int, rules: Rules) -> "Fit":
        if self.phase == "moments":
            mean, second = sums[1 : 1 + d] / sums[0], sums[1 + d :].reshape(d, d) / sums[0]
            spread = second - np.outer(mean, mean)
            way, _, middles = first_bins(d, self.n, self.seed)
            wide = np.sqrt(max(way @ spread @ way, 0.0))
            centres = mean + np.outer(middles * wide, way)
            values = np.concatenate([np.maximum(np.diag(spread), 0.0), centres.ravel(), [mean @ way, wide, sums[0]]])
            return replace(self, phase="means", turn=0, values=values, n_rows=int(sums[0]))
        if self.phase == "means":
            variances, centres, mid, wide, total = self.centres(d)
            counts, totals = sums[: self.n], sums[self.n :].reshape(self.n, d)
            centres = np.where(counts[:, None] > 0, totals / np.maximum(counts, 1)[:, None], centres)
            if self.turn < ROUNDS:
                return replace(self, turn=self.turn + 1, values=np.concatenate([variances, centres.ravel(), [mid, wide, total]]))
            return self.with_model(start_model(centres, variances, self.covariance), turn=0, before=None)
        ll = float(sums[0])
        if not np.isfinite(ll):
            if self.covariance != "diag":
                return replace(self, covariance="diag", phase="moments", turn=0, before=None, values=np.empty(0))
            return replace(self, phase="failed", values=np.empty(0))
        if self.turn >= rules.max_iter or (self.before is not None and ll - self.before < rules.tol):
            return replace(self, phase="fitted", log_likelihood=ll)
        return self.with_model(self.model(d).updated(sums), turn=self.turn + 1, before=ll)


def first_bins(d: int, n: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A seeded direction, and where along it (in deviations) n bins end and have their middle."""
    way = np.random.default_rng(seed).normal(size=d)
    z = np.array([NormalDist().inv_cdf((i + 1) / (2 * n)) for i in range(2 * n - 1)])
    return way / np.linalg.norm(way), z[1::2], z[0::2]


def start_model(means: np.ndarray, variances: np.ndarray, covariance: str) -> GaussianModel:
    n = len(means)
    model = GaussianModel.initial(means, np.maximum(variances, 1e-3), covariance)
    stay = 0.7 if n > 1 else 1.0
    trans = np.full((n, n), (1.0 - stay) / max(1, n - 1))
    np.fill_diagonal(trans, stay)
    return replace(model, trans=trans)


# --- lanes: a segment together with one of its models --------------------------------


@dataclass
class Lane:
    """Rows of a segment, a model, and what enters and leaves there (None: the run's own ends)."""

    x: np.ndarray
    model: GaussianModel
    enter: np.ndarray | None = None
    leave: np.ndarray | None = None
    enter_state: int = -1
    exit_state: int = -1


def batches(lanes: Sequence[Lane]) -> Iterator[list[int]]:
    """Places of lanes with equal state counts, so many that their rows stay within `SIDE_BY_SIDE`."""
    by_size = defaultdict(list)
    for i, lane in enumerate(lanes):
        by_size[lane.model.n].append(i)
    for n, places in by_size.items():
        held, rows = [], 0
        for i in places:
            if held and (rows + len(lanes[i].x)) * n > SIDE_BY_SIDE:
                yield held
                held, rows = [], 0
            held.append(i)
            rows += len(lanes[i].x)
        if held:
            yield held


class Walk:
    """Forward–backward over lanes of equal state counts."""

    def __init__(self, lanes: Sequence[Lane]):
        lengths = np.array([len(lane.x) for lane in lanes])
        starts = np.cumsum(lengths) - lengths
        self.cut = kernel.Slice(starts, lengths)
        self.log_b = np.empty((lengths.sum(), lanes[0].model.n))
        self.offset, self.broken = np.zeros(lengths.sum()), np.zeros(len(lanes), bool)
        b = np.ones_like(self.log_b)
        for i, (lane, at, length) in enumerate(zip(lanes, starts, lengths, strict=True)):
            rows = slice(at, at + length)
            try:
                b[rows], self.log_b[rows], self.offset[rows] = lane.model.emission(lane.x)
            except np.linalg.LinAlgError:
                self.broken[i], self.log_b[rows] = True, 0.0
        self.trans = np.stack([lane.model.trans for lane in lanes])
        self.lanes, self.b = lanes, b

    def posterior(self):
        prior = np.stack([lane.model.start if lane.enter is None else lane.enter @ lane.model.trans for lane in self.lanes])
        leave = np.stack([np.ones(lane.model.n) if lane.leave is None else lane.leave for lane in self.lanes])
        return kernel.forward_backward(self.b, self.cut, prior, self.trans, leave, kernel.TINY)

    def paths(self) -> np.ndarray:
        log_start, log_trans = (np.stack([getattr(lane.model, c) for lane in self.lanes]) for c in ("log_start", "log_trans"))
        entered, left = (np.array([getattr(lane, c) for lane in self.lanes]) for c in ("enter_state", "exit_state"))
        return kernel.best_paths(self.log_b, self.cut, log_start, log_trans, entered, left)

    def transfers(self, opens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        start, log_start, log_trans = (np.stack([getattr(lane.model, c) for lane in self.lanes]) for c in ("start", "log_start", "log_trans"))
        m = kernel.transfer(self.b, self.cut, start, self.trans, opens)
        return m, kernel.best_transfer(self.log_b, self.cut, log_start, log_trans, opens)

    def rows(self, i: int) -> slice:
        return slice(self.cut.starts[i], self.cut.starts[i] + self.cut.lengths[i])


def em_sums(lanes: Sequence[Lane]) -> list[np.ndarray]:
    """Log-likelihood, start, moves and emission sums of every lane; not a number where its model broke down."""
    out: list = [None] * len(lanes)
    for places in batches(lanes):
        with np.errstate(all="ignore"):
            walk = Walk([lanes[i] for i in places])
            gamma, alpha, weighted, scale = walk.posterior()
            for k, i in enumerate(places):
                lane, at = lanes[i], walk.rows(k)
                first = gamma[at][0] if lane.enter is None else np.zeros(lane.model.n)
                ll = float((np.log(scale[at]) + walk.offset[at]).sum()) if not walk.broken[k] else np.nan
                moves = kernel.moves_of_segment(alpha[at], weighted[at], lane.model.trans, lane.enter)
                out[i] = np.concatenate([[ll], first, moves.ravel(), lane.model.gather(lane.x, gamma[at])])
    return out


def settle(work: Sequence[tuple[np.ndarray, Fit]], rules: Rules) -> list[Fit]:
    """Fits of whole series, side by side, each to its end."""
    fits = [fit for _, fit in work]
    live = list(range(len(work)))
    while live:
        em = [i for i in live if fits[i].phase == "em"]
        sums = dict(zip(em, em_sums([Lane(work[i][0], fits[i].model(work[i][0].shape[1])) for i in em]), strict=True))
        for i in live:
            x = work[i][0]
            fits[i] = fits[i].advance(sums[i] if i in sums else fits[i].gather(x), x.shape[1], rules)
        live = [i for i in live if fits[i].live]
    return fits


# --- the Spark jobs ------------------------------------------------------------------


@dataclass(frozen=True)
class Series:
    """Segments of many series: keys, `seg`, `rows`, `x`, `opens`, `closes`."""

    table: DataFrame
    keys: tuple[str, ...]
    width: int
    last_seg: int

    @property
    def whole(self) -> DataFrame:
        return self.table.where("opens AND closes")

    @property
    def parts(self) -> DataFrame:
        return self.table.where("NOT (opens AND closes)")

    @property
    def key_schema(self) -> str:
        return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in self.table.schema if f.name in self.keys)


def hold(rows: DataFrame, keys: tuple[str, ...], order: str, features: Sequence[str], length: int = SEGMENT) -> Series:
    """Segments of at most `length` rows, written once: the only time that the values are shuffled by series."""
    cut = cut_runs(rows.withColumn("_run", F.lit("one")), Ordering(keys, order).inspect(rows), F.array(*features), "_run", length, vector=True)
    names = [*keys, "seg", "rows", "x", "opens", "closes"]
    # series are dealt out, since the work on a row is large beside its bytes
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    table = park(cut.select(*names).repartition(tasks, *keys, "seg"), "series")
    last = table.where("NOT (opens AND closes)").agg(F.max("seg")).first()[0]
    return Series(table, keys, len(features), int(last or 0))


def values(batch: pa.RecordBatch, d: int) -> list[np.ndarray]:
    column = batch.column("x")
    flat, edges = column.flatten().to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    edges = edges - edges[0]
    return [flat[a:b].reshape(-1, d) for a, b in zip(edges[:-1], edges[1:], strict=True)]


def fit_of(row: dict) -> Fit:
    return Fit(
        row["n_states"], row["seed"], row["covariance"], row["phase"], row["turn"], row["before"], np.array(row["values"], float), row["log_likelihood"],
        row["n_rows"],
    )


def emit(columns: dict[str, list], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)


def mapped(df: DataFrame, schema: str, work: Callable[[pa.RecordBatch], Iterator[tuple]]) -> DataFrame:
    """`work` makes rows of `schema` from every batch."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    kinds = to_arrow_schema(_parse_datatype_string(schema))

    def run(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in given:
            rows = list(work(batch))
            if rows:
                yield emit(dict(zip(kinds.names, map(list, zip(*rows, strict=True)), strict=True)), kinds)

    return df.mapInArrow(run, schema)


def key_rows(batch: pa.RecordBatch, keys: Sequence[str]) -> list[tuple]:
    return list(zip(*[batch.column(k).to_pylist() for k in keys], strict=True))


def fitted(series: Series, candidates: Sequence[tuple[int, int]], covariance: str, rules: Rules) -> DataFrame:
    """One row per series and candidate (state count, seed): `STATE` of the ended fit."""
    d, keys = series.width, series.keys
    schema = f"{series.key_schema}, {STATE}"
    starts = [Fit(n, seed, covariance) for n, seed in candidates]

    def whole(batch: pa.RecordBatch) -> Iterator[tuple]:
        held = values(batch, d)
        work = [(x, fit) for x in held for fit in starts]
        ended = iter(settle(work, rules))
        for key in key_rows(batch, keys):
            for _ in starts:
                yield (*key, *next(ended).row())

    spark = series.table.sparkSession
    done = [park(mapped(series.whole, schema, whole), "fits")]
    if series.last_seg:
        rows = F.array(*[F.struct(*[F.lit(v).alias(c) for c, v in zip(("n_states", "seed", "covariance"), (f.n, f.seed, f.covariance), strict=True)]) for f in starts])
        first = series.parts.select(*keys).distinct().withColumn("fit", F.explode(rows)).select(
            *keys, "fit.*", F.lit("moments").alias("phase"), F.lit(0).alias("turn"), F.lit(None).cast("double").alias("before"),
            F.array().cast("array<double>").alias("values"), F.lit(None).cast("double").alias("log_likelihood"), F.lit(0).cast("bigint").alias("n_rows"),
        )
        with Shelf(spark) as shelf:
            state = shelf.put(first, "fits-live")
            live = F.col("phase").isin(*LIVE)
            ended = []
            while not state.where(live).isEmpty():
                moved = shelf.put(stepped(series, state.where(live), rules), "fits-live")
                if not moved.where(~live).isEmpty():
                    ended.append(park(moved.where(~live), "fits"))
                shelf.drop(state)
                state = moved
        done += ended
    return union(done)


def union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for more in tables[1:]:
        out = out.unionByName(more)
    return out


def with_fits(segments: DataFrame, state: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Every segment with the list of its series' fits: `fits`."""
    # as many fits as candidates were asked for, whatever the length of a series
    listed = state.groupBy(*keys).agg(F.collect_list(F.struct(*[c for c in state.columns if c not in keys])).alias("fits"))
    return segments.join(listed, list(keys))


def linked(series: Series, state: DataFrame, names: Sequence[str]) -> DataFrame:
    """`links` of every part: what enters and leaves it, for every fit; `names` are the columns that tell fits apart."""
    d, keys = series.width, series.keys
    kinds = {f.name: f.dataType.simpleString() for f in state.schema}
    schema = f"{series.key_schema}, {', '.join(f'`{c}` {kinds[c]}' for c in names)}, seg bigint, m array<double>, d array<double>"

    def transfers(batch: pa.RecordBatch) -> Iterator[tuple]:
        held, fits = values(batch, d), batch.column("fits").to_pylist()
        of = [(i, row) for i, rows in enumerate(fits) for row in rows]
        lanes = [Lane(held[i], fit_of(row).model(d)) for i, row in of]
        opens, segs, key = batch.column("opens").to_numpy(zero_copy_only=False), batch.column("seg").to_pylist(), key_rows(batch, keys)
        for places in batches(lanes):
            with np.errstate(all="ignore"):
                m, best = Walk([lanes[p] for p in places]).transfers(opens[[of[p][0] for p in places]])
            for k, p in enumerate(places):
                i, row = of[p]
                yield (*key[i], *[row[c] for c in names], segs[i], m[k].ravel().tolist(), best[k].ravel().tolist())

    made = mapped(with_fits(series.parts, state, keys).select(*keys, "seg", "x", "opens", "fits"), schema, transfers)
    links = passes.links(made, (*keys, *names), series.last_seg)
    entered = F.struct(*names, "enter", "leave", "enter_state", "exit_state")
    return links.groupBy(*keys, "seg").agg(F.collect_list(entered).alias("links"))  # one entry per fit


def lanes_of(batch: pa.RecordBatch, d: int, names: Sequence[str]) -> tuple[list[tuple[int, dict]], list[Lane]]:
    """Lanes of all EM fits of a batch, with the place of their segment and their row."""
    held, fits, opens = values(batch, d), batch.column("fits").to_pylist(), batch.column("opens").to_pylist()
    links = batch.column("links").to_pylist() if "links" in batch.schema.names else [None] * batch.num_rows
    of, lanes = [], []
    for i, rows in enumerate(fits):
        ends = {tuple(x[c] for c in names): x for x in links[i] or ()}
        for row in rows:
            if row["phase"] not in ("em", "fitted"):
                continue
            end = ends.get(tuple(row[c] for c in names))
            of.append((i, row))
            lane = Lane(held[i], fit_of(row).model(d))
            if end:
                lane.enter, lane.leave = None if opens[i] else np.array(end["enter"], float), np.array(end["leave"], float)
                lane.enter_state, lane.exit_state = -1 if opens[i] else end["enter_state"], end["exit_state"]
            lanes.append(lane)
    return of, lanes


NAMES = ("n_states", "seed")


def stepped(series: Series, state: DataFrame, rules: Rules) -> DataFrame:
    """All given fits of longer series, one step further."""
    d, keys = series.width, series.keys
    named = f"{series.key_schema}, n_states int, seed int"

    def sums(batch: pa.RecordBatch) -> Iterator[tuple]:
        key = key_rows(batch, keys)
        of, lanes = lanes_of(batch, d, NAMES)
        found = [(i, row, total) for (i, row), total in zip(of, em_sums(lanes), strict=True)]
        held = values(batch, d)
        for i, rows in enumerate(batch.column("fits").to_pylist()):
            found += [(i, row, fit_of(row).gather(held[i])) for row in rows if row["phase"] in ("moments", "means")]
        added: dict = {}
        for i, row, total in found:  # a task adds up what it can
            name = (*key[i], row["n_states"], row["seed"])
            added[name] = added[name] + total if name in added else total
        for name, total in added.items():
            yield (*name, total.tolist())

    met = with_fits(series.parts, state, keys).select(*keys, "seg", "x", "opens", "fits")
    em = state.where("phase = 'em'")
    if not em.isEmpty():
        met = met.join(linked(series, em, NAMES), [*keys, "seg"], "left")
    made = mapped(met, f"{named}, sums array<double>", sums)
    placed = made.select(*keys, *NAMES, F.posexplode("sums").alias("place", "value")).groupBy(*keys, *NAMES, "place").agg(F.sum("value").alias("value"))
    listed = F.array_sort(F.collect_list(F.struct("place", "value")))  # as many as a model has numbers
    totals = placed.groupBy(*keys, *NAMES).agg(F.transform(listed, lambda x: x["value"]).alias("sums"))

    def next_fits(batch: pa.RecordBatch) -> Iterator[tuple]:
        for row in batch.to_pylist():
            with np.errstate(all="ignore"):
                yield (*[row[k] for k in keys], *fit_of(row).advance(np.array(row["sums"], float), d, rules).row())

    return mapped(state.join(totals, [*keys, *NAMES]), f"{series.key_schema}, {STATE}", next_fits)


def scores(series: Series, state: DataFrame, names: Sequence[str]) -> DataFrame:
    """Log-likelihood of every series under the fits of its key; `names` are the columns that tell fits apart."""
    d, keys = series.width, series.keys
    kinds = {f.name: f.dataType.simpleString() for f in state.schema}
    schema = f"{series.key_schema}, {', '.join(f'`{c}` {kinds[c]}' for c in names)}, log_likelihood double"

    def work(batch: pa.RecordBatch) -> Iterator[tuple]:
        key = key_rows(batch, keys)
        of, lanes = lanes_of(batch, d, names)
        for (i, row), total in zip(of, em_sums(lanes), strict=True):
            yield (*key[i], *[row[c] for c in names], float(total[0]))

    ready = state.where("phase = 'fitted'")
    columns = [*keys, "seg", "x", "opens", "fits"]
    made = mapped(with_fits(series.whole, ready, keys).select(*columns), schema, work)
    if series.last_seg:
        met = with_fits(series.parts, ready, keys).select(*columns).join(linked(series, ready, names), [*keys, "seg"])
        made = made.unionByName(mapped(met, schema, work))
    return made.groupBy(*keys, *names).agg(F.sum("log_likelihood").alias("log_likelihood"))


def decoded(series: Series, state: DataFrame, n: int, order: str) -> DataFrame:
    """Keys, the order column, `hidden_state` and posteriors of every row; null where a series' fit failed.

    `state` holds one fit per series, all of `n` states.
    """
    d, keys = series.width, series.keys
    posteriors = [f"p_state_{i}" for i in range(n)]
    schema = f"{series.key_schema}, `{order}` bigint, hidden_state int, " + ", ".join(f"{p} double" for p in posteriors)

    def work(batch: pa.RecordBatch) -> Iterator[tuple]:
        key, rows = key_rows(batch, keys), batch.column("rows").to_pylist()
        of, lanes = lanes_of(batch, d, NAMES)
        for places in batches(lanes):
            with np.errstate(all="ignore"):
                walk = Walk([lanes[p] for p in places])
                gamma, paths = walk.posterior()[0], walk.paths()
            for k, p in enumerate(places):
                i, at = of[p][0], walk.rows(k)
                yield from ((*key[i], row, int(path), *map(float, own)) for row, path, own in zip(rows[i], paths[at], gamma[at], strict=True))
        for i in set(range(batch.num_rows)) - {i for i, _ in of}:
            yield from ((*key[i], row, None, *[None] * n) for row in rows[i])

    columns = [*keys, "seg", "rows", "x", "opens", "fits"]
    made = mapped(with_fits(series.whole, state, keys).select(*columns), schema, work)
    if series.last_seg:
        met = with_fits(series.parts, state, keys).select(*columns)
        met = met.join(linked(series, state.where("phase = 'fitted'"), NAMES), [*keys, "seg"], "left")
        made = made.unionByName(mapped(met, schema, work))
    return made
