import itertools
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from runloom.models import fits, passes, regimes
from runloom.models import runs as run_cuts
from runloom.models.discrete import DiscreteModel, class_number, normal_rows
from runloom.models.gaussian import GaussianModel, bidiagonal
from runloom.models.runs import segments
from runloom.models.semantics import assignment_quality, block_profiles, name_states
from runloom.operators.features import Scaler
from runloom.operators.ordered import Ordering
from runloom.operators.selection import mean_of_top, nth_largest
from runloom.sources import params

ORDER = Ordering(("k",), "source_row_index")


@pytest.fixture(scope="module")
def observed(spark):
    rng = np.random.default_rng(3)
    rows, at = [], 0
    for r in range(30):
        for _ in range(70 if r == 0 else int(rng.integers(1, 6))):
            rows.append(("a" if r < 12 else "b", at, f"r{r}", int(rng.integers(0, 4))))
            at += 1
    return rows, spark.createDataFrame(rows, "k string, source_row_index long, sequence_id string, o int").cache()


@pytest.fixture(scope="module")
def model():
    rng = np.random.default_rng(1)
    base = DiscreteModel.initial(3, list("wxyz"), "ergodic")
    return replace(base, start=np.array([0.5, 0.3, 0.2]), trans=normal_rows(rng.random((3, 3))), emit=normal_rows(rng.random((3, 4))))


def by_enumeration(model, obs):
    total, best, best_p, post = 0.0, None, -1.0, np.zeros((len(obs), model.n))
    for path in itertools.product(range(model.n), repeat=len(obs)):
        p = model.start[path[0]] * model.emit[path[0], obs[0]]
        for t in range(1, len(obs)):
            p *= model.trans[path[t - 1], path[t]] * model.emit[path[t], obs[t]]
        total += p
        post[np.arange(len(obs)), path] += p
        if p > best_p:
            best, best_p = path, p
    return np.log(total), list(best), post / total


def test_decoding_equals_enumeration(observed, model):
    rows, df = observed
    out = passes.decode(segments(df, ORDER, F.col("o"), passes=False), model).toPandas().set_index("source_row_index")
    runs = {}
    for _, at, run, o in rows:
        runs.setdefault(run, []).append((at, o))
    runs.pop("r0")  # too long to enumerate; the next test covers it
    for cells in runs.values():
        ll, best, post = by_enumeration(model, [o for _, o in cells])
        at = [i for i, _ in cells]
        assert list(out.loc[at, "hidden_state"]) == best
        assert np.allclose(out.loc[at, [f"p_state_{i}" for i in range(3)]], post)
        assert out.loc[at, "log_scale"].sum() == pytest.approx(ll)


def test_long_runs_in_pieces_equal_whole_runs(observed, model, monkeypatch):
    _, df = observed
    whole = segments(df, ORDER, F.col("o"))
    want, counts = passes.decode(whole, model).toPandas().sort_values("source_row_index"), passes.expected_counts(whole, model)
    for fan in (4096, 3):  # with three per group the links are built in levels
        monkeypatch.setattr(passes, "FAN", fan)
        cut = segments(df, ORDER, F.col("o"), length=4)
        assert cut.has_parts
        got = passes.decode(cut, model).toPandas().sort_values("source_row_index")
        for c in [c for c in want.columns if c != "k"]:
            assert np.allclose(want[c].astype(float), got[c].astype(float)), c
        assert np.allclose(passes.expected_counts(cut, model), counts)


def test_partitioning_does_not_matter(observed, model):
    _, df = observed
    a = passes.expected_counts(segments(df.repartition(7), ORDER, F.col("o")), model)
    b = passes.expected_counts(segments(df.coalesce(1), ORDER, F.col("o"), distinct=True), model)
    assert np.allclose(a, b)


def test_training_raises_the_likelihood(observed, model):
    _, df = observed
    seg = segments(df, ORDER, F.col("o"), distinct=True)
    likelihoods = [model.fit(seg, n).training.log_likelihood for n in (1, 3, 6)]
    assert likelihoods[0] < likelihoods[1] < likelihoods[2]
    trained = model.fit(seg, 4)
    assert np.allclose(trained.trans.sum(axis=1), 1) and trained.training.iterations == 4


def test_left_to_right_keeps_its_shape(observed):
    _, df = observed
    seg = segments(df, ORDER, F.col("o"), distinct=True)
    trained = DiscreteModel.initial(3, list("wxyz")).fit(seg, 5)
    assert np.allclose(np.tril(trained.trans, -1), 0) and np.allclose(trained.trans.sum(axis=1), 1)


def test_initial_emissions():
    m = DiscreteModel.initial(3)
    assert m.emit[0].argmax() == m.classes.index("no_score") and m.start.tolist() == [1, 0, 0]
    assert np.allclose(m.trans[1], [0, 0.5, 0.5])


def test_unseen_class_is_unknown(spark):
    df = spark.createDataFrame([("hold",), ("weird",), (None,)], "c string")
    assert [r[0] for r in df.select(class_number(F.col("c"), ["hold", "unknown"])).collect()] == [0, 1, 1]


def test_save_and_load(spark, model, tmp_path):
    params.save_model(spark, model, str(tmp_path / "d"), "m", {"assigned": {"S1": 2}})
    back, extra = params.load_model(spark, str(tmp_path / "d"))
    assert np.array_equal(back.emit, model.emit) and extra == {"assigned": {"S1": 2}} and back.names == model.names
    g = GaussianModel.initial(np.zeros((2, 2)), np.ones(2), "full", scaler=Scaler(["a", "b"], [0.0, 1.0], [1.0, 2.0], [1.0, 1.0]))
    params.save_model(spark, g, str(tmp_path / "g"), "g")
    back, _ = params.load_model(spark, str(tmp_path / "g"))
    assert np.array_equal(back.covs, g.covs) and back.scaler == g.scaler


def profiles_of(spark, means):
    columns = ["maneuver_right_code", "maneuver_left_code", "kfv_code", "vup_code"]
    rows = [(state, *(row.get(c) for c in columns)) for state, row in means.items()]
    table = spark.createDataFrame(rows, "hidden_state int, " + ", ".join(f"{c} double" for c in columns))
    return [r.asDict() for r in block_profiles(table).collect()]


def test_naming_of_permuted_states(spark):
    means = {
        0: {"maneuver_right_code": 0.1, "maneuver_left_code": 0.1, "kfv_code": 3.0, "vup_code": 0.1},
        1: {"maneuver_right_code": 0.1, "maneuver_left_code": 0.0, "kfv_code": 0.1, "vup_code": 3.0},
        2: {"maneuver_right_code": 3.0, "maneuver_left_code": 2.0, "kfv_code": 0.1, "vup_code": 0.1},
    }
    found = name_states(profiles_of(spark, means), 3)
    assert found.order == [2, 0, 1] and found.names == {0: "S1", 1: "S2", 2: "S3"} and found.assigned == {"S1": 0, "S2": 1, "S3": 2}
    assert assignment_quality(found.assigned, found.confidence)[0] == "full"
    weak = name_states(profiles_of(spark, {**means, 1: {"kfv_code": 0.01, "vup_code": 0.01}}), 3)
    assert weak.names[2] == "state_1" and "S3" not in weak.assigned
    assert assignment_quality({"S1": 0}, {"S1": 0.2})[0] == "failed"


def test_reordering_moves_all_parameters(model):
    moved = model.reordered([2, 0, 1], {0: "S1", 1: "S2", 2: "S3"})
    assert moved.trans[0, 1] == model.trans[2, 0] and np.array_equal(moved.emit[0], model.emit[2])
    with pytest.raises(ValueError):
        model.reordered([0, 0, 1], {})


# --- Gaussian -------------------------------------------------------------------------


@pytest.fixture(scope="module")
def blobs(spark):
    rng = np.random.default_rng(0)
    centres = np.array([[0.0, 0.0], [4.0, 1.0], [9.0, -3.0]])
    x = np.concatenate([rng.normal(c, 0.4, (15, 2)) for c in centres])
    rows = [("a", i, "one", float(a), float(b)) for i, (a, b) in enumerate(x)]
    return x, spark.createDataFrame(rows, "k string, source_row_index long, sequence_id string, a double, b double").cache()


@pytest.mark.parametrize("covariance", ["full", "diag", "tied", "spherical"])
def test_separable_blocks(blobs, covariance):
    x, df = blobs
    seg = segments(df, ORDER, F.array("a", "b"), vector=True, length=8)  # one long run in six pieces
    start = GaussianModel.initial(x[[2, 20, 40]], x.var(axis=0), covariance, "left_to_right")
    fitted = start.fit(seg, 30)
    states = passes.decode(seg, fitted).orderBy("source_row_index").toPandas()
    assert states["hidden_state"].tolist() == [0] * 15 + [1] * 15 + [2] * 15
    assert fitted.start.tolist() == [1, 0, 0] and fitted.trans[0, 1] >= 0.04 and fitted.trans[0, 2] == 0
    seg.release()


def test_distributed_and_local_fit_agree(blobs):
    x, df = blobs
    rules, one = fits.Rules(8, 1e-9), fits.Fit(3, 5, "full")
    while one.phase != "em":
        one = one.advance(one.gather(x), 2, rules)
    start = one.model(2)
    done = fits.settle([(x, one)], rules)[0]
    local, ll = done.model(2), done.log_likelihood
    seg = segments(df, ORDER, F.array("a", "b"), vector=True, length=10)
    spread = start.fit(seg, 9, 1e-9)
    assert np.allclose(local.means, spread.means, atol=1e-6) and spread.training.log_likelihood == pytest.approx(ll, abs=1e-4)


def test_prior_shape():
    start, trans = bidiagonal(3)
    assert start.tolist() == [1, 0, 0] and trans.tolist() == [[0.75, 0.25, 0], [0, 0.75, 0.25], [0, 0, 1]]


# --- regimes ---------------------------------------------------------------------------


@pytest.fixture(scope="module")
def series(spark):
    rng = np.random.default_rng(2)
    rows = []
    for key in ("x", "y"):
        for t in range(80):
            low = (t // 20) % 2
            rows.append((key, t, float(rng.normal(20 if low else 90, 3)), float(rng.normal(5 if low else 1, 0.5))))
    return spark.createDataFrame(rows, "series_id string, t long, cash double, delay double").cache()


def tables_of(series, lengths=(8192, 30)):
    return [regimes.SeriesTable(series, "series_id", "t", ["cash", "delay"], segment=n) for n in lengths]


def test_regimes_do_not_depend_on_segments(series, monkeypatch):
    monkeypatch.setattr(passes, "FAN", 2)  # three segments per series: groups of groups
    short, long = tables_of(series)
    decoded = [regimes.decode_series(t, 2, max_iter=4).toPandas().sort_values(["series_id", "t"]).reset_index(drop=True) for t in (short, long)]
    for _, one in decoded[0].groupby("series_id"):
        assert (one["hidden_state"].diff().fillna(0) != 0).sum() == 3
    assert decoded[0][["series_id", "t", "hidden_state"]].equals(decoded[1][["series_id", "t", "hidden_state"]])
    assert np.allclose(decoded[0]["confidence"], decoded[1]["confidence"], atol=1e-9)
    a, b = (regimes.fit_grid(t, [1, 2, 3], [1, 2], max_iter=4, tol=1e-9).toPandas().sort_values(["series_id", "n_states", "seed"]) for t in (short, long))
    assert len(a) == 12 and np.allclose(a["log_likelihood"], b["log_likelihood"], atol=1e-6) and a["n_rows"].tolist() == b["n_rows"].tolist()


def test_state_count_is_chosen(series):
    grid = regimes.with_criteria(regimes.fit_grid(tables_of(series)[0], [2, 3]))
    best = regimes.choose_states(grid, "series_id").collect()
    assert len(best) == 2 and all(r["n_states"] == 2 for r in best)


def test_candidates_meet_a_segment_once(series):
    """What the held table holds, and so what is shuffled, does not grow with state counts and seeds."""
    table = tables_of(series, [30])[0]
    held = table.held(table.scaled())
    assert held.table.count() == 6 and held.last_seg == 2
    state = fits.fitted(held, [(n, s) for n in (2, 3) for s in range(4)], "diag", fits.Rules(1, 1e-9))
    assert fits.with_fits(held.parts, state, held.keys).count() == 6 and state.count() == 16


def test_failed_fits_are_rows_on_both_ways(spark):
    rows = [(k, t, float("nan") if k == "bad" else float(t % 7)) for k in ("bad", "good") for t in range(20)]
    series = spark.createDataFrame(rows, "series_id string, t long, a double")
    for length in (100, 8):
        table = regimes.SeriesTable(series, "series_id", "t", ["a"], segment=length)
        grid = {(r["series_id"], r["status"], r["log_likelihood"] is None, r["covariance"]) for r in regimes.fit_grid(table, [2], max_iter=2).collect()}
        assert grid == {("bad", "failed", True, "diag"), ("good", "fitted", False, "full")}
        decoded = regimes.decode_series(table, 2, max_iter=2)
        assert decoded.count() == 40 and decoded.where("hidden_state IS NULL").select("series_id").distinct().collect()[0][0] == "bad"
        tails = {r["series_id"]: r["gain"] for r in regimes.temporal_validation(table, 2, max_iter=2).collect()}
        assert tails["bad"] is None and np.isfinite(tails["good"])


def test_scores_of_cut_series_equal_those_of_whole_ones(series):
    found = [regimes.temporal_validation(t, 2, max_iter=3).orderBy("series_id").toPandas() for t in tables_of(series, [8192, 10])]
    for column in ("train_ll", "tail_ll_train_only", "tail_ll_full", "gain"):
        assert np.allclose(found[0][column], found[1][column], atol=1e-6)


def test_temporal_validation_and_stability(series):
    table = tables_of(series)[0]
    rows = regimes.temporal_validation(table, 2, max_iter=20).collect()
    assert len(rows) == 2 and all(np.isfinite(r["gain"]) for r in rows)
    spread = regimes.stability(regimes.fit_grid(table, [2], [0, 1, 2], max_iter=20), "series_id").collect()
    assert all(r["runs"] == 3 and not r["unstable"] for r in spread)
    split = regimes.temporal_split(series, "series_id", "t").groupBy("series_id").agg(F.sum(F.col("is_train").cast("int")).alias("n"))
    assert {r["n"] for r in split.collect()} == {64}


def test_parameter_counts():
    assert [regimes.parameter_count(n, 4, "full_square") for n in (2, 3, 4, 5)] == [32, 51, 72, 95]
    assert regimes.parameter_count(3, 3, "free") == 6 + 2 + 9 + 18 and regimes.parameter_count(3, 3, "spherical") == 2 + 9 + 3


def test_nth_largest(spark):
    rng = np.random.default_rng(0)
    values = np.round(rng.random(500), 3).tolist() + [7.0] * 5
    df = spark.createDataFrame([(v, None if i % 3 else v) for i, v in enumerate(values)], "a double, b double")
    ranked = sorted(values, reverse=True)
    for n in (1, 5, 6, 60, 505):
        assert nth_largest(df, {"a": F.col("a")}, {"a": n})["a"] == ranked[n - 1]
    thin = sorted([v for i, v in enumerate(values) if i % 3 == 0], reverse=True)
    assert nth_largest(df, {"b": F.col("b"), "a": F.col("a")}, {"b": 20, "a": 7}) == {"b": thin[19], "a": ranked[6]}
    assert mean_of_top(df, F.col("a"), 10, ["a"], ranked[9])[0] == pytest.approx(np.mean(ranked[:10]))


def test_rows_are_cut_once_to_train_and_decode(spark, observed, model, monkeypatch):
    _, df = observed
    for length in (8192, 4):  # whole runs, and one run in pieces
        train, every = segments(df, ORDER, F.col("o"), length=length, distinct=True), segments(df, ORDER, F.col("o"), length=length, passes=False)
        cuts = []
        with monkeypatch.context() as patch:
            patch.setattr(run_cuts, "cut_runs", lambda *a, made=run_cuts.cut_runs: cuts.append(1) or made(*a))
            held, rows = run_cuts.both(df, ORDER, F.col("o"), length=length)
        assert len(cuts) == 1 and (held.last_seg, rows.last_seg) == (train.last_seg, every.last_seg)
        np.testing.assert_allclose(passes.expected_counts(held, model), passes.expected_counts(train, model))
        a, b = (passes.decode(s, model).drop("log_scale").orderBy("source_row_index").collect() for s in (rows, every))
        assert a == b and len(a) == df.count()
        held.release(), train.release()
