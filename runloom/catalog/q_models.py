"""Queries: encoding, training, decoding and naming of hidden states."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions import lexicon as lx
from ..models import passes
from ..models.discrete import SMOOTHING, DiscreteModel, class_number
from ..models.gaussian import GaussianModel
from ..models.kernel import EPS
from ..models.runs import both, segments
from ..models.seeds import dominance, seed_means
from ..models.semantics import block_profiles, feature_means, name_decoded, names_table
from ..operators.features import Scaler, block_weights, semantic_view
from ..operators.profiles import with_row_signals
from ..operators.selection import nth_largest
from ..sources import params
from . import em_sql
from .binding import (
    FIELD_CTE, ROW_ANALYSIS_CTE, athlete_order, episodes,
    field_rows, observed_rows, row_analysis, with_cte,
)
from .q_sequences import _RUNS
from .registry import query

MODEL = DiscreteModel.initial(3)
CLASS_CASE = "CASE observed_zap_class " + " ".join(f"WHEN '{c}' THEN {i}" for i, c in enumerate(lx.OBSERVED_CLASSES)) + " ELSE 7 END"


@query("h3_class_number", with_cte(FIELD_CTE, f"SELECT source_row_index, {CLASS_CASE} AS class_number FROM fld"))
def class_numbers(spark, sf):
    return observed_rows(spark, sf).select(
        "source_row_index", class_number(F.col("observed_zap_class"), lx.OBSERVED_CLASSES).alias("class_number")
    )


def _segments(spark, sf, train=False, cut=segments, **how):
    rows = episodes(spark, sf)
    if train:
        rows = rows.where("is_train_eligible")
    rows = rows.select("sheet_name", "athlete_name", "source_row_index", "sequence_id", "observed_zap_class")
    return cut(rows, athlete_order(spark, sf), class_number(F.col("observed_zap_class"), lx.OBSERVED_CLASSES), **how)


# --- SQL twins: the three states are unrolled into columns ---------------------------

S = range(3)


def _pick(table, state):
    """CASE over the class number with one literal per class."""
    return "CASE o " + " ".join(f"WHEN {c} THEN {table[state][c]!r}" for c in range(len(lx.OBSERVED_CLASSES))) + " END"


def _clean(m):
    return [[float(x) for x in row] for row in m]


_E = _clean(MODEL.emit)
_A = _clean(MODEL.trans)
_P = [float(x) for x in MODEL.start]
_LE = _clean(np.log(np.maximum(MODEL.emit, EPS)))
_LA = _clean(MODEL.log_trans)
_LP = [float(x) for x in MODEL.log_start]


def _argmax(a, b, c):
    return f"CASE WHEN {a} >= {b} AND {a} >= {c} THEN 0 WHEN {b} >= {c} THEN 1 ELSE 2 END"


_OBS = _RUNS + f""",
seq AS (
  SELECT source_row_index AS row, sheet_name || '/' || athlete_name || '/' || CAST(run_no AS BIGINT) AS rid,
    row_number() OVER (PARTITION BY sheet_name, athlete_name, run_no ORDER BY source_row_index) AS pos,
    count(*) OVER (PARTITION BY sheet_name, athlete_name, run_no) AS len, {CLASS_CASE} AS o FROM runs
),
em AS (SELECT *, {", ".join(f"{_pick(_E, j)} AS e{j}, {_pick(_LE, j)} AS l{j}" for j in S)} FROM seq)"""

_BEST = _OBS + f""",
fw AS (
  SELECT rid, pos, len, {", ".join(f"{_LP[j]!r} + l{j} AS d{j}" for j in S)}, {", ".join(f"0 AS b{j}" for j in S)}
  FROM em WHERE pos = 1
  UNION ALL
  SELECT e.rid, e.pos, e.len,
    {", ".join("greatest(" + ", ".join(f"d{i} + {_LA[i][j]!r}" for i in S) + f") + e.l{j}" for j in S)},
    {", ".join(_argmax(*[f"d{i} + {_LA[i][j]!r}" for i in S]) for j in S)}
  FROM fw JOIN em e ON e.rid = fw.rid AND e.pos = fw.pos + 1
),
bk AS (
  SELECT rid, pos, {_argmax("d0", "d1", "d2")} AS s FROM fw WHERE pos = len
  UNION ALL
  SELECT fw.rid, fw.pos - 1, CASE bk.s WHEN 0 THEN b0 WHEN 1 THEN b1 ELSE b2 END
  FROM bk JOIN fw ON fw.rid = bk.rid AND fw.pos = bk.pos WHERE bk.pos > 1
)"""

_JOINT = [f"({' + '.join(f'a{i} * {_A[i][j]!r}' for i in S)}) * e.e{j}" for j in S]
_POST = _OBS + f""",
f0 AS (SELECT rid, pos, len, row, {", ".join(f"{_P[j]!r} * e{j} AS x{j}" for j in S)} FROM em WHERE pos = 1),
al AS (
  SELECT rid, pos, len, row, {", ".join(f"x{j} / (x0 + x1 + x2) AS a{j}" for j in S)}, x0 + x1 + x2 AS c FROM f0
  UNION ALL
  SELECT rid, pos, len, row, {", ".join(f"x{j} / (x0 + x1 + x2)" for j in S)}, x0 + x1 + x2
  FROM (SELECT e.rid, e.pos, e.len, e.row, {", ".join(f"{_JOINT[j]} AS x{j}" for j in S)}
        FROM al JOIN em e ON e.rid = al.rid AND e.pos = al.pos + 1)
),
be AS (
  SELECT rid, pos, 1.0::DOUBLE AS z0, 1.0::DOUBLE AS z1, 1.0::DOUBLE AS z2 FROM al WHERE pos = len
  UNION ALL
  SELECT be.rid, be.pos - 1, {", ".join("(" + " + ".join(f"{_A[i][j]!r} * e.e{j} * z{j}" for j in S) + ") / al.c" for i in S)}
  FROM be JOIN em e ON e.rid = be.rid AND e.pos = be.pos JOIN al ON al.rid = be.rid AND al.pos = be.pos WHERE be.pos > 1
),
ga AS (
  SELECT al.rid, al.pos, al.len, al.row, al.c, {", ".join(f"a{j} * z{j} / (a0 * z0 + a1 * z1 + a2 * z2) AS g{j}" for j in S)},
    a0, a1, a2, z0, z1, z2
  FROM al JOIN be ON be.rid = al.rid AND be.pos = al.pos
)"""


def _recursive(cte, select):
    return "WITH RECURSIVE " + cte + "\n" + select


@query("h5_best_path", _recursive(_BEST, """
SELECT em.row AS source_row_index, s AS hidden_state FROM bk JOIN em ON em.rid = bk.rid AND em.pos = bk.pos"""))
def best_path(spark, sf):
    return passes.decode(_segments(spark, sf, passes=False), MODEL).select("source_row_index", "hidden_state")


@query("h8_decoded_counts", _recursive(_BEST, "SELECT s AS hidden_state, count(*) AS n FROM bk GROUP BY 1"))
def decoded_counts(spark, sf):
    rows = passes.decode(_segments(spark, sf, passes=False), MODEL)
    return rows.groupBy("hidden_state").agg(F.count(F.lit(1)).alias("n"))


@query("h9_posteriors", _recursive(_POST, """
SELECT row AS source_row_index, round(g0, 6) AS p_state_0, round(g1, 6) AS p_state_1, round(g2, 6) AS p_state_2 FROM ga"""))
def posteriors(spark, sf):
    rows = passes.decode(_segments(spark, sf, passes=False), MODEL)
    return rows.select("source_row_index", *[F.round(f"p_state_{i}", 6).alias(f"p_state_{i}") for i in S])


@query("h9_log_likelihood", _recursive(_POST, "SELECT round(sum(ln(c)), 4) AS log_likelihood, count(*) AS rows FROM ga"))
def log_likelihood(spark, sf):
    rows = passes.decode(_segments(spark, sf, passes=False), MODEL)
    return rows.agg(F.round(F.sum("log_scale"), 4).alias("log_likelihood"), F.count(F.lit(1)).alias("rows"))


@query("h10_prediction", _recursive(_POST + ", " + _BEST[len(_OBS) + 1:], """
SELECT ga.row AS source_row_index, s AS hidden_state, 'state_' || s AS hidden_state_name,
  round(greatest(g0, g1, g2), 6) AS confidence FROM ga JOIN bk ON bk.rid = ga.rid AND bk.pos = ga.pos"""))
def prediction(spark, sf):
    rows = passes.decode(_segments(spark, sf, passes=False), MODEL)
    return rows.select(
        "source_row_index", "hidden_state", F.concat(F.lit("state_"), F.col("hidden_state")).alias("hidden_state_name"),
        F.round("confidence", 6).alias("confidence"),
    )


def _counts_sql():
    parts = [f"SELECT 'start' AS kind, {j} AS i, 0 AS j, sum(g{j}) AS v FROM ga WHERE pos = 1" for j in S]
    parts += [f"SELECT 'emit', {i}, o, sum(g{i}) FROM ga JOIN em ON em.rid = ga.rid AND em.pos = ga.pos GROUP BY o" for i in S]
    total = " + ".join(f"p.a{i} * {_A[i][j]!r} * e.e{j} * n.z{j}" for i in S for j in S)
    step = "ga p JOIN ga n ON n.rid = p.rid AND n.pos = p.pos + 1 JOIN em e ON e.rid = n.rid AND e.pos = n.pos"
    parts += [
        f"SELECT 'trans', {i}, {j}, sum(p.a{i} * {_A[i][j]!r} * e.e{j} * n.z{j} / ({total})) FROM {step}" for i in S for j in S
    ]
    return "SELECT kind, i, j, round(v, 4) AS value FROM (" + " UNION ALL ".join(parts) + ") WHERE v > 1e-9"


@query("h4_expected_counts", _recursive(_POST, _counts_sql()))
def expected_counts(spark, sf):
    """One E-step: expected starts, moves and emissions over all runs."""
    seg = _segments(spark, sf, distinct=True)
    stats = passes.expected_counts(seg, MODEL)
    seg.release()
    n, m = MODEL.n, len(MODEL.classes)
    rows = [("start", i, 0, float(stats[1 + i])) for i in range(n)]
    rows += [("trans", i, j, float(stats[1 + n + i * n + j])) for i in range(n) for j in range(n)]
    rows += [("emit", i, j, float(stats[1 + n + n * n + i * m + j])) for i in range(n) for j in range(m)]
    table = spark.createDataFrame([r for r in rows if r[3] > 1e-9], "kind string, i int, j int, value double")
    return table.withColumn("value", F.round("value", 4))


#: Rows of the longest run that the twins of the discrete training write out.
_LONGEST = 24


def trained_sql(train: bool) -> str:
    """CTEs up to `last`, the model after EM over the training runs or over all runs."""
    obs = _OBS.replace("AS before FROM epi\n", "AS before FROM epi WHERE is_train_eligible\n") if train else _OBS
    runs = "rr AS (SELECT list(o ORDER BY pos) AS os FROM seq GROUP BY rid)"
    em = em_sql.discrete("rr", MODEL.start, MODEL.trans, MODEL.emit, SMOOTHING, MODEL.min_forward, EPS, _LONGEST, 300, 1e-4)
    return f"{obs},\n{runs},\n{em},\nlast AS (SELECT * FROM model ORDER BY it DESC LIMIT 1)"


_M = len(lx.OBSERVED_CLASSES)
_NUMBERS = f"""SELECT 'trained' AS model_id, kind, CAST(i AS INT) AS i, CAST(j AS INT) AS j, round(value, 4) AS value FROM (
  SELECT 'start' AS kind, 0 AS i, unnest(range(0, 3)) AS j, unnest(p) AS value FROM last
  UNION ALL SELECT 'trans', unnest(range(0, 9)) // 3, unnest(range(0, 9)) % 3, unnest(t) FROM last
  UNION ALL SELECT 'emit', unnest(range(0, {3 * _M})) // {_M}, unnest(range(0, {3 * _M})) % {_M}, unnest(e) FROM last)"""


def trained_model(spark, sf):
    seg = _segments(spark, sf, train=True, distinct=True)
    model = MODEL.fit(seg)
    seg.release()
    return params.discrete_table(spark, model, "trained")


@query("h7_trained_parameters", _recursive(trained_sql(True), _NUMBERS))
def trained_parameters(spark, sf):
    return trained_model(spark, sf).withColumn("value", F.round("value", 4))


@query("h11_semantic_features", with_cte(FIELD_CTE, """
SELECT source_row_index, round(kfv_capture_code + kfv_grip_code + kfv_wrap_code + kfv_hook_code + kfv_post_code, 6) AS kfv_code,
  round(kfv_grip_code, 6) AS holds_code, round(vup_code, 6) AS vup_code, episode_time_sec AS duration FROM fld"""))
def semantic_features(spark, sf):
    rows = semantic_view(field_rows(spark, sf))
    return rows.select("source_row_index", *[F.round(c, 6).alias(c) for c in ("kfv_code", "holds_code", "vup_code")], "duration")


_PROFILE = """
, sem AS (
  SELECT hidden_state, maneuver_right_code AS mr, maneuver_left_code AS ml, kfv_capture_code AS c1, kfv_grip_code AS c2,
    kfv_wrap_code AS c3, kfv_hook_code AS c4, kfv_post_code AS c5, vup_code AS v,
    kfv_capture_code + kfv_grip_code + kfv_wrap_code + kfv_hook_code + kfv_post_code AS k FROM ra
), sc2 AS (
  SELECT hidden_state, (abs(avg(mr)) + abs(avg(ml))) / 2 AS m,
    (abs(avg(k)) + abs(avg(c1)) + abs(avg(c2)) + abs(avg(c3)) + abs(avg(c4)) + abs(avg(c5))) / 6 AS k, abs(avg(v)) AS v
  FROM sem GROUP BY 1
)"""


@query("h12_state_block_profile", with_cte(ROW_ANALYSIS_CTE + _PROFILE, """
SELECT hidden_state, round(m, 6) AS maneuvering_score, round(k, 6) AS kfv_score, round(v, 6) AS vup_score,
  round(m / (m + k + v), 6) AS maneuvering_share, round(k / (m + k + v), 6) AS kfv_share, round(v / (m + k + v), 6) AS vup_share,
  CASE WHEN m >= k AND m >= v THEN 'maneuvering' WHEN k >= v THEN 'kfv' ELSE 'vup' END AS dominant_block,
  round((greatest(m, k, v) - (m + k + v - greatest(m, k, v) - least(m, k, v))) / (m + k + v), 6) AS margin FROM sc2"""))
def state_block_profile(spark, sf):
    found = block_profiles(feature_means(semantic_view(row_analysis(spark, sf))))
    rounded = [F.round(f"{b}_{part}", 6).alias(f"{b}_{part}") for part in ("score", "share") for b in lx.BLOCK_FEATURES]
    return found.select("hidden_state", *rounded, "dominant_block", F.round("margin", 6).alias("margin"))


@query("h13_state_names")
def state_names(spark, sf):
    """Names of states decoded with the starting model."""
    seg = _segments(spark, sf, passes=False)
    rows = passes.decode(seg, MODEL).select("source_row_index", "hidden_state")
    features = semantic_view(field_rows(spark, sf)).select("source_row_index", *lx.MODEL_FEATURES)
    return names_table(spark, name_decoded(rows.join(features, "source_row_index"), MODEL.n))


# --- Gaussian -----------------------------------------------------------------------------


def _gaussian_input(spark, sf):
    rows = semantic_view(episodes(spark, sf))
    rows = rows.select("sheet_name", "athlete_name", "source_row_index", "sequence_id", *lx.MODEL_FEATURES)
    columns = list(lx.MODEL_FEATURES)
    return rows, Scaler.fit(rows, columns, block_weights(columns))


@query("f13_standardized", with_cte(FIELD_CTE, """
, st AS (SELECT avg(episode_time_sec) AS m, stddev_pop(episode_time_sec) AS s, avg(vup_code) AS mv, stddev_pop(vup_code) AS sv FROM fld)
SELECT source_row_index, round((episode_time_sec - m) / s * (0.9 / sqrt(2)), 5) AS z_duration, round((vup_code - mv) / sv * 1.35, 5) AS z_vup
FROM fld, st"""))
def standardized(spark, sf):
    rows = semantic_view(field_rows(spark, sf))
    columns = ["vup_code", "duration", "pause"]
    scaler = Scaler.fit(rows, columns, block_weights(columns))
    return rows.select(
        "source_row_index", F.round(scaler.scaled(1), 5).alias("z_duration"), F.round(scaler.scaled(0), 5).alias("z_vup")
    )


@query("a15_row_signal", with_cte(FIELD_CTE, """
SELECT source_row_index, round((abs(maneuver_right_code) + abs(maneuver_left_code)) / 2, 6) AS maneuvering_signal,
  round((2 * (kfv_capture_code + kfv_grip_code + kfv_wrap_code + kfv_hook_code + kfv_post_code)) / 6, 6) AS kfv_signal,
  round(abs(vup_code), 6) AS vup_signal FROM fld"""))
def row_signals(spark, sf):
    out = with_row_signals(semantic_view(field_rows(spark, sf)))
    return out.select("source_row_index", *[F.round(f"{b}_signal", 6).alias(f"{b}_signal") for b in lx.BLOCK_FEATURES])


_GAP = FIELD_CTE + """,
sg AS (
  SELECT source_row_index, (maneuver_right_code + maneuver_left_code) / 2 AS m,
    2 * (kfv_capture_code + kfv_grip_code + kfv_wrap_code + kfv_hook_code + kfv_post_code) / 6 AS k, vup_code AS v,
    episode_time_sec AS t FROM fld
),
gaps AS (
  SELECT 'maneuvering' AS block, t, m - greatest(k, v) AS gap FROM sg
  UNION ALL SELECT 'kfv', t, k - greatest(m, v) FROM sg UNION ALL SELECT 'vup', t, v - greatest(m, k) FROM sg
),
top AS (SELECT greatest(3, CAST(round_even(count(*) * 0.12, 0) AS BIGINT)) AS n FROM fld),
rk AS (SELECT block, gap, t, row_number() OVER (PARTITION BY block ORDER BY gap DESC) AS r FROM gaps WHERE gap > 0)"""


@query("t6_seed_threshold", with_cte(_GAP, """
SELECT block, round(min(gap), 6) AS threshold FROM rk, top WHERE r <= n GROUP BY 1"""))
def seed_threshold(spark, sf):
    """The smallest dominance among the seed rows of each block."""
    rows = semantic_view(field_rows(spark, sf))
    top = max(3, round(rows.count() * 0.12))
    cuts = nth_largest(rows, {b: dominance(rows, b) for b in lx.BLOCK_FEATURES}, {b: top for b in lx.BLOCK_FEATURES})
    found = [(b, cut) for b, cut in cuts.items() if cut is not None]
    return spark.createDataFrame(found, "block string, threshold double").withColumn("threshold", F.round("threshold", 6))


@query("h17_seed_means", with_cte(_GAP + """,
cut AS (SELECT block, min(gap) AS g, min(n) AS n FROM rk, top WHERE r <= n GROUP BY 1),
parts AS (
  SELECT c.block, c.n, count(*) FILTER (gap > g + 1e-9) AS na, sum(t) FILTER (gap > g + 1e-9) AS sa,
    count(*) FILTER (abs(gap - g) <= 1e-9) AS ne, avg(t) FILTER (abs(gap - g) <= 1e-9) AS me
  FROM gaps JOIN cut c ON c.block = gaps.block WHERE gap > 0 GROUP BY 1, 2
)""", """
SELECT block, round((coalesce(sa, 0) + (least(n, na + ne) - na) * coalesce(me, 0)) / least(n, na + ne), 4) AS mean_duration FROM parts"""))
def seeds(spark, sf):
    rows = semantic_view(field_rows(spark, sf)).select("source_row_index", *lx.MODEL_FEATURES)
    plain = Scaler(["duration"], [0.0], [1.0], [1.0])
    rounded = rows.withColumns({c: F.round(c, 9) for c in lx.MODEL_FEATURES})
    means, _ = seed_means(rounded, plain, 3, "source_row_index")
    table = spark.createDataFrame(
        [(block, float(means[i][0])) for i, (block, _) in enumerate(lx.SEMANTIC_STATES)], "block string, mean_duration double"
    )
    return table.withColumn("mean_duration", F.round("mean_duration", 4))


def _gaussian_fit(spark, sf):
    rows, scaler = _gaussian_input(spark, sf)
    means, _ = seed_means(rows, scaler, 3, "source_row_index")
    spread = np.array([(1.0 if s > 0 else 0.0) * w * w for s, w in zip(scaler.deviations, scaler.weights)]) + 0.01
    model = GaussianModel.initial(means, spread, "diag", "left_to_right", scaler=scaler)
    seg = segments(rows, athlete_order(spark, sf), scaler.vector(), vector=True)
    return model.fit(seg), seg


@query("h19_gaussian_parameters")
def gaussian_parameters(spark, sf):
    model, seg = _gaussian_fit(spark, sf)
    seg.release()
    return params.gaussian_table(spark, model, "gaussian")


@query("h22_gaussian_decode")
def gaussian_decode(spark, sf):
    model, seg = _gaussian_fit(spark, sf)
    seg.release()
    return passes.decode(seg, model).select("source_row_index", "hidden_state", "confidence")
