"""The EM of Gaussian hidden Markov models in SQL: the twin of `models.fits`.

Means by k-means from seeded directions, then EM turns, each with a recursive forward
and backward pass, all series, state counts and seeds at once. Tables have a row per
fit, row of the series and state; a fit is (key, n, seed). Starting directions are
constants of the seed, as in the Spark jobs. A statement has a fixed number of turns
written out; a fit that has not ended by the last of them has no row.
"""

from __future__ import annotations

import math

from ..models import fits

FIT = "key, n, seed"


def same(a: str, b: str, *more: str) -> str:
    return " AND ".join(f"{a}.{c} = {b}.{c}" for c in ("key", "n", "seed", *more))


def root(source: str, d: int) -> str:
    """Adds the Cholesky factor `l{i}_{j}` of the covariance `v{i}_{j}`, column by column."""
    for j in range(d):
        inner = f"v{j}_{j}" + "".join(f" - l{j}_{k} * l{j}_{k}" for k in range(j))
        source = f"(SELECT *, sqrt({inner}) AS l{j}_{j} FROM {source})"
        below = [f"(v{i}_{j}{''.join(f' - l{i}_{k} * l{j}_{k}' for k in range(j))}) / l{j}_{j} AS l{i}_{j}" for i in range(j + 1, d)]
        if below:
            source = f"(SELECT *, {', '.join(below)} FROM {source})"
    return source


def log_density(source: str, d: int) -> str:
    """Adds `logb`, the log density of `x0`, `x1`, ... under means `m0`, ... and the factor."""
    for i in range(d):
        inner = f"x{i} - m{i}" + "".join(f" - l{i}_{k} * z{k}" for k in range(i))
        source = f"(SELECT *, ({inner}) / l{i}_{i} AS z{i} FROM {source})"
    quad, size = " + ".join(f"z{i} * z{i}" for i in range(d)), " + ".join(f"ln(l{i}_{i})" for i in range(d))
    return f"(SELECT *, -0.5::DOUBLE * ({d * math.log(2 * math.pi)!r}::DOUBLE + {quad}) - ({size}) AS logb FROM {source})"


def starts(rows: str, candidates: list[tuple[int, int]], covariance: str, d: int) -> list[str]:
    """CTEs up to `em0` (a row per fit and state: means m, covariances v, start p) and `tr0` (moves p from i to k).

    `rows` is a CTE of (key, t, x0, x1, ...), features scaled.
    """
    ways, edges = [], []
    for n, seed in candidates:
        way, ends, middles = fits.first_bins(d, n, seed)
        ways.append(f"({n}, {seed}, {', '.join(f'{float(w)!r}::DOUBLE' for w in way)})")
        lows = [-math.inf, *map(float, ends)]
        edges += [f"({n}, {seed}, {k}, {'-1e300' if k == 0 else repr(lows[k])}::DOUBLE, {float(middles[k])!r}::DOUBLE)" for k in range(n)]
    xs = range(d)
    comma = lambda text: ", ".join(text.format(i=i) for i in xs)
    score = " + ".join(f"x{i} * w{i}" for i in xs)
    ctes = [
        f"way(n, seed, {comma('w{i}')}) AS (VALUES {', '.join(ways)})",
        f"edge(n, seed, k, low, middle) AS (VALUES {', '.join(edges)})",
        f"scored AS (SELECT r.*, n, seed, {comma('w{i}')}, {score} AS s FROM {rows} r, way)",
        f"""mom AS (SELECT {FIT}, avg(s) AS mid, stddev_pop(s) AS wide, {comma('avg(x{i}) AS a{i}')}, {comma('any_value(w{i}) AS w{i}')},
  {comma('var_pop(x{i}) AS s{i}')}, count(*) AS n_rows FROM scored GROUP BY {FIT})""",
        f"c0 AS (SELECT m.key, m.n, m.seed, k, {comma('a{i} + middle * wide * w{i} AS m{i}')} FROM mom m JOIN edge e ON e.n = m.n AND e.seed = m.seed)",
    ]
    for turn in range(fits.ROUNDS + 1):
        if turn == 0:
            found = f"""SELECT s.key, s.n, s.seed, t, {comma('x{i}')}, max(k) AS k FROM scored s JOIN mom m ON {same('m', 's')}
    JOIN edge e ON e.n = s.n AND e.seed = s.seed AND (k = 0 OR mid + wide * low <= s) GROUP BY ALL"""
        else:
            away = " + ".join(f"(x{i} - m{i}) * (x{i} - m{i})" for i in xs)
            found = f"""SELECT c.key, c.n, c.seed, t, {comma('any_value(x{i}) AS x{i}')}, arg_min(k, {{'d': {away}, 'k': k}}) AS k
    FROM c{turn} c JOIN {rows} r ON r.key = c.key GROUP BY c.key, c.n, c.seed, t"""
        ctes.append(f"g{turn} AS (SELECT {FIT}, k, {comma('avg(x{i}) AS m{i}')} FROM ({found}) GROUP BY {FIT}, k)")
        ctes.append(f"""c{turn + 1} AS (SELECT c.key, c.n, c.seed, c.k, {comma('coalesce(g.m{i}, c.m{i}) AS m{i}')}
  FROM c{turn} c LEFT JOIN g{turn} g ON {same('g', 'c', 'k')})""")
    wide = {i: f"greatest(s{i}, 1e-3)" for i in xs}
    if covariance == "spherical":
        wide = dict.fromkeys(xs, f"({' + '.join(wide.values())}) / {d}")
    cells = ", ".join(f"{wide[i] if i == j else '0.0::DOUBLE'} AS v{i}_{j}" for i in xs for j in xs)
    ctes.append(f"""em0 AS (SELECT c.key, c.n, c.seed, k, {comma('c.m{i}')}, {cells}, 1.0::DOUBLE / c.n AS p
  FROM c{fits.ROUNDS + 1} c JOIN mom m ON {same('m', 'c')})""")
    stay = "CASE WHEN a.n = 1 THEN 1.0::DOUBLE WHEN a.k = b.k THEN 0.7::DOUBLE ELSE (1.0::DOUBLE - 0.7::DOUBLE) / (a.n - 1) END"
    ctes.append(f"tr0 AS (SELECT a.key, a.n, a.seed, a.k AS i, b.k, {stay} AS p FROM em0 a JOIN em0 b ON {same('a', 'b')})")
    return ctes


def forward(rows: str, turn: int | str, d: int, name: str = "") -> list[str]:
    """CTEs `b`, `f` (forward vectors a and scales z) and `ll` of the models of one turn on `rows` (key, u, x.., u from 1)."""
    tag = f"{name}{turn}"
    ks = f"SELECT r.u, r.t, {', '.join(f'x{i}' for i in range(d))}, e.* FROM em{turn} e JOIN {rows} r ON r.key = e.key"
    if name:  # other rows than those fitted: the model's key has a part that the rows' key lacks
        ks = ks.replace("r.key = e.key", "e.key IN (r.key || ' head', r.key || ' whole')")
    dense = log_density(root(f"({ks})", d), d)
    return [
        f"""b{tag} AS MATERIALIZED (SELECT {FIT}, u, t, k, logb, exp(logb - max(logb) OVER w) AS b, max(logb) OVER w AS top
  FROM {dense} WINDOW w AS (PARTITION BY {FIT}, u))""",
        f"""f{tag} AS (
  SELECT {FIT}, u, k, j / greatest(sum(j) OVER w, 1e-300) AS a, greatest(sum(j) OVER w, 1e-300) AS z
  FROM (SELECT b.key, b.n, b.seed, u, b.k, e.p * b AS j FROM b{tag} b JOIN em{turn} e ON {same('e', 'b', 'k')} WHERE u = 1) WINDOW w AS (PARTITION BY {FIT})
  UNION ALL
  SELECT {FIT}, u, k, j / greatest(sum(j) OVER w, 1e-300), greatest(sum(j) OVER w, 1e-300)
  FROM (SELECT f.key, f.n, f.seed, f.u + 1 AS u, r.k, sum(f.a * r.p) * any_value(b.b) AS j FROM f{tag} f
    JOIN tr{turn} r ON {same('r', 'f')} AND r.i = f.k JOIN b{tag} b ON {same('b', 'f')} AND b.u = f.u + 1 AND b.k = r.k
    GROUP BY f.key, f.n, f.seed, f.u, r.k) WINDOW w AS (PARTITION BY {FIT}))""",
        f"""ll{tag} AS (SELECT f.key, f.n, f.seed, sum(ln(z) + top) AS ll FROM (SELECT DISTINCT {FIT}, u, z FROM f{tag}) f
  JOIN (SELECT DISTINCT {FIT}, u, top FROM b{tag}) b ON {same('b', 'f', 'u')} GROUP BY f.key, f.n, f.seed)""",
    ]


def backward(turn: int | str) -> list[str]:
    """CTEs `h` (backward vectors), `y` (posteriors g) and `mv` (expected moves)."""
    return [
        f"""h{turn} AS (
  SELECT f.key, f.n, f.seed, u, k, 1.0::DOUBLE AS e FROM f{turn} f JOIN (SELECT {FIT}, max(u) AS last FROM f{turn} GROUP BY ALL) m ON {same('m', 'f')} WHERE u = last
  UNION ALL
  SELECT h.key, h.n, h.seed, h.u - 1, r.i, sum(r.p * b.b * h.e) / any_value(f.z) FROM h{turn} h
    JOIN tr{turn} r ON {same('r', 'h')} AND r.k = h.k JOIN b{turn} b ON {same('b', 'h', 'u', 'k')} JOIN f{turn} f ON {same('f', 'h', 'u', 'k')}
    WHERE h.u > 1 GROUP BY h.key, h.n, h.seed, h.u, r.i)""",
        f"""y{turn} AS MATERIALIZED (SELECT h.key, h.n, h.seed, h.u, h.k, a, b.b * h.e AS w, a * h.e / greatest(sum(a * h.e) OVER (PARTITION BY h.key, h.n, h.seed, h.u), 1e-300) AS g
  FROM h{turn} h JOIN f{turn} f ON {same('f', 'h', 'u', 'k')} JOIN b{turn} b ON {same('b', 'h', 'u', 'k')})""",
        f"""mv{turn} AS (SELECT {FIT}, i, k, sum(j / greatest(z, 1e-300)) AS j FROM (
    SELECT *, sum(j) OVER (PARTITION BY {FIT}, u) AS z FROM (
      SELECT p.key, p.n, p.seed, p.u, r.i, r.k, p.a * r.p * q.w AS j FROM y{turn} p JOIN tr{turn} r ON {same('r', 'p')} AND r.i = p.k
        JOIN y{turn} q ON {same('q', 'p')} AND q.u = p.u + 1 AND q.k = r.k)) GROUP BY {FIT}, i, k)""",
    ]


def update(rows: str, turn: int, covariance: str, d: int) -> list[str]:
    """CTEs `em` and `tr` of the next turn."""
    xs, new = range(d), turn + 1
    sums = ", ".join([f"sum(g * x{i}) AS t{i}" for i in xs] + [f"sum(g * x{i} * x{j}) AS q{i}_{j}" for i in xs for j in xs])
    spread = {(i, j): f"(CASE WHEN {i} = {j} THEN 0.01::DOUBLE ELSE 0 END + q{i}_{j} - w * (t{i} / w) * (t{j} / w)) / w" for i in xs for j in xs}
    if covariance != "full":
        even = " + ".join(spread[i, i] for i in xs)
        spread = {(i, j): "0.0::DOUBLE" if i != j else f"({even}) / {d}" if covariance == "spherical" else spread[i, j] for i in xs for j in xs}
    cells = ", ".join(f"{spread[i, j]} + {1e-6 if i == j else 0.0!r}::DOUBLE AS v{i}_{j}" for i in xs for j in xs)
    share = "CASE WHEN sum({0}) OVER w > 0 THEN {0} / sum({0}) OVER w ELSE 1.0::DOUBLE / n END"
    return [
        f"""em{new} AS MATERIALIZED (SELECT {FIT}, k, {', '.join(f't{i} / w AS m{i}' for i in xs)}, {cells}, {share.format('g1')} AS p FROM (
    SELECT y.key, n, seed, k, greatest(sum(g), 1e-10) AS w, sum(g) FILTER (y.u = 1) AS g1, {sums} FROM y{turn} y JOIN {rows} r ON r.key = y.key AND r.u = y.u
    GROUP BY y.key, n, seed, k) WINDOW w AS (PARTITION BY {FIT}))""",
        f"""tr{new} AS MATERIALIZED (SELECT {FIT}, i, k, {share.format('j')} AS p FROM mv{turn} WINDOW w AS (PARTITION BY {FIT}, i))""",
    ]


def fitted(rows: str, candidates: list[tuple[int, int]], covariance: str, d: int, max_iter: int, turns: int, tol: float = 1e-4) -> str:
    """CTEs up to `fit` (key, n, seed, turn, ll, n_rows) and the models of the ended fits, `emF` and `trF`. For WITH RECURSIVE."""
    ctes = [*starts(rows, candidates, covariance, d), f"numbered AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY t) AS u FROM {rows})"]
    for turn in range(turns + 1):
        ctes += forward("numbered", turn, d)
        if turn < turns:
            ctes += [*backward(turn), *update("numbered", turn, covariance, d)]
    every = lambda name: " UNION ALL ".join(f"SELECT *, {turn} AS turn FROM {name}{turn}" for turn in range(turns + 1))
    ctes.append(f"""fit AS MATERIALIZED (
  SELECT l.key, l.n, l.seed, turn, ll, n_rows FROM (
    SELECT *, ll - lag(ll) OVER (PARTITION BY {FIT} ORDER BY turn) AS gain FROM ({every('ll')})) l JOIN mom m ON {same('m', 'l')}
  WHERE turn >= {max_iter} OR gain < {tol!r} QUALIFY row_number() OVER (PARTITION BY l.key, l.n, l.seed ORDER BY turn) = 1)""")
    for name in ("em", "tr"):
        ctes.append(f"{name}F AS MATERIALIZED (SELECT e.* EXCLUDE (turn) FROM ({every(name)}) e JOIN fit f ON {same('f', 'e', 'turn')})")
    return ",\n".join(ctes)


def decoded(d: int) -> str:
    """CTEs after `fitted`: posteriors `yF` and most likely states `path` (key, n, seed, u, k); the lowest state wins a tie."""
    best = "{'s': v.s + ln(greatest(r.p, 1e-12)), 'i': -r.i}"
    return ",\n".join([*forward("numbered", "F", d), *backward("F"), f"""vit AS (
  SELECT b.key, b.n, b.seed, u, b.k, ln(greatest(p, 1e-12)) + logb AS s, CAST(NULL AS INT) AS back FROM bF b JOIN emF e ON {same('e', 'b', 'k')} WHERE u = 1
  UNION ALL
  SELECT v.key, v.n, v.seed, v.u + 1, r.k, max(v.s + ln(greatest(r.p, 1e-12))) + any_value(b.logb), arg_max(r.i, {best})
  FROM vit v JOIN trF r ON {same('r', 'v')} AND r.i = v.k JOIN bF b ON {same('b', 'v')} AND b.u = v.u + 1 AND b.k = r.k GROUP BY v.key, v.n, v.seed, v.u, r.k)""",
        f"""path AS (
  SELECT {FIT}, u, k, back FROM vit QUALIFY row_number() OVER (PARTITION BY {FIT} ORDER BY u DESC, s DESC, k) = 1
  UNION ALL
  SELECT v.key, v.n, v.seed, v.u, v.k, v.back FROM path p JOIN vit v ON {same('v', 'p')} AND v.u = p.u - 1 AND v.k = p.back)"""])


# --- one discrete model over many short runs ------------------------------------------


def discrete(runs: str, start, trans, emit, smoothing: float, min_forward: float, floor: float, longest: int, max_iter: int, tol: float) -> str:
    """CTEs up to `model` (it, p, t, e): left-to-right EM over `runs` (os: list of class numbers, mult). For WITH RECURSIVE.

    A run's steps are written out up to `longest`, so that one step of the recursion is
    one EM turn over all runs; longer runs make an error.
    """
    n, m, steps = len(start), len(emit[0]), range(1, longest + 1)
    states = range(n)
    number = lambda v: f"{float(v)!r}::DOUBLE"
    listed = lambda values: "[" + ", ".join(map(number, values)) + "]"
    p, t, e = (lambda j: f"p[{j + 1}]"), (lambda i, j: f"t[{i * n + j + 1}]"), (lambda j, u: f"e[{j * m} + os[{u}] + 1]")
    made = "(SELECT r.os, r.mult, len(r.os) AS len, g.* FROM model g, disc r WHERE NOT done)"

    def add(columns: dict[str, str]) -> None:
        nonlocal made
        made = f"(SELECT *, {', '.join(f'{sql} AS {name}' for name, sql in columns.items())} FROM {made})"

    for u in steps:
        ahead = [p(j) if u == 1 else "(" + " + ".join(f"a{u - 1}_{i} * {t(i, j)}" for i in states) + ")" for j in states]
        add({f"x{u}_{j}": f"CASE WHEN len >= {u} THEN {ahead[j]} * {e(j, u)} END" for j in states})
        add({f"c{u}": f"CASE WHEN len >= {u} THEN greatest({' + '.join(f'x{u}_{j}' for j in states)}, {number(floor)}) END"})
        add({f"a{u}_{j}": f"x{u}_{j} / c{u}" for j in states})
    for u in reversed(steps):
        later = ["NULL" if u == longest else "(" + " + ".join(f"{t(i, j)} * w{u + 1}_{j}" for j in states) + f") / c{u + 1}" for i in states]
        add({f"z{u}_{j}": f"CASE WHEN len = {u} THEN 1.0::DOUBLE WHEN len > {u} THEN {later[j]} END" for j in states})
        add({f"w{u}_{j}": f"{e(j, u)} * z{u}_{j}" for j in states})
        add({f"s{u}": f"greatest({' + '.join(f'a{u}_{j} * z{u}_{j}' for j in states)}, {number(floor)})"})
    add({f"g{u}_{j}": f"a{u}_{j} * z{u}_{j} / s{u}" for u in steps for j in states})
    add({f"y{u}": "greatest(" + " + ".join(f"a{u - 1}_{i} * {t(i, j)} * w{u}_{j}" for i in states for j in states) + f", {number(floor)})" for u in steps if u > 1})
    total = lambda terms: "coalesce(sum(mult * (" + " + ".join(f"coalesce({x}, 0)" for x in terms) + ")), 0)"
    sums = {"own": total([f"ln(c{u})" for u in steps])}
    sums |= {f"n_p{j}": total([f"g1_{j}"]) for j in states}
    moves = {(i, j): total([f"a{u - 1}_{i} * {t(i, j)} * w{u}_{j} / y{u}" for u in steps if u > 1] or ["0"]) for i in states for j in states}
    sums |= {f"n_t{i}_{j}": sql for (i, j), sql in moves.items()}
    sums |= {f"n_e{j}_{c}": total([f"CASE WHEN os[{u}] = {c} THEN g{u}_{j} END" for u in steps]) for j in states for c in range(m)}
    gathered = f"(SELECT it, any_value(before) AS before, {', '.join(f'{sql} AS {name}' for name, sql in sums.items())} FROM {made} GROUP BY it)"

    def normal(cells: list[str]) -> list[str]:
        return [f"({c}) / ({' + '.join(f'({x})' for x in cells)})" for c in cells]

    def moved(i: int) -> list[str]:
        held = [f"n_t{i}_{j} + {number(smoothing)}" if j >= i else "0.0::DOUBLE" for j in states]
        if i + 1 < n:
            held[i + 1] = f"greatest({held[i + 1]}, {number(min_forward)})"
        return normal(held)

    new_p = normal([f"n_p{j} + {number(smoothing)}" for j in states])
    new_t = [x for i in states for x in moved(i)]
    new_e = [x for j in states for x in normal([f"n_e{j}_{c} + {number(smoothing)}" for c in range(m)])]
    flat = lambda table: [v for row in table for v in row]
    return f"""disc AS MATERIALIZED (SELECT CASE WHEN len(os) > {longest} THEN error('run too long') ELSE os END AS os, count(*)::DOUBLE AS mult FROM {runs} GROUP BY os),
model AS (
  SELECT 0 AS it, {listed(start)} AS p, {listed(flat(trans))} AS t, {listed(flat(emit))} AS e, NULL::DOUBLE AS before, FALSE AS done
  UNION ALL
  SELECT it + 1, [{', '.join(new_p)}], [{', '.join(new_t)}], [{', '.join(new_e)}], own, it + 1 >= {max_iter} OR coalesce(abs(own - before) < {tol!r}, FALSE)
  FROM {gathered})"""
