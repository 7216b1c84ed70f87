"""SQL of the stencils over the canonical raster: separable kernels as joins on clamped or mirrored places."""

from __future__ import annotations

from gridloom.plans.raster import RASTER

LAST_COL = 63
LAST_ROW = "(SELECT max(row) FROM raster)"


def _reach(sigma: float) -> int:
    return int(4 * sigma + 0.5)


def _place(at: str, last: str, mirrored: bool) -> str:
    if mirrored:
        return f"CASE WHEN {at} < 0 THEN -({at}) - 1 WHEN {at} > {last} THEN 2 * {last} + 1 - ({at}) ELSE {at} END"
    return f"least(greatest({at}, 0), {last})"


def smooth(out: str, source: str, sigma: float, x: str = "x", masked: bool = True) -> str:
    """CTE ``out`` (row, col, valid, x): the Gaussian of ``x``; masked: over valid cells and clamped, else mirrored at the edges."""
    r, s = _reach(sigma), f"{sigma!r}::DOUBLE"
    bell = f"exp(-0.5 * ((range - {r}) / {s}) ** 2)"
    n, d = (f"CASE WHEN valid THEN {x} ELSE 0 END", "valid::INT") if masked else (x, "1")
    return f"""{out}_k AS MATERIALIZED (SELECT range - {r} AS d, {bell} / (SELECT sum({bell}) FROM range({2 * r + 1})) AS k FROM range({2 * r + 1})),
{out}_s AS MATERIALIZED (SELECT row, col, valid, {n} AS n, {d} AS d FROM {source}),
{out}_h AS MATERIALIZED (SELECT a.row, a.col, a.valid, sum(k.k * b.n) AS n, sum(k.k * b.d) AS d FROM {out}_s a CROSS JOIN {out}_k k JOIN {out}_s b ON b.row = a.row AND b.col = {_place("a.col + k.d", str(LAST_COL), not masked)} GROUP BY ALL),
{out}_p AS MATERIALIZED (SELECT a.row, a.col, a.valid, {_place("a.row + k.d", "h.h", not masked)} AS at, k.k FROM {out}_s a CROSS JOIN {out}_k k CROSS JOIN (SELECT max(row) AS h FROM raster) h),
{out} AS MATERIALIZED (SELECT a.row, a.col, a.valid, CASE WHEN sum(a.k * b.d) > 1e-6 THEN sum(a.k * b.n) / greatest(sum(a.k * b.d), 1e-6) ELSE 0 END AS x FROM {out}_p a JOIN {out}_h b ON b.row = a.at AND b.col = a.col GROUP BY ALL)"""


def gradient(out: str, source: str, x: str = "x") -> str:
    """CTE ``out`` (row, col, valid, gy, gx): central differences, one-sided at the edges."""
    side = lambda low, high: f"CASE WHEN {low} IS NOT NULL AND {high} IS NOT NULL THEN ({high} - {low}) / 2 WHEN {high} IS NOT NULL THEN {high} - x0 ELSE x0 - {low} END"
    return f"""{out}_n AS (SELECT row, col, valid, {x} AS x0, lag({x}) OVER d AS u, lead({x}) OVER d AS b, lag({x}) OVER a AS l, lead({x}) OVER a AS r FROM {source}
  WINDOW d AS (PARTITION BY col ORDER BY row), a AS (PARTITION BY row ORDER BY col)),
{out} AS MATERIALIZED (SELECT row, col, valid, {side("u", "b")} AS gy, {side("l", "r")} AS gx FROM {out}_n)"""


def edges(out: str, source: str, epsilon: float, lam: float) -> str:
    """CTE ``out`` (row, col, valid, x): edge strength of column x of ``source``, by the greatest of the cells with fold <> 0."""
    sigma = max(0.5, epsilon)
    return f"""{smooth(out + "_g", source, sigma, masked=False)},
{out}_l AS (SELECT row, col, valid, abs(coalesce(lag(x) OVER d, x) + coalesce(lead(x) OVER d, x) + coalesce(lag(x) OVER a, x) + coalesce(lead(x) OVER a, x) - 4 * x) AS x FROM {out}_g
  WINDOW d AS (PARTITION BY col ORDER BY row), a AS (PARTITION BY row ORDER BY col)),
{out}_m AS (SELECT max(x) AS m FROM {out}_l JOIN raster USING (row, col) WHERE fold <> 0),
{out}_t AS MATERIALIZED (SELECT row, col, valid, tanh(x / CASE WHEN m > 0 THEN m ELSE 1 END * 10 * (1 + {lam!r}::DOUBLE)) AS x FROM {out}_l, {out}_m),
{smooth(out, out + "_t", 0.3 * sigma, masked=False)}"""


def scaled(source: str, name: str, low: int) -> str:
    return f"""SELECT row, col, round(greatest({low}, least(1, x / stat)), 6) + 0.0 AS {name} FROM {source}, (SELECT quantile_cont(abs(s.x), 0.99) AS stat FROM {source} s JOIN raster r USING (row, col) WHERE r.valid AND fold <> 0)"""


HEAD = f"WITH {RASTER}, base AS MATERIALIZED (SELECT row, col, valid, v AS x, v, p FROM raster), "

GAUSSIAN = HEAD + smooth("s", "base", 1.0) + " SELECT row, col, round(x, 6) + 0.0 AS smooth FROM s"

TENSOR = HEAD + ", ".join([smooth("s", "base", 1.0), gradient("g", "s"), smooth("xx", "g", 2.0, "gx * gx"), smooth("yy", "g", 2.0, "gy * gy"), smooth("xy", "g", 2.0, "gx * gy")]) + """
SELECT row, col, round(CASE WHEN xx.valid THEN least(1, greatest(0, sqrt(greatest((xx.x + yy.x) ** 2 - 4 * (xx.x * yy.x - xy.x * xy.x), 0)) / (xx.x + yy.x + 1e-6))) ELSE 0 END, 6) + 0.0 AS coherence,
round(CASE WHEN xx.valid THEN 0.5 * atan2(2 * xy.x, xx.x - yy.x) ELSE 0 END, 6) + 0.0 AS orientation FROM xx JOIN yy USING (row, col) JOIN xy USING (row, col)"""


def _curvature(k: int, scale: float, window: float) -> list[str]:
    return [
        smooth(f"s{k}", "base", scale), gradient(f"g{k}", f"s{k}"), gradient(f"a{k}", f"g{k}", "gx"), gradient(f"b{k}", f"g{k}", "gy"),
        smooth(f"xx{k}", f"a{k}", window, "gx"), smooth(f"yy{k}", f"b{k}", window, "gy"), smooth(f"xy{k}", f"a{k}", window, "gy"),
        f"c{k} AS MATERIALIZED (SELECT row, col, xx{k}.valid, (xx{k}.x + yy{k}.x) / 2 AS half, sqrt(greatest(((xx{k}.x - yy{k}.x) / 2) ** 2 + xy{k}.x ** 2, 0)) AS root FROM xx{k} JOIN yy{k} USING (row, col) JOIN xy{k} USING (row, col))",
    ]


RIDGES = HEAD + ", ".join([*_curvature(1, 1.0, 1.0), *_curvature(2, 2.0, 1.0)]) + """,
response AS MATERIALIZED (SELECT row, col, CASE WHEN c1.valid THEN greatest(2 * c1.root * greatest(c1.half + c1.root, 0), 2 * c2.root * greatest(c2.half + c2.root, 0))
  - greatest(2 * c1.root * greatest(c1.root - c1.half, 0), 2 * c2.root * greatest(c2.root - c2.half, 0)) ELSE 0 END AS x FROM c1 JOIN c2 USING (row, col))
""" + scaled("response", "response", -1)

STEERABLE = HEAD + smooth("s", "base", 1.0) + f""",
taps AS (SELECT a.range AS angle, y.range - 3 AS dy, x.range - 3 AS dx, (x.range - 3) * cos(pi() * a.range / 4) + (y.range - 3) * sin(pi() * a.range / 4) AS u,
  (y.range - 3) * cos(pi() * a.range / 4) - (x.range - 3) * sin(pi() * a.range / 4) AS w FROM range(4) a, range(7) y, range(7) x),
waves AS (SELECT angle, dy, dx, exp(-(u * u + (0.5 * w) ** 2) / (2 * (6 / (2 * pi() * 0.56)) ** 2)) * cos(2 * pi() * u / 6) AS k FROM taps),
kernels AS MATERIALIZED (SELECT angle, dy, dx, k - avg(k) OVER (PARTITION BY angle) AS k FROM waves),
spots AS MATERIALIZED (SELECT a.row, a.col, a.valid, k.angle, k.k, least(greatest(a.row + k.dy, 0), h.h) AS r, least(greatest(a.col + k.dx, 0), {LAST_COL}) AS c FROM s a CROSS JOIN kernels k CROSS JOIN (SELECT max(row) AS h FROM raster) h),
turned AS (SELECT a.row, a.col, a.valid, a.angle, abs(sum(a.k * b.x)) AS x FROM spots a JOIN s b ON b.row = a.r AND b.col = a.c GROUP BY ALL),
response AS MATERIALIZED (SELECT row, col, CASE WHEN valid THEN max(x) ELSE 0 END AS x FROM turned GROUP BY row, col, valid)
""" + scaled("response", "response", 0)

LOG_EDGES = HEAD + f"""cuts AS (SELECT quantile_cont(v, 0.02) AS lo, quantile_cont(v, 0.98) AS hi FROM raster WHERE valid AND fold <> 0),
clipped AS MATERIALIZED (SELECT row, col, valid, least(1, greatest(0, (v - lo) / (hi - lo))) AS x FROM base, cuts),
{smooth("s", "clipped", 1.0)}, {gradient("g", "s")}, steep AS (SELECT row, col, valid, sqrt(gy * gy + gx * gx) AS x FROM g),
top AS (SELECT max(s.x) AS m FROM steep s JOIN raster r USING (row, col) WHERE r.valid AND fold <> 0),
norm AS MATERIALIZED (SELECT row, col, valid, x / m AS x FROM steep, top), {edges("e", "norm", 1.0, 0.1)}
SELECT row, col, round(x, 6) + 0.0 AS edge FROM e"""

MULTIBAND = HEAD + f"""bv AS MATERIALIZED (SELECT row, col, valid, CASE WHEN valid THEN v ELSE 0 END AS x FROM base), bp AS MATERIALIZED (SELECT row, col, valid, CASE WHEN valid THEN p ELSE 0 END AS x FROM base),
{edges("ev", "bv", 1.0, 0.1)}, {edges("ep", "bp", 1.0, 0.1)}
SELECT row, col, round(least(1, (ev.x + ep.x) / 2), 6) + 0.0 AS edge FROM ev JOIN ep USING (row, col)"""

PHASE = HEAD + ", ".join([smooth("sv", "base", 1.0), gradient("gv", "sv"), smooth("sp", "base", 1.0, "p"), gradient("gp", "sp")]) + """,
energy AS (SELECT row, col, gv.valid, sqrt((gv.gy ** 2 + gv.gx ** 2 + gp.gy ** 2 + gp.gx ** 2) / 2) AS e FROM gv JOIN gp USING (row, col))
SELECT row, col, round(CASE WHEN valid THEN 4 * e / (1 + 4 * e) ELSE 0 END, 6) + 0.0 AS both FROM energy"""


def _pool(out: str, source: str, x: str, f: str) -> str:
    pick = "least" if f == "min" else "greatest"
    across = f"{out}_a AS (SELECT row, col, {pick}({f}({x}) OVER (PARTITION BY row ORDER BY col ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), CASE WHEN col IN (0, {LAST_COL}) THEN 0 END) AS x FROM {source})"
    return f"{across}, {out} AS MATERIALIZED (SELECT row, col, {pick}({f}(x) OVER (PARTITION BY col ORDER BY row ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), CASE WHEN row IN (0, {LAST_ROW}) THEN 0 END) AS x FROM {out}_a)"


def _skeleton(name: str, source: str, iterations: int = 5) -> str:
    steps, hats, now = [], [], source
    for i in range(iterations + 1):
        low, high = f"{name}_e{i}", f"{name}_d{i}"
        steps += [_pool(low, now, "x", "min"), _pool(high, low, "x", "max")]
        hats.append(f"SELECT a.row, a.col, greatest(a.x - b.x, 0) AS x FROM {now} a JOIN {high} b USING (row, col)")
        now = low
    return f"{', '.join(steps)}, {name} AS MATERIALIZED (SELECT row, col, least(1, greatest(0, sum(x))) AS x FROM ({' UNION ALL '.join(hats)}) GROUP BY row, col)"


SKELETONS = HEAD + f"""p0 AS MATERIALIZED (SELECT row, col, CASE WHEN valid THEN p ELSE 0 END AS x FROM base), t0 AS MATERIALIZED (SELECT row, col, (valid AND truth)::INT::DOUBLE AS x FROM raster),
{_skeleton("soft", "p0")}, {_skeleton("hard", "t0")}, skeletons AS (SELECT row, col, soft.x AS soft, (hard.x > 0.5)::INT::DOUBLE AS target FROM soft JOIN hard USING (row, col))"""
SOFT = SKELETONS + " SELECT row, col, round(soft, 6) + 0.0 AS soft, round(target, 6) + 0.0 AS target FROM skeletons"
RECALL = SKELETONS + " SELECT round(CASE WHEN sum(target) > 0 THEN least(1, greatest(0, 1 - sum(soft * target) / (sum(target) + 1e-12))) ELSE 0 END, 6) + 0.0 AS loss, sum(target) AS target_cells FROM skeletons"
