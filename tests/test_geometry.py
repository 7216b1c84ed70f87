"""Thinning, directions and continuations against plain loops over cells, written from the rules."""

import itertools
import math

import numpy as np
import pytest

from gridloom.operators import geometry

E, NE, N, NW, W, SW, S, SE = range(8)
AROUND = [(0, 1), (-1, 1), (-1, 0), (-1, -1), (0, -1), (1, -1), (1, 0), (1, 1)]


def plain_thinning(cells):
    """The set of cells that thinning leaves: half passes over all cells at once until a whole pass clears none."""
    cells, changed = set(cells), True
    while changed:
        changed = False
        for threes in (((E, N, W), (N, W, S)), ((E, N, S), (E, W, S))):
            gone = set()
            for r, c in cells:
                ring = [(r + dr, c + dc) in cells for dr, dc in AROUND]
                turns = sum(not a and b for a, b in zip(ring, ring[1:] + ring[:1]))
                if 2 <= sum(ring) <= 6 and turns == 1 and not any(all(ring[i] for i in three) for three in threes):
                    gone.add((r, c))
            cells -= gone
            changed |= bool(gone)
    return cells


def test_thinning_by_hand():
    """A bar of two rows: the first half pass asks that one of north, west and south be empty, so it takes the lower row, and the ends of the upper after it."""
    bar = {(r, c) for r in (0, 1) for c in range(6)}
    want = plain_thinning(bar)
    mask = np.zeros((2, 6), bool)
    mask[:] = True
    found = set(zip(*(x.tolist() for x in np.nonzero(geometry.thin(mask)))))
    assert found == want and len({r for r, _ in want}) == 1
    assert geometry.thin(np.ones((1, 5), bool)).all()


@pytest.mark.parametrize("density", [0.3, 0.5, 0.7, 0.9])
def test_thinning_of_random_masks(density):
    r = np.random.default_rng(int(density * 10))
    for _ in range(12):
        mask = r.random((17, 23)) < density
        found = set(zip(*(x.tolist() for x in np.nonzero(geometry.thin(mask)))))
        assert found == plain_thinning(set(zip(*(x.tolist() for x in np.nonzero(mask)))))


def plain_tips(cells):
    return [x for x in sorted(cells) if sum((x[0] + a, x[1] + b) in cells for a, b in AROUND) == 1]


def plain_direction(cells, tip, window):
    near = np.array([(r, c) for r, c in cells if max(abs(r - tip[0]), abs(c - tip[1])) <= window])
    if len(near) < 3:
        return None
    values, vectors = np.linalg.eigh(np.cov((near - tip).T.astype(float)))
    dy, dx = vectors[:, values.argmax()].round(12)
    if (near - tip).mean(axis=0) @ (dy, dx) > 0:
        dy, dx = -dy, -dx
    if not any((int(tip[0] - k * dy), int(tip[1] - k * dx)) in cells for k in (1, 2, 3)):
        dy, dx = -dy, -dx
    return dy, dx


def test_directions_against_eigenvectors(spark):
    r = np.random.default_rng(3)
    cells = plain_thinning({(int(a) + i // 3, int(b) + i) for a, b in r.integers(40, 200, (14, 2)) for i in range(9)})
    rows = spark.createDataFrame(sorted(cells), "row long, col long")
    found = {(x.row, x.col): (x.dy, x.dx) for x in geometry.orientations(geometry.endpoints(rows), rows, 7).collect()}
    want = {t: d for t in plain_tips(cells) if (d := plain_direction(cells, t, 7))}
    assert set(found) == set(want) and len(found) > 10
    for tip, d in want.items():
        assert np.allclose(found[tip], d, atol=1e-9)


def all_paths(p, valid, start, direction, steps):
    """Every path of every length with its cost; the headings are counted from the east, clockwise on the page."""
    turnable = [(0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1), (-1, 0), (-1, 1)]
    first = round(math.atan2(*direction) / (math.pi / 4)) % 8
    for n in range(1, steps + 1):
        for turns in itertools.product((-1, 0, 1), repeat=n):
            at, k, path, cost = start, first, [], 0.0
            for t in turns:
                k = (k + t) % 8
                at = (at[0] + turnable[k][0], at[1] + turnable[k][1])
                if not (0 <= at[0] < p.shape[0] and 0 <= at[1] < p.shape[1]) or not valid[at] or p[at] < 0.3 or at in path or at == start:
                    break
                path.append(at)
                cost += -math.log(p[at] + 1e-6) + 0.5 * (t * math.pi / 4) ** 2
            else:
                yield n, cost, path


def test_curved_continuation_against_all_paths(spark):
    """A beam that leaves no path out paints the cheapest of the longest paths; valid cells only, over the skeleton too, from the threshold down."""
    r = np.random.default_rng(9)
    p = r.random((30, 34)) * 0.55
    for a, b in r.integers(3, 26, (9, 2)):
        for i in range(7):
            p[min(29, a + i // 2), min(33, b + i)] = 0.7 + 0.02 * i
    valid = r.random(p.shape) < 0.93
    skeleton = plain_thinning({(i, j) for i, j in np.ndindex(p.shape) if valid[i, j] and p[i, j] >= 0.6})
    ends = plain_tips(skeleton)
    mean = {t: round(float(p[max(0, t[0] - 1) : t[0] + 2, max(0, t[1] - 1) : t[1] + 2].mean()), 9) for t in ends}
    want, painted = p.copy(), 0
    for tip in sorted(ends, key=lambda t: (-mean[t], t))[:12]:
        d = plain_direction(skeleton, tip, 15)
        paths = [x for x in all_paths(p, valid, tip, d, 4) if x[0] >= 2] if d else []
        if paths:
            path = min(paths, key=lambda x: (-x[0], x[1]))[2]
            if np.mean([p[x] for x in path]) >= 0.4:
                painted += 1
                for k, x in enumerate(path):
                    want[x] = max(want[x], 0.6 * math.exp(-0.15 * k))
    assert painted > 3
    cells = spark.createDataFrame([(i, j, float(p[i, j]), bool(valid[i, j])) for i, j in np.ndindex(p.shape)], "row long, col long, p double, valid boolean")
    out, counts = geometry.curved_continuation(cells, 0.6, steps=4, width=81, shortest=2, most=12)
    found = np.zeros(p.shape)
    for x in out.collect():
        found[x.row, x.col] = x.p
    assert np.allclose(found, want, atol=1e-12) and (found > p + 1e-9).any()
    one = counts.first()
    assert (one.skeleton_pixels, one.endpoints, one.budget, one.max_steps) == (len(skeleton), len(ends), 12, 4)
    with pytest.raises(ValueError, match="window must be odd"):
        geometry.curved_continuation(cells, 0.6, window=4)
    with pytest.raises(ValueError, match="threshold"):
        geometry.curved_continuation(cells, 1.0)


def test_extension_stops_without_edge_support(spark):
    rows = [(0, c, 0.8 if c < 3 else 0.1, c < 3, 0.2 if c == 6 else 0.9) for c in range(10)]
    cells = spark.createDataFrame(rows, "row long, col long, p double, skeleton boolean, edge double")
    tips = spark.createDataFrame([(0, 2, 0.0, 1.0)], "row long, col long, dy double, dx double")
    free = {x.col: x.p for x in geometry.extend(tips, cells, 6).collect()}
    assert sorted(free) == [3, 4, 5, 6, 7, 8] and free[3] == pytest.approx(0.8 * math.exp(-0.1))
    assert sorted(x.col for x in geometry.extend(tips, cells, 6, edge="edge").collect()) == [3, 4, 5]
    assert sorted(x.col for x in geometry.extend(tips, cells, 6, edge="edge", edge_least=0.1).collect()) == [3, 4, 5, 6, 7, 8]
    half = spark.createDataFrame([(0, 2, 0.0, 0.5)], "row long, col long, dy double, dx double")
    assert sorted(x.col for x in geometry.extend(half, cells.withColumn("skeleton", cells.col < 2), 5).collect()) == [2, 3, 4]  # 2.5 and 4.5 go to even places


def test_cells_are_never_broadcast(spark):
    cells = spark.range(400).selectExpr("id div 20 as row", "id % 20 as col", "0.5 as p", "id div 20 = 4 and id % 20 < 9 as skeleton", "1.0 as edge")
    skeleton = cells.where("skeleton")
    tips = geometry.orientations(geometry.endpoints(skeleton), skeleton, 5, 0.5, 20, 20)
    out = geometry.extend(tips, cells, 3, edge="edge")
    assert "BroadcastHashJoin" not in out._jdf.queryExecution().executedPlan().toString()
    assert sorted((x.row, x.col) for x in out.collect()) == [(4, 9), (4, 10), (4, 11)]
