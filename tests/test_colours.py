import itertools
import random
import time

import numpy as np

from psephos.operators import cluster
from psephos.operators.grouping import five_colours


def planar(n, seed):
    """Points joined in order of distance where no earlier line is crossed."""
    rnd = random.Random(seed)
    at = [(rnd.random(), rnd.random()) for _ in range(n)]
    turn = lambda p, q, r: (q[0] - p[0]) * (r[1] - p[1]) - (q[1] - p[1]) * (r[0] - p[0])
    cross = lambda a, b, c, d: not {a, b} & {c, d} and turn(at[a], at[b], at[c]) * turn(at[a], at[b], at[d]) < 0 > turn(at[c], at[d], at[a]) * turn(at[c], at[d], at[b])
    lines = []
    for a, b in sorted(itertools.combinations(range(n), 2), key=lambda e: (at[e[0]][0] - at[e[1]][0]) ** 2 + (at[e[0]][1] - at[e[1]][1]) ** 2):
        if not any(cross(a, b, c, d) for c, d in lines):
            lines.append((a, b))
    near = {i: set() for i in range(n)}
    for a, b in lines:
        near[a].add(b), near[b].add(a)
    return near


def test_five_colours_do_for_planar_graphs():
    for seed in range(12):
        near = planar(45, seed)
        assert sum(map(len, near.values())) / 2 > 2.5 * len(near)  # as many lines as planes allow, nearly
        found = five_colours(near)
        assert set(found) == set(near) and all(found[i] != found[j] for i in near for j in near[i]) and max(found.values()) < 5


def test_dense_styles_end_soon():
    all_ = {i: set(range(40)) - {i} for i in range(40)}
    began = time.time()
    assert five_colours(all_) is None and five_colours({}) == {} and five_colours(all_, 40) is not None
    assert time.time() - began < 5


def test_colours_are_exchanged():
    """A wheel's hub meets all colours of its rim before an exchange, whatever was chosen first."""
    rnd = random.Random(4)
    for _ in range(200):
        n = rnd.randint(4, 9)
        near = {i: {(i + 1) % n, (i - 1) % n} for i in range(n)}
        for colours, ok in ((3, n % 2 == 0), (4, True)):
            wheel = {i: own | {n} for i, own in near.items()} | {n: set(range(n))}
            found = five_colours(wheel, colours)
            assert found is None or all(found[i] != found[j] for i in wheel for j in wheel[i])
            assert found is not None or not ok or colours == 3


def test_distortion_against_pixels():
    def plain(a, b, m):
        total = 0.0
        for i, j in np.ndindex(a.shape):
            near = np.abs(a[i, j] - b[max(0, i - m) : min(a.shape[0] - 1, i + m), max(0, j - m) : min(a.shape[1] - 1, j + m)])
            near = near[~np.isnan(near)]
            total += near.min() if len(near) else 0.0
        return total

    rng = np.random.default_rng(2)
    for h, w, m in ((8, 8, 3), (5, 9, 1), (2, 2, 3), (1, 6, 2)):
        a, b = rng.random((2, h, w))
        a[rng.random(a.shape) < 0.1] = np.nan
        b[rng.random(b.shape) < 0.2] = np.nan
        assert np.isclose(cluster.image_distortion(a, b, m), plain(a, b, m))
