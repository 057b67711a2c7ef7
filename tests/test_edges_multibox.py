import itertools
import math
import random

import numpy as np
from pyspark.sql import functions as F

from psephos.operators import contests, edges, patches
from psephos.operators.align import blurred


def plain_edges(image, low, high, blurs):
    a = blurred(image, blurs)
    h, w = a.shape
    at = lambda y, x: a[min(max(y, 0), h - 1), min(max(x, 0), w - 1)]
    size, way = {}, {}
    for y, x in itertools.product(range(h), range(w)):
        gx = sum(k * (at(y + d, x + 1) - at(y + d, x - 1)) for d, k in ((-1, 1), (0, 2), (1, 1)))
        gy = sum(k * (at(y + 1, x + d) - at(y - 1, x + d)) for d, k in ((-1, 1), (0, 2), (1, 1)))
        size[y, x], way[y, x] = math.hypot(gx, gy), round(math.atan2(gy, gx) * 4 / math.pi) % 4
    ridge = {}
    for (y, x), s in size.items():
        dy, dx = ((0, 1), (1, 1), (1, 0), (1, -1))[way[y, x]]
        if s >= size.get((y + dy, x + dx), -1) - 1e-12 and s > size.get((y - dy, x - dx), -1) + 1e-12:
            ridge[y, x] = s
    seen = {p for p, s in ridge.items() if s > high}
    todo = list(seen)
    while todo:
        y, x = todo.pop()
        for q in ((y + dy, x + dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1)):
            if q not in seen and ridge.get(q, 0) > low:
                seen.add(q), todo.append(q)
    return seen


def shapes(seed):
    rng, a = np.random.default_rng(seed), np.ones((40, 50))
    ys, xs = np.mgrid[0:40, 0:50]
    for _ in range(3):
        y, x, r = rng.integers(8, 32), rng.integers(8, 42), rng.integers(4, 9)
        a[(ys - y) ** 2 + (xs - x) ** 2 < r * r] = rng.choice([0.0, 0.3, 0.6])
    y, x = rng.integers(2, 20, 2)
    a[y : y + 12, x : x + 15] = 0.45
    return a + rng.normal(0, 0.02, a.shape)


def test_edges_of_drawn_shapes():
    for seed in range(8):
        a = shapes(seed)
        for low, high, blurs in ((0.4, 1.0, 2), (0.2, 0.9, 1), (0.05, 3.9, 0)):
            assert set(zip(*(c.tolist() for c in np.nonzero(edges.edges(a, low, high, blurs))))) == plain_edges(a, low, high, blurs)


def test_weak_edges_need_a_strong_one():
    a = np.ones((30, 60))
    a[:, 20:] = 0.75  # weak alone
    assert not edges.edges(a, 0.4, 1.0).any()
    a[:, 20:] -= np.linspace(0, 0.75, 30)[:, None]
    found = edges.edges(a, 0.4, 1.0)
    assert found[25].sum() == 1 and found[4].sum() == 1  # strong below; the weak one above goes on from it
    assert not edges.edges(np.ones((9, 9))).any() and edges.edges(np.zeros((1, 1))).shape == (1, 1)


def test_edges_of_patches(spark):
    a = shapes(1)
    df = spark.createDataFrame([(1, patches.pack(a)), (2, {"h": 3, "w": 9, "data": b"x"})], f"k int, patch {patches.PATCH}")
    bad = {r.k: (r.status, r.why) for r in patches.map_patch(df, lambda a: {"n": a.size}, "n long", message="why").collect()}
    assert bad[1] == ("ok", None) and bad[2][0] == "err" and bad[2][1].startswith("ValueError")
    rows = {r.k: r for r in edges.edge_patches(df).collect()}
    assert (patches.unpack(rows[1].edge.asDict()) == edges.edges(a)).all() and rows[1].n_edge == edges.edges(a).sum() and rows[2].status == "err"


def distance(a, b):
    def lev(s, t):
        row = list(range(len(t) + 1))
        for i, c in enumerate(s, 1):
            last, row[0] = row[0], i
            for j, e in enumerate(t, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (c != e))
        return row[-1]

    x, y = a[1:], b[1:]
    turns = [sum(lev(p, q) for p, q in zip(x, y[k:] + y[:k])) for k in range(len(y))]
    return (lev(a[0], b[0]) + min(turns)) / max(1, sum(map(len, a + b))), turns.index(min(turns))


def test_pairs_of_boxes_that_are_one_contest(spark):
    rnd = random.Random(3)
    parts = [["Measure A of the town", "Yes to it", "No to it"], ["Measure A goes on here", "Neither", "Write-in line"]]

    def misread(t):
        return "".join(rnd.choice("xyz") if rnd.random() < 0.05 else c for c in t)

    boxes, order = [], []
    for ballot in range(40):
        own = [[misread(t) for t in p] for p in parts] if ballot % 2 else [["Judge of the court", f"Ann {ballot}", "Bob Jones"], ["Mayor", "Cy", "Di"]]
        if ballot % 5 == 1:
            own[0][1:], own[1] = own[0][:0:-1], own[1][:1] + own[1][:0:-1]
        own.append(["Other", "One"])
        boxes += [(ballot, k, t) for k, t in enumerate(own)]
        order += [(ballot, k, k + 1) for k in range(2)]
    boxes += [(50, 0, ["T"]), (50, 1, [])]
    order += [(50, 0, 1), (51, 0, 1)]
    known = [(1, 0, 1), (3, 0, 1)]
    b = spark.createDataFrame(boxes, "ballot long, box long, texts array<string>")
    o, k = (spark.createDataFrame(x, "ballot long, a long, b long") for x in (order, known))
    text = {(i, j): t for i, j, t in boxes}
    want = []
    for (i, x, y), (m, p, q) in itertools.product(order, known):
        if (i, x) in text and len(text[i, x] + text[i, y]) == len(text[m, p] + text[m, q]):
            d, turn = distance(text[m, p] + text[m, q], text[i, x] + text[i, y])
            if d < 0.2:
                want.append((i, x, y, m, p, q, round(d, 9), turn))
    found = contests.multibox_pairs(b, o, k)
    got = [(r.ballot, r.a, r.b, r.known_ballot, r.known_a, r.known_b, round(r.distance, 9), r.turn) for r in found.collect()]
    assert sorted(got) == sorted(want) and len(want) > 20 and all(r[0] % 2 for r in want)
    into = {(r.ballot, r.box): r.into for r in contests.merged_boxes(b, found).collect()}
    assert all(into[i, 1] == 0 for i, *_ in want) and into[0, 1] == 1 and len(into) == len(boxes)
    assert contests.multibox_pairs(b, o, k.where(F.lit(False))).count() == 0
