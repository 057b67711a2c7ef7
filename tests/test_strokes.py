import numpy as np
import pytest
from pyspark.sql import functions as F

from psephos.operators import patches, strokes


def page(boxes, targets=(), h=420, w=320, broken=True, noise=0.05, seed=1):
    rng = np.random.default_rng(seed)
    a = np.ones((h, w))
    for x1, y1, x2, y2 in boxes:
        a[y1 : y1 + 2, x1 : x2 + 2] = a[y2 : y2 + 2, x1 : x2 + 2] = 0
        a[y1 : y2 + 2, x1 : x1 + 2] = a[y1 : y2 + 2, x2 : x2 + 2] = 0
        if broken:
            for k in (0, 1):  # a gap of a few pixels in each half of each side
                x, y = (int(rng.integers(a1 + 12 + k * (a2 - a1) // 2, a1 - 12 + (k + 1) * (a2 - a1) // 2)) for a1, a2 in ((x1, x2), (y1, y2)))
                a[y1 : y1 + 2, x : x + 3] = a[y2 : y2 + 2, x + 2 : x + 5] = 1
                a[y : y + 3, x1 : x1 + 2] = a[y + 2 : y + 5, x2 : x2 + 2] = 1
    for x1, y1, x2, y2 in targets:
        a[y1:y2, x1:x2] = 0.2
    return np.clip(a + rng.normal(0, noise, a.shape), 0, 1)


def plain_runs(mask, piece, gap, least):
    out = []
    for y, row in enumerate(mask):
        found, x = [], 0
        while x < len(row):
            e = x
            while e < len(row) and row[e]:
                e += 1
            if e - x >= piece:
                if found and x - found[-1][1] <= gap:
                    found[-1][1] = e
                else:
                    found.append([x, e])
            x = max(e, x + 1)
        out += [(y, s, e) for s, e in found if e - s >= least]
    return out


def test_runs_against_a_walk():
    rng = np.random.default_rng(3)
    for density in (0.5, 0.8, 0.95, 1.0):
        mask = rng.random((20, 90)) < density
        assert list(zip(*(c.tolist() for c in strokes.dark_runs(mask, 3, 2, 8)))) == plain_runs(mask, 3, 2, 8)
    assert [len(c) for c in strokes.dark_runs(np.zeros((5, 5), bool))] == [0, 0, 0]


def test_components_against_a_search():
    rng = np.random.default_rng(4)
    for n, m in ((1, 0), (30, 20), (200, 150)):
        a, b = rng.integers(0, n, m), rng.integers(0, n, m)
        near = {i: {i} for i in range(n)}
        for i, j in zip(a.tolist(), b.tolist()):
            near[i].add(j), near[j].add(i)
        least = []
        for i in range(n):
            seen, todo = {i}, [i]
            while todo:
                for j in near[todo.pop()] - seen:
                    seen.add(j), todo.append(j)
            least.append(min(seen))
        assert strokes.roots(n, a, b).tolist() == least


def test_strokes_follow_a_slant_and_leave_areas():
    mask = np.zeros((120, 300), bool)
    for x in range(20, 280):
        y = 30 + x // 60  # falls by four rows
        mask[y : y + 2, x] = True
    mask[60:110, 40:200] = True
    ((x1, x2, row),) = strokes.strokes(mask)
    assert (x1, x2) == (20, 280) and 31 <= row <= 33


def test_pieces_are_merged():
    assert strokes.merged([], 100) == []
    one = strokes.merged([(10, 110, 50), (113, 200, 52), (150, 220, 51), (10, 110, 70)], 400)
    assert len(one) == 2 and sorted(x[2] for x in one)[0] in (50, 51) and max(x[1] for x in one) >= 220
    apart = strokes.merged([(10, 60, 50), (90, 150, 50)], 400)
    assert len(apart) == 2


def test_inside_of_solid_areas_is_cleared():
    a = np.ones((400, 400))
    a[40:240, 40:240] = 0
    a[300:302, 20:380] = 0
    mask = strokes.cleared(a)
    assert not mask[100:180, 100:180].any() and mask[300:302, 20:380].all()
    assert [m[0] for m in strokes.page_lines(a)].count("H") == 1


def test_contests_in_each_other_are_one():
    inner, outer, other = (20, 20, 60, 60), (10, 10, 100, 100), (200, 10, 260, 60)
    t = [(30, 30, 40, 40), (70, 70, 80, 80), (210, 20, 220, 30)]
    assert strokes.settled([inner, outer, other], t) == [other, outer]
    left, right = (10, 10, 70, 60), (50, 10, 110, 60)  # both hold the middle target, neither holds all
    assert strokes.settled([left, right], [(20, 20, 30, 30), (55, 20, 65, 30), (90, 20, 100, 30)]) == [(10, 10, 110, 60)]
    assert strokes.settled([inner], []) == [inner]


def test_boxes_below_each_other_are_one():
    boxes = [(10, 20 * k, 110, 20 * k + 18) for k in range(5)] + [(200, 0, 300, 18)]
    targets = [(15, 20 * k + 5, 25, 20 * k + 13) for k in range(5)] + [(205, 5, 215, 13)]
    assert sorted(strokes.stacked(boxes, targets)) == [(10, 0, 110, 98), (200, 0, 300, 18)]
    assert strokes.stacked(boxes[:2], targets) == boxes[:2]  # few boxes: contests as they are


@pytest.mark.parametrize("seed", range(6))
def test_drawn_pages_give_their_contests(spark, seed):
    rng = np.random.default_rng(seed)
    x = int(rng.integers(12, 30))
    boxes = [(x, 30 + 90 * k, 140, 100 + 90 * k) for k in range(3)] + [(170, 40, 280, 300), (180, 60, 270, 120)]
    targets = [(x + 8, 30 + 90 * k + d, x + 20, 38 + 90 * k + d) for k in range(3) for d in (20, 45)] + [(190, 80, 202, 88), (190, 200, 202, 208)]
    want = [(x, 30 + 90 * k, 140, 100 + 90 * k) for k in range(3) for _ in (0, 1)] + [(170, 40, 280, 300)] * 2
    pages = spark.createDataFrame([(7, patches.pack(page(boxes, targets, seed=seed)))], f"g long, patch {patches.PATCH}")
    t = spark.createDataFrame([(7, i, *b) for i, b in enumerate(targets)], "g long, target_id long, x1 long, y1 long, x2 long, y2 long")
    found = strokes.page_contests(pages, t, "g", 320, 420).orderBy("target_id").collect()
    assert [(r.x1, r.y1, r.x2, r.y2) for r in found] == want


def test_open_at_the_right_and_empty(spark):
    a = np.ones((200, 300))
    a[50:52, 20:298] = a[120:122, 20:298] = 0
    a[50:122, 20:22] = 0
    pages = spark.createDataFrame([(1, patches.pack(a)), (2, patches.pack(np.ones((200, 300))))], f"g long, patch {patches.PATCH}")
    t = spark.createDataFrame([(g, 0, 40, 80, 52, 88) for g in (1, 2)], "g long, target_id long, x1 long, y1 long, x2 long, y2 long")
    found = strokes.page_contests(pages, t, "g", 300, 200).collect()
    assert [(r.g, r.x1, r.y1, r.x2, r.y2) for r in found] == [(1, 20, 50, 280, 120)]
    assert strokes.page_contests(pages.where("g > 5"), t.where(F.lit(False)), "g", 300, 200).count() == 0
