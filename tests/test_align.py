import numpy as np
import pytest

from psephos.operators import align, patches, pixels


def form(h=240, w=200, seed=3):
    """A printed page: boxes, words and blots."""
    rng = np.random.default_rng(seed)
    a = np.ones((h, w))
    for _ in range(14):
        y, x = int(rng.integers(5, h - 40)), int(rng.integers(5, w - 60))
        k, m = int(rng.integers(10, 35)), int(rng.integers(20, 55))
        a[y : y + 2, x : x + m] = a[y + k : y + k + 2, x : x + m] = 0
        a[y : y + k, x : x + 2] = a[y : y + k, x + m : x + m + 2] = 0
    for _ in range(120):
        y, x = int(rng.integers(5, h - 8)), int(rng.integers(5, w - 14))
        a[y : y + 3, x : x + int(rng.integers(2, 9))] = 0.1
    return a


@pytest.mark.parametrize("degrees,dx,dy,scale", [(10, 30, 36, 1.0), (-10, -30, 20, 1.0), (4, 12, -35, 1.08), (-7, 0, 0, 0.92), (180, 5, -8, 1.0), (0, 0, 0, 1.0)])
def test_similarity_without_a_start(degrees, dx, dy, scale):
    """Ten degrees and 15 % of the page."""
    a = form()
    want = align.similar(dx, dy, degrees, scale, a.shape)
    rng = np.random.default_rng(1)
    scan = np.clip(pixels.affine(a, np.linalg.inv(want), 1.0) + rng.normal(0, 0.05, a.shape), 0, 1)
    found = align.global_similarity(scan, a)
    x, y, turn, grow = align.parts(found, a.shape)
    assert abs(x - dx) < 0.5 and abs(y - dy) < 0.5 and abs((turn - degrees + 180) % 360 - 180) < 0.2 and abs(grow - scale) < 0.005


def test_descent_alone_does_not_get_there():
    a = form()
    scan = pixels.affine(a, np.linalg.inv(align.similar(30, 36, 10, 1, a.shape)), 1.0)
    t = pixels.align_rigid(scan, a)
    assert max(abs(t[0] - 30), abs(t[1] - 36)) > 5


def test_parts_of_a_matrix():
    got = align.parts(align.similar(3, -4, 20, 1.1, (50, 70)), (50, 70))
    assert np.allclose(got, (3, -4, 20, 1.1))


def test_blank_pages_do_not_end_it():
    a = np.ones((60, 50))
    assert align.global_similarity(a, a).shape == (3, 3) and align.hough_angle(a) == 0.0
    assert align.phase_shift(a, a) == (0, 0)


def quadrants(a, moves):
    """Each quadrant drawn with a motion of its own."""
    h, w = a.shape
    out = np.ones(a.shape)
    for k, (dx, dy, turn) in enumerate(moves):
        moved = pixels.affine(a, pixels.rigid(dx, dy, turn, a.shape), 1.0)
        y, x = (k // 2) * h // 2, (k % 2) * w // 2
        out[y : y + h // 2, x : x + w // 2] = moved[y : y + h // 2, x : x + w // 2]
    return out


def voted(a, boxes, fills):
    a = a.copy()
    for (x1, y1, x2, y2), f in zip(boxes, fills):
        a[y1 - 2 : y2 + 2, x1 - 2 : x2 + 2] = 1
        a[y1 - 2 : y2 + 2, x1 - 2] = a[y1 - 2 : y2 + 2, x2 + 1] = a[y1 - 2, x1 - 2 : x2 + 2] = a[y2 + 1, x1 - 2 : x2 + 2] = 0
        a[y1:y2, x1:x2] = f
    return a


def test_targets_of_pages_warped_by_quadrant(spark):
    """Within 1 of the unwarped page; the page's alignment alone is further off."""
    a = form(320, 280, 5)
    boxes = [(30 + 60 * c, 30 + 70 * r, 42 + 60 * c, 38 + 70 * r) for r in range(4) for c in range(4)]
    blank = voted(a, boxes, [1.0] * 16)
    fills = [0.1 * (k % 8) + 0.2 for k in range(16)]
    scan = quadrants(voted(a, boxes, fills), [(1, 2, 0.2), (-2, 1, -0.3), (2, -1, 0.3), (-1, -2, 0)])
    want = np.array(fills) * 255
    inner = [(x1 + 2, y1 + 2, x2 - 2, y2 - 2) for x1, y1, x2, y2 in boxes]
    got = align.read_targets(scan, blank, inner)
    assert [i for i, *_ in got] == list(range(16))
    off = np.abs(np.array([p.mean() * 255 for _, p, _, _ in got]) - want)
    assert off.max() < 1
    x1, y1, *_ = got[0][2]
    assert abs(x1 - inner[0][0] - 1) <= 1 and abs(y1 - inner[0][1] - 2) <= 1  # where it lies in the scan
    df = spark.createDataFrame([(1, patches.pack(scan))], f"k int, patch {patches.PATCH}")
    rows = align.extract_by_cells(df, blank, inner).orderBy("target_id").collect()
    assert len(rows) == 16 and max(abs(r.intensity - w) for r, w in zip(rows, want)) < 1


def test_search_then_alignment():
    a = form(120, 120, 8)
    patch = a[40:70, 30:80]
    scan = pixels.affine(a, pixels.rigid(4, -3, 2.0, a.shape), 1.0)
    x, y, score, got = align.find_and_align(scan, patch, (30, 40, 80, 70))
    plain = pixels.find_near(scan, patch, (30, 40, 80, 70))[2]
    assert score > plain and score > 0.85 and got.shape == patch.shape


@pytest.mark.parametrize("angle", [-3.7, -1.25, 0.0, 0.4, 2.05, 3.9])
def test_angle_of_drawn_lines(angle):
    """To a tenth of a degree, with noise and words between the lines."""
    a = np.ones((420, 360))
    for y in range(40, 400, 60):
        a[y : y + 2, 30:330] = 0
    for x in (30, 120, 240, 328):
        a[40:342, x : x + 2] = 0
    rng = np.random.default_rng(int(abs(angle) * 100))
    for _ in range(300):
        y, x = int(rng.integers(45, 390)), int(rng.integers(35, 315))
        a[y : y + 3, x : x + int(rng.integers(2, 9))] = 0.1
    scan = np.clip(pixels.affine(a, pixels.rigid(0, 0, angle, a.shape), 1.0) + rng.normal(0, 0.08, a.shape), 0, 1)
    assert abs(align.hough_angle(scan) - angle) <= 0.1


def test_pages_are_turned_straight(spark):
    a = np.ones((200, 200))
    a[50:52, 20:180] = a[150:152, 20:180] = 0
    scan = pixels.affine(a, pixels.rigid(0, 0, 3.0, a.shape), 1.0)
    (row,) = align.straightened(spark.createDataFrame([(1, patches.pack(scan))], f"k int, patch {patches.PATCH}")).collect()
    assert abs(row.angle - 3) <= 0.1 and abs(align.hough_angle(patches.unpack(row.patch.asDict()))) <= 0.2


def plain_affine(a, h, fill=np.nan):
    """All pixels at once, by the definition."""
    ys, xs = np.mgrid[0 : a.shape[0], 0 : a.shape[1]]
    u, v, w = np.linalg.inv(h) @ np.stack([xs.ravel(), ys.ravel(), np.ones(a.size)])
    u, v = np.round(u / w, 9), np.round(v / w, 9)
    x0, y0 = np.floor(u).astype(int), np.floor(v).astype(int)
    out, ok = np.zeros(a.size), (u >= 0) & (v >= 0) & (u <= a.shape[1] - 1) & (v <= a.shape[0] - 1)
    for dy, wy in ((0, 1 - v + y0), (1, v - y0)):
        for dx, wx in ((0, 1 - u + x0), (1, u - x0)):
            out += wx * wy * a[np.clip(y0 + dy, 0, a.shape[0] - 1), np.clip(x0 + dx, 0, a.shape[1] - 1)]
    return np.where(ok, out, fill).reshape(a.shape)


def test_warps_and_parts_of_them():
    rng = np.random.default_rng(2)
    for k in range(60):
        shape = tuple(int(n) for n in rng.integers(2, 150, 2))
        a = rng.random(shape)
        h = pixels.rigid(*rng.integers(-5, 5, 2), rng.choice([0, 90, 180, -1, 0.3, 7]), shape)
        if k % 3 == 0:
            h = h + [[0.1, 0, 0], [0, -0.1, 0], [0.0005, -0.0003, 0]]
        want = plain_affine(a, h)
        assert np.allclose(pixels.affine(a, h), want, atol=1e-9, equal_nan=True)
        x1, y1, x2, y2 = (int(n) for n in rng.integers(0, 150, 4))
        assert np.allclose(pixels.affine(a, h, box=(x1, y1, x2, y2)), want[y1:y2, x1:x2], atol=1e-9, equal_nan=True)


def test_targets_are_warped_by_themselves(monkeypatch):
    """Of the page as a whole, one warp; for each cell, its region and its targets."""
    a = form(200, 160)
    boxes = [(20 + 60 * c, 20 + 40 * r, 28 + 60 * c, 24 + 40 * r) for r in range(4) for c in range(2)]
    n, plain = [], pixels.affine
    monkeypatch.setattr(pixels, "affine", lambda image, *rest, **more: n.append(image.size if len(rest) < 3 else 0) or plain(image, *rest, **more))
    found = align.read_targets(a, a, boxes, whole=lambda image, reference: np.eye(3))
    assert [i for i, *_ in found] == list(range(8)) and n.count(a.size) == 1
    assert all(np.allclose(p, a[y1:y2, x1:x2], atol=0.05) for (_, p, _, _), (x1, y1, x2, y2) in zip(found, boxes))


@pytest.mark.parametrize("k", range(0, 60, 12))
def test_noisy_pages_are_not_given_up_at_half_the_size(k):
    """Half turns, stretched, with twice the noise: at half the size alone, three in ten such pages are lost."""
    rng, a = np.random.default_rng(k + 1000), form(220, 180, k)
    want = (rng.uniform(-0.14, 0.14) * 180, rng.uniform(-0.14, 0.14) * 220, rng.uniform(-12, 12) + 180, rng.uniform(0.92, 1.08))
    scan = np.clip(pixels.affine(a, np.linalg.inv(align.similar(*want, a.shape)), 1.0) + rng.normal(0, 0.08, a.shape), 0, 1)
    dx, dy, turn, grow = align.parts(align.global_similarity(scan, a), a.shape)
    assert abs(dx - want[0]) < 0.5 and abs(dy - want[1]) < 0.5 and abs((turn - want[2] + 180) % 360 - 180) < 0.2 and abs(grow - want[3]) < 0.005


def test_few_warps_at_full_size(monkeypatch):
    """Turns and scales are compared at half the size, and a round of refinement is one warp."""
    a, n = form(220, 180), []
    scan = pixels.affine(a, np.linalg.inv(align.similar(9, -7, 4, 1.02, a.shape)), 1.0)
    plain, quick = pixels.affine, getattr(align, "_warped", None)
    monkeypatch.setattr(pixels, "affine", lambda image, *rest, **more: n.append(image.size) or plain(image, *rest, **more))
    if quick:
        monkeypatch.setattr(align, "_warped", lambda *rest: n.append(out.size) or out if (out := quick(*rest)) is not None else None)
    found = align.global_similarity(scan, a)
    assert np.allclose(align.parts(found, a.shape), (9, -7, 4, 1.02), atol=0.1)
    assert sum(n) <= 10 * a.size, sum(n) / a.size


def test_references_are_kept_by_their_pixels(monkeypatch):
    """What is kept of references is bounded, and an image changed in place is another one."""
    monkeypatch.setattr(align, "KEPT_BYTES", 80 * 3 * 64 * 64)
    rng = np.random.default_rng(5)
    for _ in range(8):
        r = rng.random((64, 64))
        assert align.phase_shift(np.roll(r, (3, -2), (0, 1)), r) == (2, -3)
        r[:] = np.roll(r, (5, 1), (0, 1))
        assert align.phase_shift(np.roll(r, (3, -2), (0, 1)), r) == (2, -3)
    assert len(align._references) <= 3
