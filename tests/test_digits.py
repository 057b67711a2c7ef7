import time

import numpy as np
import pytest

from psephos.operators import digits, patches, pixels
from psephos.plans.queries_more import glyphs


def test_envelope_against_all_pairs():
    rng = np.random.default_rng(1)
    for n, lines in ((1, 3), (2, 4), (17, 5), (60, 9)):
        f = np.round(rng.random((n, lines)) * rng.choice([1, 50, 4000]), 3)
        f[rng.random(f.shape) < 0.2] = np.inf
        q = np.arange(n)
        all_ = f[None] + ((q[:, None] - q[None]) ** 2)[:, :, None]
        value, which = pixels.nearest_parabola(f)
        assert np.allclose(value, all_.min(axis=1)) and np.allclose(np.take_along_axis(all_, which[:, None], axis=1)[:, 0], value)
    flat = pixels.distance_transform(np.zeros((4, 6)))
    assert (flat == 0).all()


def test_chain_against_all_pairs():
    rng = np.random.default_rng(2)
    for n, space, stiffness in ((1, 3, 0.01), (2, 3, 1.0), (40, 10, 0.01), (200, 6.5, 0.3)):
        gain = rng.normal(0, 3, n)
        x = np.arange(n)
        gap = x[None] - x[:, None]
        link = np.where(gap > 0, gain[:, None] - stiffness * (gap - space) ** 2, -np.inf)
        got, who = pixels.best_behind(gain, space, stiffness)
        assert np.allclose(got, link.max(axis=0))
        assert all(np.isclose(link[who[i], i], got[i]) for i in range(1, n))


def test_time_is_linear():
    """A square of this width would be 3 GB."""
    gain = np.random.default_rng(3).normal(0, 1, 20_000)
    began = time.time()
    pixels.best_behind(gain, 30, 0.01)
    pixels.nearest_parabola(gain[:, None])
    assert time.time() - began < 5


def test_correlation_as_the_plain_one():
    rng = np.random.default_rng(5)
    a, p = rng.random((40, 50)), rng.random((8, 6))
    a[:12, :12] = 0.5  # without any change: 0
    assert np.allclose(digits.ncc_large(a, p), pixels.ncc_map(a, p), atol=1e-9)


def drawn(code, at=(20, 30), space=10, shape=(70, 160), seed=0, jitter=True):
    rng, a = np.random.default_rng(seed), np.ones(shape)
    places = []
    for i, c in enumerate(code):
        x, y = at[0] + space * i + (int(rng.integers(-1, 2)) if jitter else 0), at[1] + (int(rng.integers(-1, 2)) if jitter else 0)
        a[y : y + 8, x : x + 6] = glyphs()[c]
        places.append((x, y))
    return np.clip(a + rng.normal(0, 0.05, shape), 0, 1), places


@pytest.mark.parametrize("seed", range(5))
def test_numbers_in_two_dimensions(seed):
    code = "".join(np.random.default_rng(seed + 50).choice(list("0123456789"), 6))
    a, places = drawn(code, seed=seed)
    found = digits.read_number(a, glyphs(), 6, 10, (18, 28, 82, 40))
    assert "".join(f[0] for f in found) == code and [(x, y) for _, x, y, _ in found] == places
    framed = np.zeros((a.shape[0] + 9, a.shape[1] + 5))
    framed[9:, 5:] = a  # a black border at the top and left
    found = digits.read_number(framed, glyphs(), 6, 10, (18, 28, 82, 40))
    assert [(x - 5, y - 9) for _, x, y, _ in found] == places
    lower, places = drawn(code, at=(20, 33), seed=seed, jitter=False)
    assert "".join(f[0] for f in digits.read_number(lower, glyphs(), 6, 10, (18, 28, 82, 40))) == code  # beyond the box, found as it grows


def test_several_exemplars_and_judged_places(spark):
    signs = {k: [g, 1 - g] for k, g in glyphs().items()}
    a, places = drawn("404", jitter=False, shape=(60, 60), at=(12, 20))
    a[20:28, 12:18] = 1 - glyphs()["4"]
    assert [f[0] for f in digits.read_chain(a, signs, 3, 10)] == ["4", "0", "4"]
    both = {"a": glyphs()["1"], "b": glyphs()["1"] * 0.5 + glyphs()["2"] * 0.5}
    page = np.ones((30, 30))
    page[10:18, 10:16] = both["a"] * 0.7 + both["b"] * 0.3
    first = digits.read_chain(page, both, 1, 10)[0][0]
    other = "b" if first == "a" else "a"
    assert digits.read_chain(page, both, 1, 10, rejected=[(first, 10, 10)])[0][0] == other
    assert digits.read_chain(page, both, 1, 10, accepted=[(other, 10, 10)])[0][0] == other
    assert digits.read_chain(np.ones((4, 4)), both, 2, 10) == [] and digits.read_chain(np.ones((9, 9)), both, 5, 10) == []
    schema = f"k int, up boolean, known array<struct<digit:string,x:int,y:int,accepted:boolean>>, patch {patches.PATCH}"
    df = spark.createDataFrame([(1, False, None, patches.pack(page)), (2, True, [(first, 10, 10, False)], patches.pack(pixels.flip(page)))], schema)
    rows = sorted((r.k, r.digit) for r in digits.numbers(df, "k", both, 1, 10, (5, 5, 25, 25), "up", "known").collect())
    assert rows == [(1, first), (2, other)]


def signs(n=8, seed=4):
    rng = np.random.default_rng(seed)
    return {f"a{k}": pixels.resize(rng.random((7, 7)), (24, 28)) for k in range(n)}


def test_means_over_squares():
    a = np.random.default_rng(9).random((12, 20))
    assert np.allclose(digits._scaled(a, 0.25), a.reshape(3, 4, 5, 4).mean(axis=(1, 3))) and np.allclose(digits._scaled(a, 1.0), a)
    assert np.isclose(digits._scaled(a, 0.4)[0, 0], (a[:2, :2].sum() + 0.5 * a[2, :2].sum() + 0.5 * a[:2, 2].sum() + 0.25 * a[2, 2]) / 6.25)


def test_halving_finds_what_full_search_finds():
    own = signs()
    scale = digits.coarsest_scale(own)
    assert 0.2 <= scale < 0.8
    rng = np.random.default_rng(6)
    for k, e in own.items():
        a = np.ones((60, 70))
        y, x = int(rng.integers(5, 30)), int(rng.integers(5, 35))
        a[y : y + 24, x : x + 28] = e
        a = np.clip(a + rng.normal(0, 0.05, a.shape), 0, 1)
        full = max(own, key=lambda j: digits.ncc_large(a, own[j]).max())
        order, fx, fy, i, score, n = digits.ranked_labels(a, own, scale)
        assert order[0] == k == full and (fx, fy) == (x, y) and score > 0.9 and sorted(order) == sorted(own)
        assert n == 8 + 4 + 2 + 1  # instead of eight at each of four scales


def test_halving_with_several_exemplars(spark):
    own = signs(3)
    many = {k: [1 - e, e] for k, e in own.items()}
    a = np.ones((60, 70))
    a[14:38, 20:48] = own["a1"]
    df = spark.createDataFrame([(1, patches.pack(a)), (2, patches.pack(np.ones((60, 70))))], f"k int, patch {patches.PATCH}")
    found = digits.attributes_by_halving(df, many, (18, 12, 46, 36), least=0.5).orderBy("k").collect()
    assert (found[0].label, found[0].x, found[0].y, found[0].exemplar) == ("a1", 20, 14, 1) and found[1].label is None
    assert digits.coarsest_scale({"one": own["a0"], "same": own["a0"]}) == 1.0


def test_maps_of_many_patches_are_those_of_each():
    rng = np.random.default_rng(5)
    image = rng.random((14, 40))
    image[:, 20:34] = 0.5  # windows without any contrast
    own = [rng.random((8, 6)), np.ones((8, 6)), rng.random((5, 7)), rng.random((8, 6))]
    for m, p in zip(pixels.ncc_maps(image, own), own):
        assert np.allclose(m, pixels.ncc_map(image, p), atol=1e-9)


def test_windows_of_an_image_are_made_once_for_all_digits(monkeypatch):
    """Ten digits read in two ways: one pass over the windows."""
    from psephos.plans.queries_more import glyphs, noisy, row_of_digits

    n, view = [], np.lib.stride_tricks.sliding_window_view
    monkeypatch.setattr(np.lib.stride_tricks, "sliding_window_view", lambda *a, **k: n.append(1) or view(*a, **k))
    signs = glyphs()
    for code in ("007919", "123456", "999999"):
        a = noisy(row_of_digits(code), 4)
        n.clear()
        maps = pixels.ncc_maps(a, [signs[k] for k in sorted(signs)])
        assert pixels.greedy_digits(a, signs, 6, maps)[0] == pixels.digit_rows(a, signs, 6, 10, maps=maps)[0] == code and len(n) == 1


def test_short_and_long_lines_have_the_same_chains(monkeypatch):
    rng = np.random.default_rng(8)
    for k in range(30):
        gain = rng.normal(size=int(rng.integers(1, 90)))
        quick = pixels.best_behind(gain, 7.0, 0.01 + k / 50)
        monkeypatch.setattr(pixels, "SHORT", 0)
        slow = pixels.best_behind(gain, 7.0, 0.01 + k / 50)
        monkeypatch.setattr(pixels, "SHORT", 128)
        assert np.allclose(quick[0], slow[0]) and (quick[1] == slow[1]).all()
