"""Alignment of scans: similarity by phase correlation of spectra, robust refinement, targets read cell by cell, straightening by Hough peaks."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from psephos.operators import pixels
from psephos.operators.patches import PATCH, pack, unpack


def sampled(a: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Bilinear values at places inside an image."""
    x0, y0 = np.clip(x.astype(int), 0, a.shape[1] - 2), np.clip(y.astype(int), 0, a.shape[0] - 2)
    fx, fy = x - x0, y - y0
    top, low = a[y0, x0] * (1 - fx) + a[y0, x0 + 1] * fx, a[y0 + 1, x0] * (1 - fx) + a[y0 + 1, x0 + 1] * fx
    return top * (1 - fy) + low * fy


def similar(dx: float, dy: float, degrees: float, scale: float, shape: tuple[int, int]) -> np.ndarray:
    """The matrix of a rotation and scaling about an image's middle, and a translation."""
    c, s = scale * np.cos(np.radians(degrees)), scale * np.sin(np.radians(degrees))
    x, y = (shape[1] - 1) / 2, (shape[0] - 1) / 2
    return np.array([[c, -s, x - c * x + s * y + dx], [s, c, y - s * x - c * y + dy], [0, 0, 1.0]])


def parts(h: np.ndarray, shape: tuple[int, int]) -> tuple[float, float, float, float]:
    """dx, dy, degrees and scale of such a matrix."""
    middle = np.array([(shape[1] - 1) / 2, (shape[0] - 1) / 2, 1])
    dx, dy = (h @ middle)[:2] - middle[:2]
    return float(dx), float(dy), float(np.degrees(np.arctan2(h[1, 0], h[0, 0]))), float(np.hypot(h[0, 0], h[1, 0]))


@lru_cache(maxsize=64)
def _window(shape: tuple[int, int]) -> np.ndarray:
    return np.outer(np.hanning(shape[0]), np.hanning(shape[1]))


def _peaks(c: np.ndarray, n: int) -> list[tuple[int, int]]:
    """The n highest places of a cyclic map, with a place's neighbours left out, as signed shifts (y, x)."""
    c, out = c.copy(), []
    for _ in range(n):
        y, x = np.unravel_index(c.argmax(), c.shape)
        out.append((int((y + c.shape[0] // 2) % c.shape[0] - c.shape[0] // 2), int((x + c.shape[1] // 2) % c.shape[1] - c.shape[1] // 2)))
        c[np.ix_(np.arange(y - 2, y + 3) % c.shape[0], np.arange(x - 2, x + 3) % c.shape[1])] = -np.inf
    return out


def phase_shift(image: np.ndarray, reference: np.ndarray) -> tuple[int, int]:
    """Whole-pixel translation (x, y) that brings an image onto a reference of its shape."""
    ((y, x),) = _peaks(_back(_known(reference).windowed * np.conj(_windowed(image)), image.shape), 1)
    return x, y


def _forth(x: np.ndarray, *shape, **axes) -> np.ndarray:
    """The spectrum of an image in single precision, divided by its size: with this norm, numpy keeps to single precision within."""
    return np.fft.rfft2(x.astype(np.float32, copy=False), *shape, norm="forward", **axes)


def _windowed(a: np.ndarray) -> np.ndarray:
    return _forth((a - a.mean()) * _window(a.shape))


def _back(f: np.ndarray, shape: tuple[int, int]) -> np.ndarray:
    """Phase correlation, but for its height, from a product of spectra."""
    return np.fft.irfft2(f / np.maximum(np.abs(f), np.float32(1e-20)), shape)


def _spectrum(a: np.ndarray, size: int, angles: int, radii: int) -> np.ndarray:
    """Log-magnitude of an image's spectrum by angle (over half a turn) and log of the radius: turns and scalings of the image are shifts of it, and translations do not show."""
    f = np.abs(_forth((a - a.mean()) * _window(a.shape), (size, size), axes=(1, 0))) * np.float32(size * size)
    m = np.fft.fftshift(np.log1p(f), axes=1)  # rows from 0 on: the other half is the same
    m, p = m.ravel(), np.zeros((angles, radii), np.float32)
    for at, share in _polar(size, angles, radii):
        p += m.take(at) * share
    return p - p.mean(axis=0)


@lru_cache(maxsize=8)
def _polar(size: int, angles: int, radii: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Where a spectrum's upper half is sampled: four places in it for each sample, and their shares."""
    phi = np.pi * np.arange(angles)[:, None] / angles
    r = 4 * (size / 2.2 / 4) ** (np.arange(radii)[None] / radii)
    x, y = size // 2 + r * np.cos(phi), r * np.sin(phi)
    x0, y0 = x.astype(np.intp), y.astype(np.intp)
    return [((y0 + j) * size + x0 + i, (abs(1 - i - x + x0) * abs(1 - j - y + y0)).astype(np.float32)) for j in (0, 1) for i in (0, 1)]


class _Reference:
    """What many images that are brought onto one reference share: each part is worked out when it is first asked for."""

    def __init__(self, image: np.ndarray):
        self.image, self.kept = image, {}

    def _once(self, key, make):
        if key not in self.kept:
            self.kept[key] = make()
        return self.kept[key]

    @property
    def windowed(self) -> np.ndarray:
        """The spectrum of the windowed image."""
        return self._once("windowed", lambda: _windowed(self.image))

    def polar(self, size: int, angles: int, radii: int) -> np.ndarray:
        """The spectrum of its spectrum by angle and radius."""
        return self._once(("polar", size, angles, radii), lambda: _forth(_spectrum(self.image, size, angles, radii) * np.hanning(radii)))

    def shrunk(self, k: int) -> np.ndarray:
        return self._once(("shrunk", k), lambda: shrunk(self.image, k))

    def slopes(self, blur: int, kinds: int) -> tuple[np.ndarray, np.ndarray]:
        """The smoothed image, and a row for each free motion: how fast it changes under it; at every pixel, or every second one where smoothing makes neighbours alike."""
        def make():
            r = blurred(self.image.astype(np.float32), blur)
            cy, cx = (r.shape[0] - 1) / 2, (r.shape[1] - 1) / 2
            ys, xs = (np.arange(n, dtype=np.float32) for n in r.shape)
            ys, xs = ((ys - cy) / max(cx, cy))[:, None].astype(np.float32), ((xs - cx) / max(cx, cy))[None].astype(np.float32)
            gy, gx = np.gradient(r)
            some = (slice(None), *[slice(None, None, apart(blur))] * 2)
            return r[some[1:]].copy(), np.stack([gx, gy, xs * gy - ys * gx, xs * gx + ys * gy][:kinds])[some].reshape(kinds, -1)

        return self._once(("slopes", blur, kinds), make)


def apart(blur: int) -> int:
    """How many pixels apart an image smoothed that often is looked at."""
    return 2 if blur >= 4 else 1


#: Bytes of references, some 80 a pixel with all that is kept of them, that a process keeps.
KEPT_BYTES = 64 << 20
_references: OrderedDict[tuple, _Reference] = OrderedDict()


def _known(reference: np.ndarray) -> _Reference:
    """What is kept of a reference, known by its pixels; the last used ones are, up to KEPT_BYTES."""
    key = (reference.shape, np.ascontiguousarray(reference, np.float64).tobytes())
    if key not in _references:
        _references[key] = _Reference(np.array(reference, np.float64))
        while len(_references) > 1 and sum(80 * r.image.size for r in _references.values()) > KEPT_BYTES:
            _references.popitem(last=False)
    _references.move_to_end(key)
    return _references[key]


def likeness(moved: np.ndarray, reference: np.ndarray, size: int | None = None) -> float:
    """Correlation of a warped image with a reference where it is known; -1 where under a third (of `size`, if both are cut to where they meet) is."""
    ok = ~np.isnan(moved)
    if 3 * ok.sum() < (size or ok.size):
        return -1.0
    a, b = moved[ok] - moved[ok].mean(), reference[ok] - reference[ok].mean()
    norm = np.sqrt((a @ a) * (b @ b))
    return float(a @ b / norm) if norm > 0 else -1.0


def shrunk(a: np.ndarray, k: int) -> np.ndarray:
    """Means of blocks of k by k pixels."""
    h, w = a.shape[0] // k, a.shape[1] // k
    return a[: h * k, : w * k].reshape(h, k, w, k).mean(axis=(1, 3))


def global_similarity(image: np.ndarray, reference: np.ndarray, most_scale: float = 1.25, angles: int = 720, radii: int = 256, tries: int = 6, at_most: int = 240) -> np.ndarray:
    """The matrix of the similarity that brings an image onto a reference of its shape, without a start near it.

    Pages larger than `at_most` are shrunk for the search and the first refinement.

    Turn and scale are the shift between the two log-polar spectra, up to half a turn; for the best few of these shifts, and both half turns, the translation is the shift between the turned image
    and the reference; of all these, the one whose warped image is most like the reference is refined.  They are compared at half the size,
    where that leaves 64 pixels on a side, and if none is much like it there, as on noisy pages, at the whole size.
    """
    k, known = max(1, -(-max(reference.shape) // at_most)), _known(reference)
    if k > 1:
        small = global_similarity(shrunk(image, k), known.shrunk(k), most_scale, angles, radii, tries, at_most)
        return refined(image, reference, _enlarged(small, k), rounds=4, blurs=(2,))
    size = 1 << int(np.ceil(np.log2(max(reference.shape))))
    own = _forth(_spectrum(image, size, angles, radii) * np.hanning(radii))
    step = np.log(size / 2.2 / 4) / radii
    crossed = _back(known.polar(size, angles, radii) * np.conj(own), (angles, radii))
    limit = int(np.ceil(np.log(most_scale) / step))
    crossed[:, limit + 1 : -limit] = -np.inf
    motions = [(turn * 180 / angles, float(np.exp(-grow * step))) for turn, grow in _peaks(crossed, tries)]
    for k in (2, 1) if min(reference.shape) >= 128 else (1,):
        score, h = _most_like(shrunk(image, k), known.shrunk(k), motions)
        if score >= SURELY:
            break
    return refined(image, reference, _enlarged(h, k))


#: Likeness at half the size from which a motion is not doubted: on drawn pages with noise, right ones have 0.52 at least where half the size is enough, and wrong ones 0.34 at most.
SURELY = 0.5


def _most_like(image: np.ndarray, reference: np.ndarray, motions: list[tuple[float, float]]) -> tuple[float, np.ndarray]:
    """Likeness and matrix of the best of some turns and scales, each with both half turns and the translation that suits it."""
    shape, wanted, seen = reference.shape, reference.astype(np.float32), _known(reference).windowed
    best, framed, window = (-2.0, np.eye(3)), _framed(image), _window(shape).astype(np.float32)
    for turn, grow in motions:
        moved = _warped(framed, similar(0, 0, turn, grow, shape), shape)
        off = moved - np.nanmean(moved)
        off[np.isnan(off)] = 0
        f = _forth(off * window)
        # turned by another half, an image is read from its end, and its spectrum, but for one pixel's shift, is the conjugate
        for half, own, one in ((0, np.conj(f), 0), (180, f, 1)):
            ((y, x),) = _peaks(_back(seen * own, shape), 1)
            y, x = ((n - one + m // 2) % m - m // 2 for n, m in zip((y, x), shape))
            there, here = (tuple(slice(max(0, c * n), m + min(0, c * n)) for n, m in zip((y, x), shape)) for c in (1, -1))
            score = likeness((moved[::-1, ::-1] if half else moved)[here], wanted[there], moved.size)
            best = max(best, (score, similar(x, y, turn + half, grow, shape)), key=lambda b: b[0])
    return best


def _enlarged(h: np.ndarray, k: int) -> np.ndarray:
    """The matrix on an image of one between its means of blocks of k by k pixels."""
    to_small = np.array([[1 / k, 0, -(k - 1) / 2 / k], [0, 1 / k, -(k - 1) / 2 / k], [0, 0, 1.0]])
    return np.linalg.inv(to_small) @ h @ to_small


def blurred(a: np.ndarray, times: int) -> np.ndarray:
    """Binomial smoothing, edges repeated."""
    for _ in range(times):
        a = _smoothed(_smoothed(a).T).T
    return a


def _smoothed(a: np.ndarray) -> np.ndarray:
    """(1, 2, 1) / 4 down the columns."""
    b = 2 * a
    b[1:] += a[:-1]
    b[:-1] += a[1:]
    b[0] += a[0]
    b[-1] += a[-1]
    b *= 0.25
    return b


def _framed(a: np.ndarray) -> np.ndarray:
    """An image in single precision, in a frame of two unknown pixels."""
    out = np.full((a.shape[0] + 4, a.shape[1] + 4), np.nan, np.float32)
    out[2:-2, 2:-2] = a
    return out


def _warped(framed: np.ndarray, h: np.ndarray, shape: tuple[int, int], every: int = 1) -> np.ndarray:
    """pixels.affine in single precision for similarities, which do not need the last digits: what is outside the frame, or on an image's last row and column, is NaN.  every: only each so manieth row and column of the output."""
    high, wide = framed.shape
    m = np.linalg.inv(h)
    x, y = np.arange(0, shape[1], every), np.arange(0, shape[0], every)[:, None]
    u = (m[0, 0] * x + 2).astype(np.float32) + (m[0, 1] * y + m[0, 2]).astype(np.float32)
    v = (m[1, 0] * x + 2).astype(np.float32) + (m[1, 1] * y + m[1, 2]).astype(np.float32)
    for c, last in ((u, wide - 2), (v, high - 2)):
        np.maximum(c, np.float32(0), out=c)
        np.minimum(c, np.float32(last), out=c)
    x0, y0 = np.floor(u), np.floor(v)
    u -= x0
    v -= y0
    at = y0.astype(np.intp)
    at *= wide
    at += x0.astype(np.intp)
    flat = framed.ravel()
    top, low = flat.take(at), flat[wide:].take(at)
    for left, right in ((top, flat[1:]), (low, flat[wide + 1 :])):
        over = right.take(at)
        over -= left
        over *= u
        left += over
    low -= top
    low *= v
    top += low
    return top


def refined(image: np.ndarray, reference: np.ndarray, h: np.ndarray, free: str = "similarity", rounds: int = 12, blurs: tuple[int, ...] = (8, 2)) -> np.ndarray:
    """A matrix near the right one, improved: Gauss-Newton on the difference of smoothed images, where large differences (marks that the reference does not have) weigh less; slopes are the
    reference's, so that a round is one warp.

    free: shift, rigid or similarity.  A step that does not lessen the error is not taken.
    """
    kinds, known, shape = {"shift": 2, "rigid": 3, "similarity": 4}[free], _known(reference), reference.shape
    unit = max(shape[0] - 1, shape[1] - 1) / 2
    image = image.astype(np.float32)
    for blur in blurs:
        framed = _framed(blurred(image, blur))
        r, slopes = known.slopes(blur, kinds)
        error, d, off = _off(_warped(framed, h, shape, apart(blur)), r)
        for _ in range(rounds):
            if np.isinf(error):
                break
            weighted = slopes / np.maximum(off, np.float32(0.05))
            step = np.linalg.lstsq((weighted @ slopes.T).astype(float), (weighted @ d).astype(float), rcond=None)[0]
            if np.abs(step).max() < 0.003:
                break
            dx, dy, turn, grow = [*step, 0.0, 0.0][:4]
            grow, turn = 1 + grow / unit, turn / unit
            new = similar(dx, dy, np.degrees(turn), grow, shape) @ h
            now, d, off = _off(_warped(framed, new, shape, apart(blur)), r)
            if not now < error:
                break
            h, error = new, now
    return h


def _off(moved: np.ndarray, reference: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """The mean of absolute differences where they are known (infinite if under a third are); all differences, 0 where they are unknown; their sizes, infinite there."""
    d = moved.ravel()
    d -= reference.ravel()
    off = np.abs(d)
    total, n = float(off.sum()), d.size
    if np.isnan(total):
        unknown = np.isnan(d)
        d[unknown] = off[unknown] = 0
        total, n = float(off.sum()), n - int(np.count_nonzero(unknown))
        off[unknown] = np.inf
    return total / n if n >= 16 and 3 * n >= d.size else np.inf, d, off


def _error(m: np.ndarray, r: np.ndarray) -> float:
    d = np.abs(m - r).ravel()
    d = d[~np.isnan(d)] if np.isnan(d.sum()) else d
    return float(d.mean()) if 3 * d.size >= m.size else np.inf


# --- targets, cell by cell -------------------------------------------------------------------------


def read_targets(image: np.ndarray, reference: np.ndarray, boxes: list[tuple[int, int, int, int]], rows: int = 4, columns: int = 4, expand: float = 7.0, whole: Callable = global_similarity) -> list[tuple[int, np.ndarray, tuple[int, int, int, int], float]]:
    """(target number, its pixels, its box in the image as scanned, error of its cell's alignment) for boxes (x1, y1, x2, y2) on the reference.

    The page is aligned as a whole (`whole`), then the targets of each of rows x columns cells (by their centres) together: the region round them, larger by `expand` target sizes on each side and
    so overlapping its neighbours', is shifted by phase correlation and refined as a rigid motion; that is kept if it is nearer to the reference than the page's alignment left it.
    """
    h = whole(image, reference)
    page = pixels.affine(image, h, 1.0)
    high, wide = reference.shape
    cells: dict[tuple[int, int], list[int]] = {}
    for i, (x1, y1, x2, y2) in enumerate(boxes):
        cells.setdefault((min(rows - 1, int((y1 + y2) / 2 * rows / high)), min(columns - 1, int((x1 + x2) / 2 * columns / wide))), []).append(i)
    out = []
    for own in cells.values():
        x1, y1, x2, y2 = (f(boxes[i][k] for i in own) for k, f in enumerate((min, min, max, max)))
        dx, dy = (int(expand * max(boxes[i][k + 2] - boxes[i][k] for i in own)) for k in (0, 1))
        x1, y1, x2, y2 = max(0, x1 - dx), max(0, y1 - dy), min(wide, x2 + dx), min(high, y2 + dy)
        part, want = page[y1:y2, x1:x2], reference[y1:y2, x1:x2]
        x, y = phase_shift(part, want)
        framed, single = _framed(part), want.astype(np.float32)
        left, local = _error(part, want), np.eye(3)
        if x or y:
            shifted = np.array([[1, 0, x], [0, 1, y], [0, 0, 1.0]])
            left, local = min((left, 0, local), (_off(_warped(framed, shifted, want.shape), single)[0], 1, shifted), key=lambda e: e[:2])[::2]
        closer = refined(part, want, local, "rigid", blurs=(4, 1))
        left, local = min((left, 0, local), (_off(_warped(framed, closer, want.shape), single)[0], 1, closer), key=lambda e: e[:2])[::2]
        # the whole way from the scan to the region, so that pixels are interpolated once
        to_region = np.array([[1, 0, -x1], [0, 1, -y1], [0, 0, 1.0]])
        way = np.linalg.inv(to_region) @ local @ to_region @ h
        back = np.linalg.inv(way)
        for i in own:
            a, b, c, d = boxes[i]
            u, v, _ = np.round(back @ np.array([a, b, 1])).astype(int)
            out.append((i, pixels.affine(image, way, 1.0, (a, b, c, d)), (int(u), int(v), int(u) + c - a, int(v) + d - b), left))
    return sorted(out, key=lambda t: t[0])


def extract_by_cells(df: DataFrame, reference: np.ndarray, boxes: list[tuple[int, int, int, int]], rows: int = 4, columns: int = 4, patch: str = "patch", **options) -> DataFrame:
    """A row per target of each page: target_id, mean intensity from 0 to 255, its box in the scan, the error of its cell.  Pages are rows, so they are spread over tasks as they come; the
    reference (a style's blank page, bounded) travels with the function."""
    rest = [c for c in df.columns if c != patch]

    def run(it):
        for pdf in it:
            for *own, p in zip(*[pdf[c] for c in rest], pdf[patch]):
                found = read_targets(unpack(p), reference, boxes, rows, columns, **options)
                yield pd.DataFrame([(*own, i, float(a.mean() * 255), *box, e) for i, a, box, e in found], columns=[*rest, "target_id", "intensity", "x1", "y1", "x2", "y2", "error"])

    kinds = dict(df.dtypes)
    return df.mapInPandas(run, ", ".join([*[f"`{c}` {kinds[c]}" for c in rest], "target_id int, intensity double, x1 int, y1 int, x2 int, y2 int, error double"]))


def find_and_align(image: np.ndarray, patch: np.ndarray, box: tuple[int, int, int, int], expand: float = 0.5) -> tuple[int, int, float, np.ndarray]:
    """x, y, score and aligned pixels of a patch near its box: the best place by search, then a rigid alignment of what lies there; the score is the likeness after it."""
    x, y, score = pixels.find_near(image, patch, box, expand)
    area = image[y : y + patch.shape[0], x : x + patch.shape[1]]
    if area.shape != patch.shape:
        return x, y, score, area
    moved = pixels.affine(area, refined(area, patch, np.eye(3), "rigid", blurs=(2, 0)))
    after = likeness(moved, patch)
    return (x, y, after, np.where(np.isnan(moved), area, moved)) if after > score else (x, y, score, area)


def fitted(a: np.ndarray, shape: tuple[int, int]) -> np.ndarray:
    """An image cut or filled up with white, at the right and below, to a shape."""
    out = np.ones(shape)
    h, w = min(a.shape[0], shape[0]), min(a.shape[1], shape[1])
    out[:h, :w] = a[:h, :w]
    return out


#: Bytes of the groups' first patches up to which they go to all tasks; beyond, they are joined by a shuffle.
FEW_BYTES = 32 << 20


def onto_first(df: DataFrame, by: list[str], key: str, free: str = "shift", patch: str = "patch", firsts: DataFrame | None = None) -> DataFrame:
    """df with each patch moved onto its group's first by key (cut or filled up to that one's size; what comes from outside is white), and dx, dy, degrees and error.

    free: shift, or rigid for a turn as well.  The first patches are a written table of their own that is joined by group, so every patch is a row by itself and a group of any size is many tasks'
    work; it is they that go to all tasks, if they are few, and never the patches.  firsts: these patches (by, patch), where they can be had without reading all of df.
    """
    from pyspark.sql import functions as F

    from psephos.sources.io import written

    first = written(df.groupBy(*by).agg(F.min_by(patch, key).alias("_first")) if firsts is None else firsts.select(*by, F.col(patch).alias("_first")), "firsts")
    size = first.agg(F.sum(F.length("_first.data"))).first()[0] or 0
    first = F.broadcast(first) if size <= FEW_BYTES else first.hint("merge")
    kinds = dict(df.dtypes)

    def run(it):
        for pdf in it:
            rows = []
            for p, r in zip(pdf[patch], pdf["_first"]):
                want = unpack(r)
                a = fitted(unpack(p), want.shape)
                x, y = phase_shift(a, want)
                start = min(np.eye(3), np.array([[1, 0, x], [0, 1, y], [0, 0, 1.0]]), key=lambda m: _error(pixels.affine(a, m), want))  # noqa: B023
                h = refined(a, want, start, free, blurs=(2, 0))
                dx, dy, turn, _ = parts(h, want.shape)
                rows.append((pack(pixels.affine(a, h, 1.0)), dx, dy, turn, _error(pixels.affine(a, h), want)))
            moved, *numbers = zip(*rows) if rows else ((),) * 5
            yield pdf.drop(columns="_first").assign(**{patch: list(moved)}, **dict(zip(("dx", "dy", "degrees", "error"), map(list, numbers))))

    schema = ", ".join(f"`{c}` {k if c != patch else PATCH}" for c, k in kinds.items())
    return df.join(first, by).select(*df.columns, "_first").mapInPandas(run, f"{schema}, dx double, dy double, degrees double, error double")


# --- straightening by lines ------------------------------------------------------------------------


def _peak_lines(ys: np.ndarray, xs: np.ndarray, degrees: np.ndarray, least: float) -> list[tuple[float, int, int]]:
    """(angle, distance, votes) of lines y cos(angle) - x sin(angle) = distance: an edge pixel votes for every line through it, and local maxima of the votes by angle and distance are lines."""
    reach = int(np.hypot(xs.max(), ys.max())) + 2
    t = np.radians(degrees)
    votes = np.stack([np.bincount(np.round(ys * np.cos(k) - xs * np.sin(k)).astype(int) + reach, minlength=2 * reach + 1) for k in t])
    p = np.pad(votes, 2, constant_values=-1)
    around = np.max([p[2 + i : p.shape[0] - 2 + i, 2 + j : p.shape[1] - 2 + j] for i in (-2, -1, 0, 1, 2) for j in (-2, -1, 0, 1, 2)], axis=0)
    k, c = np.nonzero((votes == around) & (votes >= least))
    return [(float(degrees[i]), int(j) - reach, int(votes[i, j])) for i, j in zip(k, c)]


def hough_angle(image: np.ndarray, dark: float = 0.5, most: float = 4.0, step: float = 0.1, share: float = 0.25, near: float = 1.5) -> float:
    """The angle in degrees by which a page's lines fall to the right (0 if none is found).

    The upper edges of dark areas vote for near-horizontal lines and the left edges for near-vertical ones, by angles `step` apart; maxima that at least `share` of the page's side votes for, and
    half as many as for the best, are lines.  To each, a straight line is fitted through its voters (within `near` pixels), at the places between pixels where the grey level passes `dark`,
    which is finer than the votes; the result is the median by votes.
    """
    mask = image < dark
    found = []
    degrees = np.arange(-round(most / step), round(most / step) + 1) * step
    for m, grey, sign in ((mask, image, 1), (mask.T, image.T, -1)):
        ys, xs = np.nonzero(m[1:] & ~m[:-1])
        if not len(ys):
            continue
        above, below = grey[ys, xs], grey[ys + 1, xs]
        edge = ys + (above - dark) / (above - below)  # where the grey level is passed, between the two rows
        for angle, distance, n in _peak_lines(ys, xs, degrees, share * m.shape[1]):
            t = np.radians(angle)
            own = np.abs(ys * np.cos(t) - xs * np.sin(t) - distance) <= near
            x, y = xs[own] - xs[own].mean(), edge[own] - edge[own].mean()
            found.append((sign * float(np.degrees(np.arctan2((x * y).sum(), (x * x).sum()))), n))
    if not found:
        return 0.0
    strong = max(n for _, n in found) / 2
    angles, votes = (np.array(c) for c in zip(*sorted(f for f in found if f[1] >= strong)))
    return float(angles[np.searchsorted(np.cumsum(votes), votes.sum() / 2)])


def straightened(df: DataFrame, dark: float = 0.5, most: float = 4.0, patch: str = "patch") -> DataFrame:
    """df with each page turned straight by its lines, what comes from outside white, and the angle in degrees."""

    def run(it):
        for pdf in it:
            for i in range(len(pdf)):  # a page at a time
                a = unpack(pdf[patch].iloc[i])
                angle = hough_angle(a, dark, most)
                turned = pixels.affine(a, pixels.rigid(0, 0, -angle, a.shape), fill=1.0) if angle else a
                yield pdf.iloc[i : i + 1].assign(**{patch: [pack(turned)], "angle": angle})

    kinds = ", ".join(f"`{c}` {k if c != patch else PATCH}" for c, k in df.dtypes)
    return df.mapInPandas(run, f"{kinds}, angle double")
