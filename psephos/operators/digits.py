"""Printed numbers on pages: chains of digits in two dimensions, a search box that grows, places that people accepted or rejected; and labels told apart by halving."""

from __future__ import annotations

from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from psephos.operators import align, pixels
from psephos.operators.patches import unpack

Exemplars = dict[str, np.ndarray] | dict[str, list[np.ndarray]]


def as_lists(exemplars: Exemplars) -> dict[str, list[np.ndarray]]:
    """One exemplar for each label, or several."""
    return {k: [e] if isinstance(e, np.ndarray) else list(e) for k, e in sorted(exemplars.items())}


def ncc_large(image: np.ndarray, patch: np.ndarray) -> np.ndarray:
    """Normalised cross-correlation at every place by Fourier transforms and running sums: as pixels.ncc_map, without a copy of the patch's size for each place."""
    h, w = image.shape[0] - patch.shape[0] + 1, image.shape[1] - patch.shape[1] + 1
    p = patch - patch.mean()
    shape = tuple(1 << int(np.ceil(np.log2(a))) for a in image.shape)
    a = image - image.mean()
    dot = np.fft.irfft2(np.fft.rfft2(a, shape) * np.conj(np.fft.rfft2(p, shape)), shape)[:h, :w]

    def sums(x):
        c = np.pad(x.cumsum(axis=0).cumsum(axis=1), ((1, 0), (1, 0)))
        return c[patch.shape[0] :, patch.shape[1] :] - c[:h, patch.shape[1] :] - c[patch.shape[0] :, :w] + c[:h, :w]

    spread = np.maximum(sums(a * a) - sums(a) ** 2 / patch.size, 0) * (p**2).sum()
    ok = spread > 1e-12 * max(1.0, patch.size)
    return np.where(ok, dot / np.sqrt(np.where(ok, spread, 1)), 0.0)


def read_chain(image: np.ndarray, digits: Exemplars, n: int, space: float, weight: float = 250.0, rejected: list = (), accepted: list = ()) -> list[tuple[str, int, int, float]]:
    """(digit, x, y, score) of n digits whose places follow each other by about `space` along x: the chain with the least sum of weight * (1 - score)^2 and of squared deviations, along x and y.

    A digit's score at a place is that of its best exemplar, less 0.2 around places (digit, x, y) that were rejected and more by 0.2 around accepted ones.  Each step is a distance transform of the
    chains so far, in time linear in the area.
    """
    groups = as_lists(digits)
    names = list(groups)
    h, w = (min(e.shape[k] for es in groups.values() for e in es) for k in (0, 1))
    if image.shape[0] < h or image.shape[1] < w or not names:
        return []
    scores = np.full((len(names), image.shape[0] - h + 1, image.shape[1] - w + 1), -1.0)
    for k, name in enumerate(names):
        for e in groups[name]:
            if e.shape[0] <= image.shape[0] and e.shape[1] <= image.shape[1]:
                m = ncc_large(image, e)
                own = scores[k, : m.shape[0], : m.shape[1]]
                np.maximum(own, m, out=own)
        for places, change in ((rejected, -0.2), (accepted, 0.2)):
            dy, dx = (max(1, groups[name][0].shape[i] // 4) for i in (0, 1))
            for digit, x, y in places:
                if digit == name:
                    scores[k, max(0, y - dy) : y + dy, max(0, x - dx) : x + dx] += change
    best, which = scores.max(axis=0), scores.argmax(axis=0)
    own = weight * (1 - best) ** 2
    step = int(round(space))
    total, back = own, []
    for _ in range(n - 1):
        along, from_x = pixels.nearest_parabola(total.T)
        both, from_y = pixels.nearest_parabola(along.T)
        moved = np.full(total.shape, np.inf)
        if step < total.shape[1]:
            moved[:, step:] = both[:, : total.shape[1] - step]
        back.append((from_x.T, from_y))
        total = moved + own
    if not np.isfinite(total).any():
        return []
    y, x = np.unravel_index(total.argmin(), total.shape)
    out = [(int(x), int(y))]
    for from_x, from_y in reversed(back):
        x, y = out[-1]
        y = int(from_y[y, x - step])
        out.append((int(from_x[y, x - step]), y))
    return [(names[which[y, x]], x, y, float(best[y, x])) for x, y in out[::-1]]


def read_number(image: np.ndarray, digits: Exemplars, n: int, space: float, box: tuple[int, int, int, int], grow: tuple[float, float, float, float] = (0.05, 0.10, 0.05, 0.33), dark: float = 0.2, **places) -> list[tuple[str, int, int, float]]:
    """(digit, x, y, score) of a page's number near its box (x1, y1, x2, y2), in the page's own pixels.

    A black border at the top and left, as straightening leaves it, is cut off first; the box then grows by shares of its size (left, above, right, below) and is clamped to the page.
    """
    top, _, left, _ = pixels.border(image, dark)
    page = image[top:, left:]
    w, h = box[2] - box[0], box[3] - box[1]
    more = [int(round(g * s)) for g, s in zip(grow, (w, h, w, h))]
    x1, y1 = max(0, box[0] - more[0]), max(0, box[1] - more[1])
    x2, y2 = min(page.shape[1], box[2] + more[2]), min(page.shape[0], box[3] + more[3])
    moved = {k: [(d, x - left - x1, y - top - y1) for d, x, y in v] for k, v in places.items()}
    return [(d, x + x1 + left, y + y1 + top, s) for d, x, y, s in read_chain(page[y1:y2, x1:x2], digits, n, space, **moved)]


def numbers(pages: DataFrame, by: str, digits: Exemplars, n: int, space: float, box: tuple[int, int, int, int], flipped: str | None = None, judged: str | None = None, patch: str = "patch") -> DataFrame:
    """by, place, digit, x, y, score: the digits of each page's number; a page that is too small for it has no rows.

    flipped names a boolean column of pages to turn by 180 degrees first; judged a column of arrays of structs (digit, x, y, accepted) of places that people judged before.  Exemplars are
    bounded and travel with the function; pages are rows, so they are spread over tasks as they come.
    """
    columns = [c for c in (flipped, judged) if c]

    def run(it):
        for pdf in it:
            for i in range(len(pdf)):
                row = pdf.iloc[i]
                a = unpack(row[patch])
                a = pixels.flip(a) if flipped and row[flipped] else a
                known = [] if not judged or row[judged] is None else [p if isinstance(p, dict) else p.asDict() for p in row[judged]]
                places = {name: [(p["digit"], p["x"], p["y"]) for p in known if bool(p["accepted"]) == yes] for name, yes in (("accepted", True), ("rejected", False))}
                found = read_number(a, digits, n, space, box, **places)
                yield pd.DataFrame([(row[by], k, *f) for k, f in enumerate(found)], columns=[by, "place", "digit", "x", "y", "score"])

    return pages.select(by, *columns, patch).mapInPandas(run, f"{by} {dict(pages.dtypes)[by]}, place int, digit string, x int, y int, score double")


# --- labels by halving ------------------------------------------------------------------------------


def _scaled(a: np.ndarray, scale: float) -> np.ndarray:
    """An image whose pixels are means over squares of 1 / scale pixels."""
    for axis in (0, 1):
        n = max(1, int(a.shape[axis] * scale + 1e-9))
        edges = np.minimum(np.arange(n + 1) / scale, a.shape[axis])
        ahead = np.concatenate([np.zeros_like(a.take([0], axis)), a.cumsum(axis)], axis)
        whole = np.minimum(edges.astype(int), a.shape[axis] - 1)
        part = (edges - whole).reshape((-1, 1) if axis == 0 else (1, -1))
        a = np.diff(ahead.take(whole, axis) + part * a.take(whole, axis), axis=axis) * scale
    return a


def _best_place(area: np.ndarray, exemplar: np.ndarray, scale: float) -> tuple[float, int, int]:
    """Score and place of an exemplar at a scale; -1 where it does not fit."""
    a, e = (area, exemplar) if scale >= 1 else (_scaled(area, scale), _scaled(exemplar, scale))
    if e.shape[0] > a.shape[0] or e.shape[1] > a.shape[1]:
        return -1.0, 0, 0
    m = ncc_large(a, e)
    y, x = np.unravel_index(m.argmax(), m.shape)
    return float(m[y, x]), int(round(x / min(scale, 1))), int(round(y / min(scale, 1)))


def coarsest_scale(exemplars: Exemplars, step: float = 0.05, least: float = 0.2, margin: float = 0.15) -> float:
    """The smallest scale, in steps from 1 down, at which every label's exemplars, on white paper and moved by quarters of a coarse pixel, are still nearer to themselves than to any other label's by `margin`."""
    groups, scale = as_lists(exemplars), 1.0
    while scale - step >= least - 1e-9:
        now = round(scale - step, 9)
        cell = -(-1 // now)
        shifts = sorted({int(cell * k / 4) for k in range(4)})
        for k, own in groups.items():
            others = [o for j, es in groups.items() if j != k for o in es]
            for e, dy, dx in product(own, shifts, shifts):
                area = np.pad(e, ((int(cell) + dy, 2 * int(cell)), (int(cell) + dx, 2 * int(cell))), constant_values=1.0)
                itself = _best_place(area, e, now)[0]
                if itself < 0.5 or any(_best_place(area, o, now)[0] > itself - margin for o in others):
                    return scale
        scale = now
    return scale


def ranked_labels(area: np.ndarray, exemplars: Exemplars, coarse: float) -> tuple[list[str], int, int, int, float, int]:
    """(labels, best first; x, y and number of the best exemplar; its score after alignment; how many correlations were computed).

    From the coarse scale to the full one, all labels that are left are scored by their best exemplar, and the worse half of them is put aside; the last one's place is searched at full size and
    aligned there.  Labels put aside earlier rank lower.
    """
    groups = as_lists(exemplars)
    left, aside, n = list(groups), [], 0
    rounds = int(np.ceil(np.log2(max(2, len(left))))) + 1
    place = (0, 0, 0)
    for scale in np.linspace(coarse, 1.0, rounds):
        found = {}
        for k in left:
            tried = [(*_best_place(area, e, scale), i) for i, e in enumerate(groups[k])]
            n += len(tried)
            found[k] = max(tried, key=lambda t: (t[0], -t[3]))
        order = sorted(left, key=lambda k: (-found[k][0], k))
        half = -(-len(order) // 2)
        aside = order[half:] + aside
        left, place = order[:half], found[order[0]]
    label = left[0]
    score, x, y, i = place
    e = groups[label][i]
    part = area[y : y + e.shape[0], x : x + e.shape[1]]
    if part.shape == e.shape:
        moved = pixels.affine(part, align.refined(part, e, np.eye(3), "rigid", blurs=(2, 0)))
        score = max(score, align.likeness(moved, e))
    return left + aside, x, y, i, score, n


def attributes_by_halving(df: DataFrame, exemplars: Exemplars, box: tuple[int, int, int, int], coarse: float | None = None, expand: float = 0.5, least: float = 0.0, patch: str = "patch") -> DataFrame:
    """label, x, y, exemplar, score and the labels in order for each page: the attribute value whose exemplars fit best near the box; a score under `least` leaves the page to do (label null).

    The scale to begin at is the coarsest that still tells the exemplars apart, worked out once.
    """
    from psephos.operators.patches import map_patch

    start = coarsest_scale(exemplars) if coarse is None else coarse

    def best(a):
        dx, dy = int((box[2] - box[0]) * expand), int((box[3] - box[1]) * expand)
        x1, y1 = max(0, box[0] - dx), max(0, box[1] - dy)
        order, x, y, i, score, n = ranked_labels(a[y1 : box[3] + dy, x1 : box[2] + dx], exemplars, start)
        return {"label": order[0] if score >= least else None, "x": x + x1, "y": y + y1, "exemplar": i, "score": score, "order": ",".join(order), "correlations": n}

    return map_patch(df, best, "label string, x long, y long, exemplar long, score double, order string, correlations long", patch)
