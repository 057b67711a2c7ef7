"""Pixel operators on arrays, numpy only: patches are (h, w, data) with float64 bytes."""

from __future__ import annotations

from functools import lru_cache

import numpy as np


def flip(a: np.ndarray) -> np.ndarray:
    """Rotation by 180 degrees."""
    return a[::-1, ::-1]


def affine(a: np.ndarray, h: np.ndarray, fill: float = np.nan, box: tuple[int, int, int, int] | None = None) -> np.ndarray:
    """Warps by a 3x3 matrix (output from input coordinates x, y), bilinear; what comes from outside is fill.  box: only this part (x1, y1, x2, y2) of the output, cut at the image's edges.

    A band of rows at a time, so that all that is in between stays in the cache.
    """
    high, wide = a.shape
    m = np.linalg.inv(h)
    (x1, x2, _), (y1, y2, _) = (slice(*ends).indices(n) for ends, n in zip(((None, None), (None, None)) if box is None else (box[::2], box[1::2]), (wide, high)))
    flat, out = np.ascontiguousarray(a, np.float64).ravel(), np.empty((max(0, y2 - y1), max(0, x2 - x1)))
    x, band = np.arange(x1, x2, dtype=float), max(1, 8192 // max(1, x2 - x1))
    for top in range(0, len(out), band):
        y = np.arange(y1 + top, y1 + min(len(out), top + band), dtype=float)[:, None]
        u, v = m[0, 0] * x + (m[0, 1] * y + m[0, 2]), m[1, 0] * x + (m[1, 1] * y + m[1, 2])
        if m[2, 0] or m[2, 1] or m[2, 2] != 1:
            w = m[2, 0] * x + (m[2, 1] * y + m[2, 2])
            u, v = u / w, v / w
        for c in (u, v):  # to 9 digits
            c *= 1e9
            np.rint(c, out=c)
            c /= 1e9
        ok = (u >= 0) & (v >= 0) & (u <= wide - 1) & (v <= high - 1)
        u, v = u[ok], v[ok]
        x0, y0 = u.astype(np.int64), v.astype(np.int64)
        u -= x0
        v -= y0
        at, right, below = y0 * wide + x0, x0 < wide - 1, (y0 < high - 1) * wide
        left, over = 1 - u, 1 - v
        own = left * over * flat.take(at)
        own += u * over * flat.take(at + right)
        at += below
        own += left * v * flat.take(at)
        own += u * v * flat.take(at + right)
        rows = out[top : top + band]
        rows.fill(fill)
        rows[ok] = own
    return out


def resize(a: np.ndarray, shape: tuple[int, int]) -> np.ndarray:
    """Bilinear, corners to corners."""
    y, x = (np.linspace(0, n - 1, m) for n, m in zip(a.shape, shape))
    y0, x0 = np.minimum(y.astype(int), a.shape[0] - 1), np.minimum(x.astype(int), a.shape[1] - 1)
    y1, x1 = np.minimum(y0 + 1, a.shape[0] - 1), np.minimum(x0 + 1, a.shape[1] - 1)
    fy, fx = (y - y0)[:, None], (x - x0)[None]
    return (a[np.ix_(y0, x0)] * (1 - fx) + a[np.ix_(y0, x1)] * fx) * (1 - fy) + (a[np.ix_(y1, x0)] * (1 - fx) + a[np.ix_(y1, x1)] * fx) * fy


def ncc_map(image: np.ndarray, patch: np.ndarray) -> np.ndarray:
    """Normalised cross-correlation of a patch at every place of an image."""
    view = np.lib.stride_tricks.sliding_window_view(image, patch.shape)
    p = patch - patch.mean()
    v = view - view.mean(axis=(2, 3), keepdims=True)
    norm = np.sqrt((v**2).sum(axis=(2, 3)) * (p**2).sum())
    return np.where(norm > 0, (v * p).sum(axis=(2, 3)) / np.where(norm > 0, norm, 1), 0.0)


def ncc_maps(image: np.ndarray, patches: list[np.ndarray]) -> list[np.ndarray]:
    """ncc_map of several patches: those of one shape share the image's windows, and are one product of matrices."""
    out: list = [None] * len(patches)
    for shape in {p.shape for p in patches}:
        own = [i for i, p in enumerate(patches) if p.shape == shape]
        view = np.lib.stride_tricks.sliding_window_view(image, shape)
        v = view.reshape(-1, shape[0] * shape[1])
        v = v - v.mean(axis=1, keepdims=True)
        p = np.stack([patches[i].ravel() - patches[i].mean() for i in own])
        norm = np.sqrt(np.outer((p * p).sum(axis=1), np.einsum("ij,ij->i", v, v)))
        scores = np.where(norm > 0, p @ v.T / np.where(norm > 0, norm, 1), 0.0).reshape(-1, *view.shape[:2])
        for i, m in zip(own, scores):
            out[i] = m
    return out


def _tops(maps: list[np.ndarray]) -> np.ndarray:
    """The best of each column, a row for each map; -inf where a wider patch has no place."""
    out = np.full((len(maps), max(m.shape[1] for m in maps)), -np.inf)
    for top, m in zip(out, maps):
        np.max(m, axis=0, out=top[: m.shape[1]])
    return out


def best_match(image: np.ndarray, patch: np.ndarray) -> tuple[int, int, float]:
    """x, y and score of the best place, the first of several."""
    m = ncc_map(image, patch)
    y, x = np.unravel_index(m.argmax(), m.shape)
    return int(x), int(y), float(m[y, x])


def matches(image: np.ndarray, patch: np.ndarray, least: float, most: int = 50, apart: float = 0.5, own: np.ndarray | None = None) -> list[tuple[int, int, float]]:
    """Places with a score over `least`, best first, each at least `apart` of the patch's size from those before.  own: the patch's ncc_map, if it is known."""
    m, out = (ncc_map(image, patch) if own is None else own).copy(), []
    dy, dx = (max(1, int(s * apart)) for s in patch.shape)
    while len(out) < most:
        y, x = np.unravel_index(m.argmax(), m.shape)
        if m[y, x] <= least:
            break
        out.append((int(x), int(y), float(m[y, x])))
        m[max(0, y - dy) : y + dy + 1, max(0, x - dx) : x + dx + 1] = -np.inf
    return out


def align_shift(image: np.ndarray, reference: np.ndarray, rounds: int = 30) -> np.ndarray:
    """Translation (x, y) that brings an image onto a reference: Lucas-Kanade, coarse to fine; a step that does not lessen the error ends a level."""
    def moved(a, t):
        return affine(a, np.array([[1, 0, t[0]], [0, 1, t[1]], [0, 0, 1.0]]))

    def error(m, r):
        ok = ~np.isnan(m)
        return ((m - r)[ok] ** 2).mean() if ok.mean() > 0.3 else np.inf

    shift = np.zeros(2)
    for scale in (4, 2, 1):
        shape = tuple(max(4, s // scale) for s in reference.shape)
        a, r = resize(image, shape), resize(reference, shape)
        ratio = np.array([(reference.shape[1] - 1) / (shape[1] - 1), (reference.shape[0] - 1) / (shape[0] - 1)])
        t = shift / ratio
        m = moved(a, t)
        least = error(m, r)
        for _ in range(rounds):
            gy, gx = np.gradient(m)
            ok = ~np.isnan(m) & ~np.isnan(gx) & ~np.isnan(gy)
            step, *_ = np.linalg.lstsq(np.stack([gx[ok], gy[ok]], axis=1), (m - r)[ok], rcond=None)
            m = moved(a, t + step)
            if not error(m, r) < least:
                break
            t, least = t + step, error(m, r)
        shift = t * ratio
    return shift


def border(a: np.ndarray, dark: float = 0.2) -> tuple[int, int, int, int]:
    """Rows and columns (top, bottom, left, right) to cut so that no edge line is mostly dark."""
    def edge(lines):
        n = 0
        for line in lines:
            if line.mean() >= dark:
                break
            n += 1
        return n

    return edge(a), edge(a[::-1]), edge(a.T), edge(a.T[::-1])


def nearest_parabola(f: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For columns f (n, lines): min over q of f[q] + (p - q)^2 for every p, and the q; in time in proportion to n, all lines at once.

    The lower envelope of the parabolas is kept as a stack for each line (Felzenszwalb and Huttenlocher, 2012).  Infinite costs are allowed.
    """
    n, lines = f.shape
    at, cost = np.arange(lines), np.where(np.isinf(f), 1e30, f)
    top, centre, begin = np.zeros(lines, int), np.zeros((n, lines), int), np.full((n + 1, lines), np.inf)
    begin[0] = -np.inf
    for q in range(1, n):
        live = at
        meet = np.empty(lines)
        while len(live):  # parabolas that the new one hides are taken off
            o = centre[top[live], live]
            meet[live] = ((cost[q, live] + q * q) - (cost[o, live] + o * o)) / (2 * (q - o))
            live = live[meet[live] <= begin[top[live], live]]
            top[live] -= 1
        top += 1
        centre[top, at], begin[top, at] = q, meet
        begin[np.minimum(top + 1, n), at] = np.inf
    value, which = np.empty(f.shape), np.empty(f.shape, int)
    now = np.zeros(lines, int)
    for p in range(n):
        while (on := begin[now + 1, at] < p).any():
            now += on
        which[p] = centre[now, at]
        value[p] = f[which[p], at] + (p - which[p]) ** 2
    return value, which


def distance_transform(cost: np.ndarray) -> np.ndarray:
    """Generalised squared distance transform in two dimensions: min over q of cost(q) + |p - q|^2."""
    return nearest_parabola(nearest_parabola(cost)[0].T)[0].T


#: Width up to which a line is short.
SHORT = 128


@lru_cache(maxsize=64)
def _behind(n: int, space: float, stiffness: float) -> np.ndarray:
    """stiffness * (x - y - space)^2 by x and y, inf unless y < x."""
    x = np.arange(n, dtype=float)
    return np.where(x < x[:, None], stiffness * (x[:, None] - x - space) ** 2, np.inf)


def best_behind(gain: np.ndarray, space: float, stiffness: float) -> tuple[np.ndarray, np.ndarray]:
    """For each x: max over y < x of gain[y] - stiffness * (x - y - space)^2, and the y (-inf and 0 for the first).

    Parabolas join the envelope as x passes them, so that none counts before its place; each joins and leaves once.  On a short line all pairs are less work than that.
    """
    if len(gain) <= SHORT:
        all_ = np.asarray(gain, float)[None] - _behind(len(gain), space, stiffness)
        who = all_.argmax(axis=1)
        return all_[np.arange(len(gain)), who], who
    cost = (-np.asarray(gain, float) / stiffness).tolist()
    out, who, stack, begin, at = [np.inf], [0], [], [], 0
    for x in range(1, len(cost)):
        new, meet = x - 1, -np.inf
        while stack:
            old = stack[-1]
            meet = ((cost[new] - cost[old]) / (new - old) + new + old + 2 * space) / 2
            if meet > begin[-1]:
                break
            stack.pop(), begin.pop()
            meet = -np.inf
        stack.append(new), begin.append(meet)
        at = min(at, len(stack) - 1)
        while at + 1 < len(stack) and begin[at + 1] < x:
            at += 1
        out.append(cost[stack[at]] + (x - stack[at] - space) ** 2)
        who.append(stack[at])
    return -stiffness * np.array(out), np.array(who)


def digit_rows(image: np.ndarray, digits: dict[str, np.ndarray], n: int, space: int, stiffness: float = 0.01, maps: list[np.ndarray] | None = None) -> tuple[str, list[int]]:
    """Reads n digits in a row: each place's score by cross-correlation, gaps near `space` by a quadratic cost, best chain by dynamic programming, linear in the row's width.

    maps: ncc_maps of the digits in order, where they are known.
    """
    names = sorted(digits)
    score = _tops(maps or ncc_maps(image, [digits[d] for d in names]))
    best, which = score.max(axis=0), score.argmax(axis=0)
    total, back = best.copy(), []
    for _ in range(n - 1):
        behind, who = best_behind(total, space, stiffness)
        back.append(who)
        total = behind + best
    at = [int(total.argmax())]
    for b in reversed(back):
        at.append(int(b[at[-1]]))
    at = at[::-1]
    return "".join(names[which[i]] for i in at), at


def runs(line: np.ndarray, on: float) -> list[tuple[bool, int]]:
    """Run lengths of a bar code's scan line: (dark, length)."""
    dark = line < on
    cuts = np.concatenate([[0], np.nonzero(dark[1:] != dark[:-1])[0] + 1, [len(dark)]])
    return [(bool(dark[a]), int(b - a)) for a, b in zip(cuts, cuts[1:])]


def two_levels(values: np.ndarray) -> tuple[float, float]:
    """The dark and the light level: middles of the two fullest of ten bins from least to greatest value (of equally full ones, the higher)."""
    n, edges = np.histogram(values)
    a, b = sorted(np.argsort(n, kind="stable")[-2:])
    mid = (edges[1:] + edges[:-1]) / 2
    return float(mid[a]), float(mid[b])


def on_off(values: np.ndarray) -> float:
    """The level halfway between the dark and the light one: what is nearer the dark one is on."""
    return sum(two_levels(values)) / 2


def narrow_wide(lengths: list[int]) -> tuple[float, float]:
    """Lengths of narrow and wide bars: the fullest of ten bins on each side of the middle one of the empty bins (of the fifth edge if none is empty);
    the narrow one's lower edge, the wide one's upper edge."""
    return _narrow_wide(tuple(sorted(lengths)))


@lru_cache(4096)
def _narrow_wide(lengths: tuple[int, ...]) -> tuple[float, float]:
    """A code's bars are of few lengths, and of each about as many in every strip and code."""
    n, edges = np.histogram(lengths)
    empty = np.nonzero(n == 0)[0]
    middle = int(empty[len(empty) // 2]) if len(empty) else len(n) // 2
    return float(edges[n[:middle].argmax()]), float(edges[middle + n[middle:].argmax() + 1])


def bar_widths(lengths: list[int], ambiguous: float = 0.04) -> list[str]:
    """N or W for each length; all readings where a length is near the middle of narrow and wide."""
    low, high = min(lengths), max(lengths)
    out = [""]
    for n in lengths:
        s = (n - low) / (high - low) - 0.5 if high > low else -0.5
        out = [o + c for o in out for c in (("N", "W") if abs(s) < ambiguous else ("N" if s < 0 else "W"))]
    return out


def overlay(stack: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.nanmin(stack, axis=0), np.nanmax(stack, axis=0)


def straight_angle(image: np.ndarray, dark: float, most: float = 4.0, step: float = 0.25) -> float:
    """The angle in degrees whose sheared row sums of dark pixels vary most."""
    ys, xs = np.nonzero(image < dark)
    if not len(xs):
        return 0.0
    angles = sorted(np.arange(-most, most + step / 2, step), key=abs)

    def peaks(angle):
        rows = np.round(ys - xs * np.tan(np.radians(angle))).astype(int)
        return np.bincount(rows - rows.min()).var()

    return float(max(angles, key=peaks))


def grid_image(h: int, w: int, boxes: list[tuple[int, int, int, int]]) -> np.ndarray:
    """A white image with the outlines of boxes (x1, y1, x2, y2) in black; for tests and samples."""
    a = np.ones((h, w))
    for x1, y1, x2, y2 in boxes:
        a[y1, x1 : x2 + 1] = a[y2, x1 : x2 + 1] = 0
        a[y1 : y2 + 1, x1] = a[y1 : y2 + 1, x2] = 0
    return a


def lines(image: np.ndarray, dark: float = 0.5, least: int = 10) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Horizontal lines (y, x1, x2) and vertical lines (x, y1, y2): dark runs of `least` pixels or more."""
    def find(a):
        out = []
        for k, row in enumerate(a < dark):
            edge = np.diff(np.concatenate([[0], row.astype(int), [0]]))
            out += [(k, int(s), int(e) - 1) for s, e in zip(np.nonzero(edge == 1)[0], np.nonzero(edge == -1)[0]) if e - s >= least]
        return out

    return find(image), find(image.T)


def perturbed(image: np.ndarray, dx: float, dy: float, degrees: float, brightness: float, noise: float, seed: int) -> np.ndarray:
    """A shifted, turned, lightened and noisy copy, for testing alignment."""
    c, s = np.cos(np.radians(degrees)), np.sin(np.radians(degrees))
    out = affine(image, np.array([[c, -s, dx], [s, c, dy], [0, 0, 1.0]]), fill=1.0)
    return np.clip(out + brightness + np.random.default_rng(seed).normal(0, noise, image.shape), 0, 1)


def decompose(h: np.ndarray) -> tuple[float, float, float]:
    """Shift (x, y) and rotation in degrees of a rigid matrix."""
    return float(h[0, 2]), float(h[1, 2]), float(np.degrees(np.arctan2(h[1, 0], h[0, 0])))


def background(a: np.ndarray) -> float:
    """An image's background: the lower edge of the fullest of ten bins from its least to its greatest value, the first of several; unknown pixels count as white."""
    n, edges = np.histogram(np.where(np.isnan(a), 1.0, a))
    return float(edges[n.argmax()])


def difference_above(image: np.ndarray, patch: np.ndarray) -> float:
    """Sum of the absolute differences that exceed half the way from the darkest pixel to the background, of the image or the patch, whichever is less."""
    level = min((background(a) - np.nanmin(a)) / 2 for a in (image, patch))
    d = np.abs(image - patch)
    return float(d[d > level].sum())


def variable_difference(image: np.ndarray, patch: np.ndarray) -> float:
    """Mean difference after taking each one's background (its commonest light level) as white."""
    def lifted(a):
        n, edges = np.histogram(a, bins=64, range=(0, 1))
        level = edges[32 + n[32:].argmax() + 1]
        return np.minimum(a / level, 1)

    return float(np.abs(lifted(image) - lifted(patch)).mean())


def decode_or_flip(image: np.ndarray, decode) -> tuple[str | None, bool]:
    """What `decode` reads, or reads after a rotation by 180 degrees; and whether that was needed."""
    found = decode(image)
    if found is not None:
        return found, False
    found = decode(flip(image))
    return found, found is not None


def bars_on_line(line: np.ndarray, mark: int, gap: int, tolerance: float = 0.5, n: int | None = None) -> str | None:
    """Bits of a row of marks `mark` wide and `gap` apart on a scan line: 1 where most of a mark's place is dark.  None if there are not n."""
    cut = on_off(line) if line.max() > line.min() else 0.5
    dark = line < cut
    if not dark.any():
        return None
    first, step, bits = int(np.nonzero(dark)[0][0]), mark + gap, ""
    for at in range(first, len(line) - int(mark * (1 - tolerance)) + 1, step):
        bits += "1" if dark[at : at + mark].mean() >= tolerance else "0"
    bits = bits if n is None else bits[:n]
    return bits if n is None or len(bits) == n else None


def align_rigid(image: np.ndarray, reference: np.ndarray, rounds: int = 40, starts: tuple[float, ...] = (0.0, -2.0, 2.0)) -> np.ndarray:
    """Translation (x, y) and rotation in degrees about the middle that bring an image onto a reference: Lucas-Kanade from coarse to fine, from several turns to begin with; the least error wins.
    A step that does not lessen the error ends a level."""
    def error(m, r):
        ok = ~np.isnan(m)
        return ((m - r)[ok] ** 2).mean() if ok.mean() > 0.3 else np.inf

    def descend(turn: float) -> tuple[float, np.ndarray]:
        found = np.array([0.0, 0.0, turn])
        for scale in (4, 2, 1):
            shape = tuple(max(8, s // scale) for s in reference.shape)
            a, r = resize(image, shape), resize(reference, shape)
            ratio = np.array([(reference.shape[1] - 1) / (shape[1] - 1), (reference.shape[0] - 1) / (shape[0] - 1), 1.0])
            ys, xs = np.mgrid[0 : shape[0], 0 : shape[1]]
            t = found / ratio
            m = affine(a, rigid(*t, shape))
            least = error(m, r)
            for _ in range(rounds):
                gy, gx = np.gradient(m)
                spin = np.radians(1) * ((xs - (shape[1] - 1) / 2) * gy - (ys - (shape[0] - 1) / 2) * gx)
                ok = ~np.isnan(m) & ~np.isnan(gx) & ~np.isnan(gy)
                step, *_ = np.linalg.lstsq(np.stack([gx[ok], gy[ok], spin[ok]], axis=1), (m - r)[ok], rcond=None)
                while np.abs(step).max() > 0.02:  # a step too long is halved
                    new = affine(a, rigid(*(t + step), shape))
                    if error(new, r) < least:
                        break
                    step = step / 2
                else:
                    break
                m, t, least = new, t + step, error(new, r)
            found = t * ratio
        return least, found

    return min((descend(turn) for turn in starts), key=lambda x: x[0])[1]


def rigid(dx: float, dy: float, degrees: float, shape: tuple[int, int]) -> np.ndarray:
    """The matrix of a rotation about the middle and a translation."""
    c, s, x, y = np.cos(np.radians(degrees)), np.sin(np.radians(degrees)), (shape[1] - 1) / 2, (shape[0] - 1) / 2
    return np.array([[c, -s, x - c * x + s * y + dx], [s, c, y - s * x - c * y + dy], [0, 0, 1.0]])


def greedy_digits(image: np.ndarray, digits: dict[str, np.ndarray], n: int, maps: list[np.ndarray] | None = None) -> tuple[str, list[int]]:
    """Reads n digits: the best place of any digit is taken and its surroundings are closed, n times; from left to right.  maps: as for digit_rows."""
    names = sorted(digits)
    tops = _tops(maps or ncc_maps(image, [digits[d] for d in names]))
    found = []
    for _ in range(n):
        k, x = divmod(int(tops.argmax()), tops.shape[1])
        found.append((x, names[k]))
        near = digits[names[k]].shape[1] // 2
        tops[:, max(0, x - near) : x + near + 1] = -np.inf
    found.sort()
    return "".join(d for _, d in found), [x for x, _ in found]


def find_near(image: np.ndarray, patch: np.ndarray, box: tuple[int, int, int, int], expand: float = 0.5, coarse: int = 2) -> tuple[int, int, float]:
    """x, y and score of a patch near its box (x1, y1, x2, y2): the box, larger by `expand` of its size on each side, is searched at a lower resolution, and the best place of that at full."""
    dx, dy = int((box[2] - box[0]) * expand), int((box[3] - box[1]) * expand)
    x1, y1 = max(0, box[0] - dx), max(0, box[1] - dy)
    area = image[y1 : min(image.shape[0], box[3] + dy), x1 : min(image.shape[1], box[2] + dx)]
    cx, cy = 0, 0
    if min(patch.shape) >= 4 * coarse:
        small = [resize(a, tuple(max(2, s // coarse) for s in a.shape)) for a in (area, patch)]
        cx, cy, _ = (int(round(v * coarse)) for v in best_match(*small))
        x, y = max(0, cx - 2 * coarse), max(0, cy - 2 * coarse)
        part = area[y : y + patch.shape[0] + 4 * coarse, x : x + patch.shape[1] + 4 * coarse]
        if all(p >= q for p, q in zip(part.shape, patch.shape)):
            fx, fy, score = best_match(part, patch)
            return x1 + x + fx, y1 + y + fy, score
    fx, fy, score = best_match(area, patch)
    return x1 + fx, y1 + fy, score
