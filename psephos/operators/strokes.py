"""From a page's pixels to its contests: dark runs, strokes of neighbouring rows, merged pieces, and contests that lie in each other."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from psephos.operators.boxes import extract_contests, in_turn
from psephos.operators.patches import unpack
from psephos.sources.io import written


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Each of n nodes' least node in its component of the edges a-b."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, root[a].copy(), low)
        np.minimum.at(root, root[b].copy(), low)
        while (root[root] != root).any():
            root = root[root]
        apart = root[a] != root[b]
        a, b = a[apart], b[apart]
    return root


def _spread(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs (i, j) with lo[i] <= j < hi[i]."""
    n = np.maximum(hi - lo, 0)
    i = np.repeat(np.arange(len(lo)), n)
    return i, np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)


def cleared(image: np.ndarray, dark: float = 0.5, shade: float = 0.94, large: int = 40, small: int = 10) -> np.ndarray:
    """True where a page is dark.  Shaded or solid areas lose their insides: a block of `large` pixels mostly under `shade` (of `small`, nearly all dark) whose four neighbours are the same is taken as white."""

    def inside(mask, block, share):
        rows, columns = mask.shape[0] // block, mask.shape[1] // block
        full = mask[: rows * block, : columns * block].reshape(rows, block, columns, block).mean(axis=(1, 3)) > share
        p = np.pad(full, 1)
        kept = full & p[:-2, 1:-1] & p[2:, 1:-1] & p[1:-1, :-2] & p[1:-1, 2:]
        out = np.zeros(mask.shape, bool)
        out[: rows * block, : columns * block] = np.repeat(np.repeat(kept, block, axis=0), block, axis=1)
        return out

    mask = (image < dark) & ~inside(image < shade, large, 0.7)
    return mask & ~inside(mask, small, 0.9)


def dark_runs(mask: np.ndarray, piece: int = 8, gap: int = 6, least: int = 30) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end) of dark runs along rows: pieces of `piece` pixels or more, up to `gap` apart, make one; those of `least` pixels or more count."""
    wide = np.zeros((mask.shape[0], mask.shape[1] + 2), np.int8)
    wide[:, 1:-1] = mask
    step = np.diff(wide, axis=1)
    (row, start), end = np.nonzero(step == 1), np.nonzero(step == -1)[1]
    own = end - start >= piece
    row, start, end = row[own], start[own], end[own]
    first = np.ones(len(row), bool)
    first[1:] = (row[1:] != row[:-1]) | (start[1:] - end[:-1] > gap)
    f = np.flatnonzero(first)
    row, start, end = row[f], start[f], end[np.append(f[1:], len(end)) - 1] if len(f) else end
    own = end - start >= least
    return row[own], start[own], end[own]


def strokes(mask: np.ndarray, thick: float = 8.0, **runs) -> list[tuple[int, int, int]]:
    """Lines along rows as (start, end, row): runs that overlap from row to row are one stroke, at the middle of its pixels.  Strokes thicker than `thick` on average are areas, not lines."""
    row, start, end = dark_runs(mask, **runs)
    if not len(row):
        return []
    wide = mask.shape[1] + 1
    at, ahead = row * wide, (row + 1) * wide
    a, b = _spread(np.searchsorted(at + end, ahead + start, "right"), np.searchsorted(at + start, ahead + end, "left"))
    _, group = np.unique(roots(len(row), a, b), return_inverse=True)
    n = group.max() + 1
    left, right = np.full(n, wide), np.zeros(n, np.int64)
    np.minimum.at(left, group, start)
    np.maximum.at(right, group, end)
    size = np.bincount(group, end - start, n)
    middle = np.floor(np.bincount(group, (end - start) * row, n) / size).astype(int)
    return [(int(x), int(y), int(m)) for x, y, m, s in zip(left, right, middle, size) if s <= thick * (y - x)]


def merged(lines: list[tuple[int, int, int]], limit: int, stretch: float = 0.02, near: int = 3) -> list[tuple[int, int, int]]:
    """Pieces of lines (start, end, row) that touch when each is drawn on by `stretch` of its length at both ends, and stands for the `near` rows around it, are one line; done twice.

    A sweep over the rows: a piece is held against those that begin within its rows only.
    """
    for _ in range(2):
        if not lines:
            break
        start, end, row = (np.array(c) for c in zip(*sorted(lines, key=lambda x: x[2])))
        more = np.round((end - start) * stretch).astype(int)
        start, end = np.maximum(start - more, 0), np.minimum(end + more, limit - 1)
        a, b = _spread(np.arange(len(row)) + 1, np.searchsorted(row, row + 2 * near, "left"))
        touch = (start[a] < end[b]) & (start[b] < end[a])
        root = roots(len(row), a[touch], b[touch])
        lines = []
        for r in np.unique(root):
            own = root == r
            long = (end - start)[own]
            lines.append((int(start[own].min()), int(end[own].max()), int(np.floor((row[own] * long).sum() / long.sum()))))
    return lines


def page_lines(image: np.ndarray, dark: float = 0.5, thick: float = 8.0, right: int = 0, **runs) -> list[tuple[str, int, int, int, int]]:
    """(kind, x1, y1, x2, y2) of a page's lines, H or V, each one pixel thick, drawn on a little at both ends.  The last `right` columns, if any, count as a line."""
    mask = cleared(image, dark)
    flat = [("H", a, m, b, m) for a, b, m in merged(strokes(mask, thick, **runs), mask.shape[1])]
    edge = [("V", mask.shape[1] - right, 0, mask.shape[1], mask.shape[0])] if right else []
    return flat + [("V", m, a, m + 1, b) for a, b, m in merged(strokes(mask.T, thick, **runs), mask.shape[0])] + edge


def with_lines(pages: DataFrame, by: str, patch: str = "patch", **options) -> DataFrame:
    """by, kind, id, x1, y1, x2, y2: the lines of each page (by, patch).  A page is one row, so pages are spread over tasks as they come."""

    def run(it):
        for pdf in it:
            for key, p in zip(pdf[by], pdf[patch]):
                found = [(key, kind, i, *box) for i, (kind, *box) in enumerate(page_lines(unpack(p), **options))]
                yield pd.DataFrame(found, columns=[by, "kind", "id", "x1", "y1", "x2", "y2"])

    return pages.select(by, patch).mapInPandas(run, f"{by} {dict(pages.dtypes)[by]}, kind string, id long, x1 long, y1 long, x2 long, y2 long")


# --- contests within and below each other ---------------------------------------------------------


def _common(a, b):
    x1, y1, x2, y2 = max(a[0], b[0]), max(a[1], b[1]), min(a[2], b[2]), min(a[3], b[3])
    return (x1, y1, x2, y2) if x2 > x1 and y2 > y1 else None


def _round(boxes):
    return (min(b[0] for b in boxes), min(b[1] for b in boxes), max(b[2] for b in boxes), max(b[3] for b in boxes))


def _by_area(boxes):
    return sorted(set(boxes), key=lambda b: ((b[2] - b[0]) * (b[3] - b[1]), b))


def settled(boxes: list[tuple], targets: list[tuple]) -> list[tuple]:
    """Contests that hold one target between them become one: the fewest of them (four sides need no more than four) whose bounding box meets every target that any of them meets."""
    boxes = _by_area(boxes)
    while True:
        shared = next((own for own in ([b for b in boxes if _common(b, t) == t] for t in targets) if len(own) > 1), None)
        if shared is None:
            return boxes
        met = [t for t in targets if any(_common(b, t) for b in shared)]
        tried = (_round(some) for k in range(1, min(4, len(shared)) + 1) for some in combinations(shared, k))
        one = next(box for box in tried if all(_common(box, t) for t in met))
        boxes = _by_area([b for b in boxes if b not in shared] + [one])


def stacked(boxes: list[tuple], targets: list[tuple], apart: int = 30, aside: int = 100, share: int = 5) -> list[tuple]:
    """Where most targets have a box of their own (over two boxes for three targets), boxes right below each other in a column are one contest; then those that overlap by a target's height.

    Boxes higher than `share` target heights for each target they meet are whole already.
    """
    if 3 * len(boxes) <= 2 * len(targets):
        return boxes
    high = targets[0][3] - targets[0][1]
    column = lambda a, b: (abs(a[0] - b[0]) < apart or abs(a[2] - b[2]) < apart) and abs(a[0] + a[2] - b[0] - b[2]) < 2 * aside
    whole = lambda b: b[3] - b[1] > sum(_common(b, t) is not None for t in targets) * high * share
    while True:
        links = [(i, j) for i, a in enumerate(boxes) for j, b in enumerate(boxes) if i != j and not whole(a) and not whole(b) and abs(b[3] - a[1]) < apart and column(a, b)]
        if not links:
            break
        root = roots(len(boxes), *np.array(links).T)
        boxes = _by_area([_round([boxes[i] for i in np.flatnonzero(root == r)]) for r in np.unique(root)])
    out, rest = [], boxes
    while rest:
        own = [b for b in rest if (c := _common(b, rest[0])) and c[3] - c[1] >= high and column(b, rest[0])] or [rest[0]]
        out.append(_round(own))
        rest = [b for b in rest if b not in own]
    return out


def merged_contests(held: DataFrame, targets: DataFrame, by: str) -> DataFrame:
    """The final box of each target (held: by, target_id and the box that extract_contests chose; targets: by, target_id, x1, y1, x2, y2), page by page: a page's boxes are few."""
    named = [F.col(f"x{k}").alias(f"tx{k}") for k in (1, 2)] + [F.col(f"y{k}").alias(f"ty{k}") for k in (1, 2)]
    rows = held.join(targets.select(by, "target_id", *named), [by, "target_id"])
    columns = ["target_id", "x1", "y1", "x2", "y2", "tx1", "ty1", "tx2", "ty2"]

    def run(ids, *c):
        boxes, spots = list(zip(*c[:4])), list(zip(*c[4:]))
        contests = stacked(settled(boxes, spots), spots)
        area = lambda b: 0 if b is None else (b[2] - b[0]) * (b[3] - b[1])
        found = [max(contests, key=lambda b: (area(_common(b, t)), -area(b), b)) for t in spots]
        return [ids, *zip(*found)]

    return in_turn(rows, by, ["target_id"], columns, run, f"{by} {dict(held.dtypes)[by]}, target_id {dict(held.dtypes)['target_id']}, x1 long, y1 long, x2 long, y2 long")


def page_contests(pages: DataFrame, targets: DataFrame, by: str, width: int, height: int, right: int = 20, patch: str = "patch", **options) -> DataFrame:
    """The contest box of each target of each page, from pixels: by, target_id, x1, y1, x2, y2.

    Lines are found in the pixels and their pieces merged; the right border of `right` pixels counts as a line, for boxes that end with the page; rectangles of lines take the targets they hold; and
    boxes within or below each other are settled.  A target that no rectangle holds has no row.  Pages are of one size.
    """
    lines = written(with_lines(pages, by, patch, right=right, **options), "lines")  # pixels are read once
    h, v = (lines.where(F.col("kind") == kind).drop("kind") for kind in "HV")
    return merged_contests(extract_contests(h, v, targets, [by], width, height), targets, by)
