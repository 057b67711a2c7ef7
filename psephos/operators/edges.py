"""Edges of grey images: smoothed gradients, thinned across their direction, followed along connected pixels; and stacks of edge images."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from psephos.operators.align import blurred
from psephos.operators.patches import map_patch, pack
from psephos.operators.strokes import roots


def gradient(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sobel differences along x and y, edges of the image repeated."""
    p = np.pad(a, 1, mode="edge")
    across = p[:-2] + 2 * p[1:-1] + p[2:]
    along = p[:, :-2] + 2 * p[:, 1:-1] + p[:, 2:]
    return across[:, 2:] - across[:, :-2], along[2:] - along[:-2]


def thinned(gx: np.ndarray, gy: np.ndarray) -> np.ndarray:
    """The gradient's size where it is greatest across the edge, else 0.  Of the four directions the nearest is taken; of two equal neighbours along it the first stays."""
    size = np.hypot(gx, gy)
    sector = np.round(np.arctan2(gy, gx) * 4 / np.pi).astype(int) % 4  # 0: along x, 1: down to the right, 2: along y, 3: down to the left
    p = np.pad(size, 1, constant_values=-1.0)
    h, w = size.shape
    out = np.zeros(size.shape)
    for k, (dy, dx) in enumerate(((0, 1), (1, 1), (1, 0), (1, -1))):
        ahead, behind = p[1 + dy : 1 + dy + h, 1 + dx : 1 + dx + w], p[1 - dy : 1 - dy + h, 1 - dx : 1 - dx + w]
        own = (sector == k) & (size >= ahead) & (size > behind)
        out[own] = size[own]
    return out


def followed(size: np.ndarray, low: float, high: float) -> np.ndarray:
    """Pixels over `low` that are connected, over eight neighbours, with one over `high`."""
    on = size > low
    label = np.full(size.shape, -1)
    label[on] = np.arange(on.sum())
    a, b = [], []
    h, w = size.shape
    for dy, dx in ((0, 1), (1, 1), (1, 0), (1, -1)):
        x1, x2 = max(0, -dx), w - max(0, dx)
        p, q = label[: h - dy, x1:x2], label[dy:, x1 + dx : x2 + dx]
        both = (p >= 0) & (q >= 0)
        a.append(p[both]), b.append(q[both])
    root = roots(int(on.sum()), np.concatenate(a), np.concatenate(b))
    strong = np.zeros(len(root), bool)
    strong[root[(size > high)[on]]] = True
    out = np.zeros(size.shape, bool)
    out[on] = strong[root]
    return out


def edges(image: np.ndarray, low: float = 0.4, high: float = 1.0, blurs: int = 2) -> np.ndarray:
    """True on an image's edges: after smoothing, ridges of the gradient over `high`, and what goes on from them over `low`."""
    return followed(thinned(*gradient(blurred(image, blurs))), low, high)


def edge_patches(df: DataFrame, low: float = 0.4, high: float = 1.0, blurs: int = 2, patch: str = "patch") -> DataFrame:
    """df with each patch's edges (0 or 1) in its place, and how many pixels they have; a patch that cannot be read has the status err."""
    from psephos.operators.patches import PATCH

    def run(a):
        e = edges(a, low, high, blurs)
        return {"edge": pack(e), "n_edge": int(e.sum())}

    return map_patch(df, run, f"edge {PATCH}, n_edge long", patch)
