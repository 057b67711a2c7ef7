"""Bar codes of the ballot vendors, read from grey images (0 black, 1 white), and images of them for tests and samples."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from psephos.functions.codes import I2OF5, hart_weights
from psephos.operators import pixels
from psephos.operators.patches import unpack

#: Guards of an interleaved code: four narrow bars before, a wide and two narrow ones after.
GUARDS = ("NNNN", "WNN")


# --- images --------------------------------------------------------------------------------------


def interleaved_symbols(digits: str) -> str:
    """Bars of a digit string, N or W, black and white in turn; the first digit of each two is black."""
    pairs = ("".join(b + w for b, w in zip(I2OF5[int(x)], I2OF5[int(y)])) for x, y in zip(digits[::2], digits[1::2]))
    return GUARDS[0] + "".join(pairs) + GUARDS[1]


def interleaved_image(digits: str, narrow: int = 2, wide: int = 5, across: int = 24, margin: int = 6) -> np.ndarray:
    """The code's bars from left to right on white."""
    widths = [wide if s == "W" else narrow for s in interleaved_symbols(digits)]
    line = np.concatenate([np.full(n, float(i % 2)) for i, n in enumerate(widths)])
    out = np.ones((across + 2 * margin, len(line) + 2 * margin))
    out[margin:-margin, margin:-margin] = line
    return out


def timing_image(bits: str, mark_h: int = 4, mark_w: int = 6, margin: int = 5) -> np.ndarray:
    """A column of timing marks, one more at either end than there are bits; a bit that is set has a mark two widths to the right of its timing mark."""
    out = np.ones((2 * margin + mark_h * (2 * len(bits) + 4), 2 * margin + 3 * mark_w))
    for i in range(len(bits) + 2):
        y = margin + 2 * mark_h * i
        out[y : y + mark_h, margin : margin + mark_w] = 0
        if 0 < i <= len(bits) and bits[i - 1] == "1":
            out[y : y + mark_h, margin + 2 * mark_w : margin + 3 * mark_w] = 0
    return out


def row_image(bits: str, mark: int = 5, gap: int = 3, height: int = 6, margin: int = 4) -> np.ndarray:
    """Marks in a row at the bottom of the image, set bits black; the guard bits at both ends are set."""
    out = np.ones((3 * height, 2 * margin + (mark + gap) * len(bits)))
    for i, b in enumerate(bits):
        if b == "1":
            out[-2 * height : -height, margin + i * (mark + gap) : margin + i * (mark + gap) + mark] = 0
    return out


def tall_and_short(size: int = 9) -> tuple[np.ndarray, np.ndarray]:
    """The marks for 0 and 1 of side bars: a short and a tall bar on white."""
    zero, one = np.ones((size, size)), np.ones((size, size))
    zero[size // 2 - 1 : size // 2 + 2, 2:-2] = 0
    one[1:-1, size // 2 - 1 : size // 2 + 2] = 0
    return zero, one


def side_image(bits: str, size: int = 9, gap: int = 4, margin: int = 4) -> np.ndarray:
    """Marks for 0 and 1 below each other."""
    marks = tall_and_short(size)
    out = np.ones((2 * margin + (size + gap) * len(bits), 2 * margin + size))
    for i, b in enumerate(bits):
        y = margin + i * (size + gap)
        out[y : y + size, margin : margin + size] = marks[int(b)]
    return out


# --- readers -------------------------------------------------------------------------------------


def interleaved_digits(line: np.ndarray, n: int) -> str | None:
    """The n digits on a scan line across the bars; None if it holds no such code."""
    dark, light = pixels.two_levels(line)
    if dark == light:
        return None
    runs = pixels.runs(line, (dark + light) / 2)
    first = next((i for i, (black, _) in enumerate(runs) if black), None)
    if first is None:
        return None
    runs = runs[first : first + 5 * n + len(GUARDS[0]) + len(GUARDS[1])]
    if len(runs) < 5 * n + 7:
        return None
    out = ""
    for black in (True, False):  # ink spreads: black and white bars have their own widths
        lengths = [k for b, k in runs if b == black]
        low, high = pixels.narrow_wide(lengths)
        runs = [(b, k if b != black else ("W" if abs(k - high) < abs(k - low) else "N")) for b, k in runs]
    symbols = "".join(k for _, k in runs)
    if not symbols.startswith(GUARDS[0]) or not symbols.endswith(GUARDS[1]):
        return None
    for i in range(len(GUARDS[0]), len(symbols) - len(GUARDS[1]), 10):
        for own in (symbols[i : i + 10 : 2], symbols[i + 1 : i + 10 : 2]):
            if own not in I2OF5:
                return None
            out += str(I2OF5.index(own))
    return out


def interleaved(image: np.ndarray, n: int, stripes: int) -> str | None:
    """The reading that most of `stripes` strips along the bars agree on, the first of several."""
    found = Counter(x for part in np.array_split(image, stripes) if (x := interleaved_digits(part.mean(axis=0), n)) is not None)
    return found.most_common(1)[0][0] if found else None


def checks(digits: str | None, n: int = 14) -> bool:
    """Whether the last two of n digits are the check number of the others."""
    if digits is None or len(digits) != n:
        return False
    total = (1 + sum(int(d) * w for d, w in zip(digits, hart_weights(n - 2)))) % 97
    return {1: 98, 0: 97}.get(total, total) == int(digits[n - 2 :])


def hart(image: np.ndarray, n: int = 14, schedule: tuple[int, ...] = (4, 5, 2, 3)) -> tuple[str | None, bool]:
    """The n digits, and whether the image had to be turned: numbers of strips are tried in turn, upright and then turned, until the check number is right."""
    for stripes in schedule:
        for turned in (False, True):
            found = interleaved(pixels.flip(image) if turned else image, n, stripes)
            if checks(found, n):
                return found, turned
    return None, False


def timing(image: np.ndarray, n: int, mark_h: int, mark_w: int) -> str | None:
    """The bits beside a column of n + 2 timing marks; None unless there are so many."""
    dark = image < 0.5
    column = next((x for x in range(dark.shape[1]) if dark[:, x].sum() >= (n + 2) * mark_h // 2), None)
    if column is None:
        return None
    edge = np.diff(np.concatenate([[0], dark[:, column].astype(int), [0]]))
    marks = [int(s) for s, e in zip(np.nonzero(edge == 1)[0], np.nonzero(edge == -1)[0]) if 2 * (e - s) >= mark_h][1:-1]
    if len(marks) != n:
        return None
    x = column + 2 * mark_w
    return "".join("1" if image[y : y + mark_h, x : x + mark_w].mean() < 0.5 else "0" for y in marks)


def marks_in_row(image: np.ndarray, n: int, mark: int, gap: int) -> str | None:
    """The bits of the darkest row of marks; None unless both guard bits are set."""
    line = image[int(image.mean(axis=1).argmin())]
    bits = pixels.bars_on_line(line, mark, gap, n=n)
    return bits if bits is not None and bits[0] == bits[-1] == "1" else None


def diebold(image: np.ndarray, mark: int, gap: int) -> str | None:
    """The 34 bits of a row of marks, guards included; None unless the ones among the first 30 between the guards, modulo 4, are what the last two say."""
    raw = marks_in_row(image, 34, mark, gap)
    return raw if raw is not None and raw[1:31].count("1") % 4 == int(raw[31:33], 2) else None


def side_bits(image: np.ndarray, zero: np.ndarray, one: np.ndarray, n: int, least: float = 0.87) -> str | None:
    """The bits of marks that look like `zero` or `one`, from the top; None unless there are n."""
    maps = pixels.ncc_maps(image, [zero, one])
    found = [(y, bit, score) for bit, mark, own in zip("01", (zero, one), maps) for _, y, score in pixels.matches(image, mark, least, own=own)]
    taken: list[tuple[int, str]] = []
    for y, bit, _ in sorted(found, key=lambda f: -f[2]):
        if all(abs(y - other) >= len(zero) // 2 for other, _ in taken):
            taken.append((y, bit))
    return "".join(bit for _, bit in sorted(taken)) if len(taken) == n else None


def retried(read: Callable[[np.ndarray], str | None]) -> Callable[[np.ndarray], tuple[str | None, bool]]:
    """A reader that tries the turned image where the upright one fails."""
    return lambda image: pixels.decode_or_flip(image, read)


def decode(images: DataFrame, read: Callable[[np.ndarray], tuple[str | None, bool]], patch: str = "patch", image: Callable[..., np.ndarray] | None = None, columns: tuple[str, ...] = ()) -> DataFrame:
    """images without the patch, with raw, is_flipped and status (ok or err); an image that cannot be read is a row of its own kind.

    image: a function of a row's `columns` that gives the row's image (which it opens, or draws), where there is no patch.  The image is read where it is made, so no image goes between
    processes and a task holds one of them.
    """
    rest = [c for c in images.columns if c != patch]
    kinds = dict(images.dtypes)
    out = ["raw", "is_flipped", "status"]

    def run(it):
        for pdf in it:
            made = (image(*row) for row in zip(*[pdf[c] for c in columns])) if image else map(unpack, pdf[patch])
            rows = [(raw, bool(turned), "err" if raw is None else "ok") for raw, turned in map(read, made)]
            yield pd.concat([pdf[rest].reset_index(drop=True), pd.DataFrame(rows, columns=out)], axis=1)

    return images.mapInPandas(run, ", ".join([*[f"`{c}` {kinds[c]}" for c in rest], "raw string, is_flipped boolean, status string"]))
