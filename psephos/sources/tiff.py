"""TIFF scans: tagged strips, uncompressed, PackBits, Deflate, or coded by runs (one- and two-dimensional), as grey images."""

from __future__ import annotations

import zlib

import numpy as np

# --- fixed values: codes of run lengths, by the recommendations T.4 and T.6 -------------------------

#: White runs of 0 to 63, then of 64, 128, ... 1728.
WHITE = """00110101 000111 0111 1000 1011 1100 1110 1111 10011 10100 00111 01000 001000 000011 110100 110101
101010 101011 0100111 0001100 0001000 0010111 0000011 0000100 0101000 0101011 0010011 0100100 0011000 00000010 00000011 00011010
00011011 00010010 00010011 00010100 00010101 00010110 00010111 00101000 00101001 00101010 00101011 00101100 00101101 00000100 00000101 00001010
00001011 01010010 01010011 01010100 01010101 00100100 00100101 01011000 01011001 01011010 01011011 01001010 01001011 00110010 00110011 00110100
11011 10010 010111 0110111 00110110 00110111 01100100 01100101 01101000 01100111 011001100 011001101 011010010 011010011 011010100 011010101
011010110 011010111 011011000 011011001 011011010 011011011 010011000 010011001 010011010 011000 010011011""".split()
#: Black runs of the same lengths.
BLACK = """0000110111 010 11 10 011 0011 0010 00011 000101 000100 0000100 0000101 0000111 00000100 00000111 000011000
0000010111 0000011000 0000001000 00001100111 00001101000 00001101100 00000110111 00000101000 00000010111 00000011000 000011001010 000011001011 000011001100 000011001101 000001101000 000001101001
000001101010 000001101011 000011010010 000011010011 000011010100 000011010101 000011010110 000011010111 000001101100 000001101101 000011011010 000011011011 000001010100 000001010101 000001010110 000001010111
000001100100 000001100101 000001010010 000001010011 000000100100 000000110111 000000111000 000000100111 000000101000 000001011000 000001011001 000000101011 000000101100 000001011010 000001100110 000001100111
0000001111 000011001000 000011001001 000001011011 000000110011 000000110100 000000110101 0000001101100 0000001101101 0000001001010 0000001001011 0000001001100 0000001001101 0000001110010 0000001110011 0000001110100
0000001110101 0000001110110 0000001110111 0000001010010 0000001010011 0000001010100 0000001010101 0000001011010 0000001011011 0000001100100 0000001100101""".split()
#: Runs of 1792, 1856, ... 2560 of either colour.
LONG = "00000001000 00000001100 00000001101 000000010010 000000010011 000000010100 000000010101 000000010110 000000010111 000000011100 000000011101 000000011110 000000011111".split()
#: Two-dimensional modes: pass, horizontal, and the changing element's offset from the one above.
MODES = {"0001": "P", "001": "H", "1": 0, "011": 1, "000011": 2, "0000011": 3, "010": -1, "000010": -2, "0000010": -3}
END_OF_LINE = "000000000001"


def runs_by_code(codes: list[str]) -> dict[str, int]:
    """Code to run length of one colour."""
    return {c: k if k < 64 else 64 * (k - 63) for k, c in enumerate(codes)} | {c: 1792 + 64 * k for k, c in enumerate(LONG)}


def _table(codes: dict, width: int) -> list:
    """(meaning, length) by the next `width` bits."""
    out: list = [None] * (1 << width)
    for code, meaning in codes.items():
        rest = width - len(code)
        first = int(code, 2) << rest
        out[first : first + (1 << rest)] = [(meaning, len(code))] * (1 << rest)
    return out


_RUNS = [_table(runs_by_code(c), 13) for c in (WHITE, BLACK)]
_MODES = _table(MODES, 7)
#: Pixels up to which an image is read.
MOST = 1 << 30


class _Bits:
    def __init__(self, data: bytes):
        self.data, self.at, self.end = data + bytes(8), 0, 8 * len(data)

    def peek(self, n: int) -> int:
        i = self.at >> 3
        return (int.from_bytes(self.data[i : i + 4], "big") >> (32 - n - (self.at & 7))) & ((1 << n) - 1)

    def run(self, colour: int) -> int:
        total = 0
        while True:
            found = _RUNS[colour][self.peek(13)]
            if found is None or self.at >= self.end:
                raise ValueError("no such run of pixels")
            self.at += found[1]
            total += found[0]
            if found[0] < 64:
                return total

    def ended_line(self) -> bool:
        """Whether an end of line stands here, after any zeros; it is passed over."""
        at = self.at
        while self.at < self.end and self.peek(12) == 0:
            self.at += 1
        if self.peek(12) == 1 and self.at < self.end:
            self.at += 12
            return True
        self.at = at
        return False


def _coded_row(bits: _Bits, width: int) -> list[int]:
    """The changing elements of a row coded by itself."""
    out, x, colour = [], 0, 0
    while x < width:
        x += bits.run(colour)
        out.append(x)
        colour ^= 1
    if x > width:
        raise ValueError("a row is too long")
    return out


def _row_by(bits: _Bits, above: list[int], width: int) -> list[int] | None:
    """The changing elements of a row coded by the one above; None at the end of the block."""
    known = [x for x in above if x < width] + [width, width, width]
    out, x, colour, i = [], -1, 0, 0
    while x < width:
        i = max(0, i - 3)
        while known[i] < width and (known[i] <= x or i & 1 != colour):
            i += 1
        found = _MODES[bits.peek(7)]
        if bits.at >= bits.end or found is None:
            if x < 0 and bits.peek(12) == 1:
                return None
            raise ValueError("no such mode")
        mode, n = found
        bits.at += n
        if mode == "P":
            x = known[min(i + 1, len(known) - 1)]
        elif mode == "H":
            first = max(x, 0) + bits.run(colour)
            x = first + bits.run(1 - colour)
            out += [first, x]
        else:
            last, x = x, known[i] + mode
            if x < max(last, 0):
                raise ValueError("a row goes back")
            out.append(x)
            colour ^= 1
        if x > width:
            raise ValueError("a row is too long")
    return out


def _painted(rows: list[list[int]], width: int) -> np.ndarray:
    """1 from each odd changing element to the next."""
    out = np.zeros((len(rows), width + 1), np.int8)
    for y, row in enumerate(rows):
        np.add.at(out[y], row[::2], 1)
        np.add.at(out[y], row[1::2], -1)
    return np.cumsum(out[:, :width], axis=1, dtype=np.int8).astype(np.uint8)


def by_runs(data: bytes, width: int, rows: int, compression: int, options: int = 0) -> np.ndarray:
    """A strip coded by runs as 0 (white) and 1: compression 2 (rows by themselves, on whole bytes), 3 (rows after ends of lines, by the one above where options say so) or 4 (all by the one above).

    A strip that ends early has white rows at its end.
    """
    bits, found, above = _Bits(data), [], []
    while len(found) < rows and bits.at < bits.end:
        if compression == 4:
            row = _row_by(bits, above, width)
            if row is None:
                break
        elif compression == 2:
            row = _coded_row(bits, width)
            bits.at = -(-bits.at // 8) * 8
        else:
            ended = bits.ended_line()
            alone = True
            if options & 1:
                if not ended:
                    raise ValueError("no end of line")
                alone = bits.peek(1) == 1
                bits.at += 1
            if ended and bits.peek(12) == 1:
                break
            row = _coded_row(bits, width) if alone else _row_by(bits, above, width)
            if row is None:
                break
        found.append(row)
        above = row
    return _painted(found + [[]] * (rows - len(found)), width)


def unpacked(data: bytes, size: int) -> bytes:
    """PackBits: n + 1 bytes as they stand, or one byte 1 - n times for negative n; -128 is nothing."""
    out, at = bytearray(), 0
    while at < len(data) and len(out) < size:
        n = data[at]
        if n < 128:
            out += data[at + 1 : at + 2 + n]
            at += n + 2
        elif n > 128:
            out += data[at + 1 : at + 2] * (257 - n)
            at += 2
        else:
            at += 1
    return bytes(out)


def _tags(content: bytes) -> dict[int, list[int]]:
    """Whole-number tags of the first image."""
    order = {b"II": "little", b"MM": "big"}.get(content[:2])
    if order is None or int.from_bytes(content[2:4], order) != 42:
        raise ValueError("not a TIFF image")
    number = lambda at, n: int.from_bytes(content[at : at + n], order)
    at, out = number(4, 4), {}
    for k in range(number(at, 2)):
        e = at + 2 + 12 * k
        size, n = {1: 1, 3: 2, 4: 4}.get(number(e + 2, 2), 0), number(e + 4, 4)
        if size and n * size <= len(content):
            own = e + 8 if n * size <= 4 else number(e + 8, 4)
            out[number(e, 2)] = [number(own + i * size, size) for i in range(n)]
    return out


def tiff(content: bytes) -> np.ndarray:
    """A grey image (0 to 255) from a TIFF file's first image, in strips: 1, 8 or 16 bits grey, 8 bits by palette, 8 bits RGB.  ValueError for what is not read."""
    tags = _tags(content)
    one = lambda tag, default=None: tags[tag][0] if tags.get(tag) else default
    width, height, packing, kind = one(256, 0), one(257, 0), one(259, 1), one(262, 1)
    bits, samples = one(258, 1), one(277, 1)
    offsets, counts, rows = tags.get(273, []), tags.get(279, []), one(278, height)
    if not 0 < width * height <= MOST or not offsets or len(counts) != len(offsets) or rows < 1:
        raise ValueError("a TIFF image without size or strips")
    if packing not in (1, 2, 3, 4, 8, 32773, 32946) or (bits, samples) not in ((1, 1), (8, 1), (16, 1), (8, 3), (8, 4)) or (packing in (2, 3, 4) and bits != 1) or one(284, 1) != 1 or one(317, 1) != 1:
        raise ValueError("a TIFF image of a kind that is not read here")
    line = -(-width * bits * samples // 8)
    strips = []
    for k, (offset, count) in enumerate(zip(offsets, counts)):
        data, own = content[offset : offset + count], min(rows, height - k * rows)
        if own < 1:
            break
        if one(266, 1) == 2:
            data = np.packbits(np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little")).tobytes()
        if packing in (2, 3, 4):
            strips.append(by_runs(data, width, own, packing, one(292, 0)))
            continue
        data = unpacked(data, own * line) if packing == 32773 else zlib.decompress(data) if packing in (8, 32946) else data
        if len(data) < own * line:
            raise ValueError("a strip is too short")
        flat = np.frombuffer(data, np.uint8, own * line).reshape(own, line)
        if bits == 1:
            strips.append(np.unpackbits(flat, axis=1)[:, :width])
        elif bits == 16:
            strips.append(flat.reshape(own, width, 2)[:, :, 1 if content[:2] == b"II" else 0])
        else:
            strips.append(flat.reshape(own, width, samples)[:, :, 0] if samples == 1 else flat.reshape(own, width, samples)[:, :, :3] @ np.array([0.299, 0.587, 0.114]))
    a = np.concatenate(strips).astype(np.float64)
    if len(a) != height:
        raise ValueError("strips are missing")
    if kind == 3:
        if len(tags.get(320, [])) != 768:
            raise ValueError("no palette")
        colours = np.array(tags[320]).reshape(3, 256) // 256
        return np.round(np.array([0.299, 0.587, 0.114]) @ colours)[a.astype(int)]
    a = np.round(a) * (255 if bits == 1 else 1)
    return 255 - a if kind == 0 else a


# --- writing -----------------------------------------------------------------------------------------


def _run_code(n: int, colour: int) -> str:
    out = _BY_RUN[colour][2560] * (n // 2560)
    n %= 2560
    return out + (_BY_RUN[colour][n - n % 64] if n >= 64 else "") + _BY_RUN[colour][n % 64]


_BY_RUN = [{run: code for code, run in runs_by_code(c).items()} for c in (WHITE, BLACK)]
_BY_MODE = {meaning: code for code, meaning in MODES.items()}


def _row_code(own: list[int], above: list[int], width: int) -> str:
    """A row's code by the one above, from the changing elements of both."""
    own, known = own + [width] * 2, above + [width] * 3
    out, x, colour, i, j = [], -1, 0, 0, 0
    while x < width:
        j = max(0, j - 3)
        while known[j] < width and (known[j] <= x or j & 1 != colour):
            j += 1
        first, second = known[j], known[min(j + 1, len(known) - 1)]
        if second < own[i]:
            out.append(_BY_MODE["P"])
            x = second
        elif abs(own[i] - first) <= 3:
            out.append(_BY_MODE[own[i] - first])
            x, colour, i = own[i], 1 - colour, min(i + 1, len(own) - 1)
        else:
            out.append(_BY_MODE["H"] + _run_code(own[i] - max(x, 0), colour) + _run_code(own[i + 1] - own[i], 1 - colour))
            x, i = own[i + 1], min(i + 2, len(own) - 2)
    return "".join(out)


def scan(dark: np.ndarray) -> bytes:
    """A page of two levels (true is dark) as a TIFF file of one strip, all rows coded by the one above."""
    height, width = dark.shape
    rows = [np.flatnonzero(np.diff(np.concatenate([[0], r.astype(np.int8)]))).tolist() for r in dark]
    bits = "".join(_row_code(own, above, width) for own, above in zip(rows, [[], *rows])) + END_OF_LINE * 2
    bits += "0" * (-len(bits) % 8)
    data = int(bits, 2).to_bytes(len(bits) // 8, "big")
    tags = {256: width, 257: height, 258: 1, 259: 4, 262: 0, 273: 8, 277: 1, 278: height, 279: len(data)}
    at = 8 + len(data) + len(data) % 2
    n = lambda x, size: int(x).to_bytes(size, "little")
    return b"II" + n(42, 2) + n(at, 4) + data.ljust(at - 8, b"\0") + n(len(tags), 2) + b"".join(n(t, 2) + n(4, 2) + n(1, 4) + n(v, 4) for t, v in tags.items()) + n(0, 4)
