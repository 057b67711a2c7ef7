import zlib

import numpy as np
import pandas as pd
import pytest

from psephos.sources import io, tiff


def run_bits(n, colour):
    by_run = {v: k for k, v in tiff.runs_by_code((tiff.WHITE, tiff.BLACK)[colour]).items()}
    out = ""
    while n > 2560:
        out, n = out + by_run[2560], n - 2560
    if n >= 64:
        out, n = out + by_run[n // 64 * 64], n % 64
    return out + by_run[n]


def row_bits(row):
    """A row by itself."""
    out, x, colour, w = "", 0, 0, len(row)
    while x < w:
        e = x
        while e < w and row[e] == colour:
            e += 1
        out, x, colour = out + run_bits(e - x, colour), e, 1 - colour
    return out


def row_bits_by(row, above):
    """A row by the one above, element by element."""
    modes = {v: k for k, v in tiff.MODES.items()}
    w, a0, colour, out = len(row), -1, 0, ""
    at = lambda r, x: 0 if x < 0 else r[x]
    while a0 < w:
        change = lambda r, x: next((i for i in range(x, w) if at(r, i) != at(r, i - 1)), w)
        a1 = next((i for i in range(max(a0, 0), w) if row[i] != colour), w)
        b1 = next((i for i in range(a0 + 1, w) if at(above, i) != at(above, i - 1) and above[i] != colour), w)
        b2 = change(above, b1 + 1) if b1 < w else w
        if b2 < a1:
            out, a0 = out + modes["P"], b2
        elif abs(a1 - b1) <= 3:
            out, a0, colour = out + modes[a1 - b1], a1, 1 - colour
        else:
            a2 = next((i for i in range(a1, w) if row[i] == colour), w)
            out, a0 = out + modes["H"] + run_bits(a1 - max(a0, 0), colour) + run_bits(a2 - a1, 1 - colour), a2
    return out


def as_bytes(bits):
    bits += "0" * (-len(bits) % 8)
    return int("1" + bits, 2).to_bytes(len(bits) // 8 + 1, "big")[1:] if bits else b""


def coded(a, compression, options=0):
    if compression == 4:
        rows = [np.zeros(a.shape[1], int), *a.tolist()]
        return as_bytes("".join(row_bits_by(r, p) for p, r in zip(rows, rows[1:])) + tiff.END_OF_LINE * 2)
    if compression == 2:
        return b"".join(as_bytes(row_bits(r)) for r in a.tolist())
    out = ""
    for k, r in enumerate(a.tolist()):
        alone = not options & 1 or k % 4 == 0
        out += tiff.END_OF_LINE + ("" if not options & 1 else "1" if alone else "0") + (row_bits(r) if alone else row_bits_by(r, a[k - 1].tolist()))
    return as_bytes(out + (tiff.END_OF_LINE + "1" * (options & 1)) * 6)


def packed(data):
    """PackBits by runs of three or more."""
    out, at = b"", 0
    while at < len(data):
        e = at
        while e < len(data) and data[e] == data[at] and e - at < 128:
            e += 1
        if e - at >= 3:
            out, at = out + bytes([257 - (e - at), data[at]]), e
        else:
            e = at + 1
            while e < len(data) and e - at < 128 and data[e : e + 3] != data[e : e + 1] * 3:
                e += 1
            out, at = out + bytes([e - at - 1]) + data[at:e], e
    return out


def file(strips, tags, order="little"):
    n = lambda x, size: x.to_bytes(size, order)
    body, offsets = b"", []
    for s in strips:
        offsets.append(8 + len(body))
        body += s
    tags = tags | {273: offsets, 279: [len(s) for s in strips]}
    extra_at, entries, extra = 8 + len(body) + 2 + 12 * len(tags) + 4, b"", b""
    for tag, values in sorted(tags.items()):
        own = b"".join(n(v, 4) for v in values)
        if len(own) <= 4:
            entries += n(tag, 2) + n(4, 2) + n(len(values), 4) + own
        else:
            entries += n(tag, 2) + n(4, 2) + n(len(values), 4) + n(extra_at + len(extra), 4)
            extra += own
    head = (b"II" if order == "little" else b"MM") + n(42, 2) + n(8 + len(body), 4)
    return head + body + n(len(tags), 2) + entries + n(0, 4) + extra


def pages():
    rng = np.random.default_rng(7)
    out = [np.zeros((5, 9), int), np.ones((4, 17), int), (rng.random((30, 61)) < 0.5).astype(int), (rng.random((20, 200)) < 0.05).astype(int)]
    form = np.zeros((60, 3000), int)
    form[10:14, 20:2980] = form[40:44, 5:2700] = 1
    form[10:44, 20:24] = form[10:44, 2000:2010] = 1
    text = np.zeros((40, 120), int)
    for y, x in zip(rng.integers(0, 36, 60), rng.integers(0, 112, 60)):
        text[y : y + 4, x : x + rng.integers(1, 8)] = 1
    one = np.zeros((1, 1), int)
    return [*out, form, text, one, 1 - one, (rng.random((9, 8)) < 0.7).astype(int)]


def test_codes_are_whole():
    """No code begins another, and with the end of line's zeros they leave no gap but those that are reserved."""
    for codes in (tiff.WHITE, tiff.BLACK):
        own = sorted([*tiff.runs_by_code(codes), "00000000"])
        assert len(own) == 64 + 27 + 13 + 1 and not any(b.startswith(a) for a, b in zip(own, own[1:]))
        assert sum(2.0 ** -len(c) for c in own) == pytest.approx(1, abs=0.002)


@pytest.mark.parametrize("compression,options", [(2, 0), (3, 0), (3, 1), (4, 0)])
def test_runs_come_back_bit_for_bit(compression, options):
    for a in pages():
        assert (tiff.by_runs(coded(a, compression, options), a.shape[1], a.shape[0], compression, options) == a).all()


@pytest.mark.parametrize("order", ["little", "big"])
def test_files(order):
    for a in pages():
        h, w = a.shape
        flat = np.packbits(a.astype(np.uint8), axis=1)
        for packing, code in ((1, lambda x: x.tobytes()), (32773, lambda x: packed(x.tobytes())), (8, lambda x: zlib.compress(x.tobytes()))):
            found = tiff.tiff(file([code(flat)], {256: [w], 257: [h], 258: [1], 259: [packing], 262: [1], 278: [h]}, order))
            assert (found == a * 255).all()
        rows = max(1, h // 3)
        strips = [coded(a[k : k + rows], 4) for k in range(0, h, rows)]
        assert (tiff.tiff(file(strips, {256: [w], 257: [h], 258: [1], 259: [4], 262: [0], 278: [rows]}, order)) == 255 - a * 255).all()
        turned = [np.packbits(np.unpackbits(np.frombuffer(s, np.uint8)), bitorder="little").tobytes() for s in strips]
        assert (tiff.tiff(file(turned, {256: [w], 257: [h], 258: [1], 259: [4], 262: [0], 266: [2], 278: [rows]}, order)) == 255 - a * 255).all()


def test_written_scans():
    """The writer's code is that of the element by element encoder."""
    for a in pages():
        assert (tiff.tiff(tiff.scan(a == 1)) == 255 - a * 255).all() and coded(a, 4) in tiff.scan(a == 1)


def test_grey_and_colours():
    rng = np.random.default_rng(3)
    a = rng.integers(0, 256, (7, 5)).astype(np.uint8)
    tags = {256: [5], 257: [7], 258: [8], 262: [1], 278: [7]}
    assert (tiff.tiff(file([a.tobytes()], tags)) == a).all() and (tiff.tiff(file([packed(a.tobytes())], tags | {259: [32773], 262: [0]})) == 255 - a.astype(int)).all()
    rgb = rng.integers(0, 256, (7, 5, 3)).astype(np.uint8)
    assert (tiff.tiff(file([rgb.tobytes()], tags | {262: [2], 277: [3]})) == np.round(rgb @ np.array([0.299, 0.587, 0.114]))).all()
    palette = [257 * (255 - v) for v in range(256)] * 3
    assert (tiff.tiff(file([a.tobytes()], tags | {262: [3], 320: palette})) == 255 - a.astype(int)).all()
    assert (tiff.tiff(file([(a.astype("<u2") * 256).tobytes()], tags | {258: [16]})) == a).all()


def test_what_cannot_be_read(spark):
    good = file([coded(pages()[5], 4)], {256: [120], 257: [40], 258: [1], 259: [4], 262: [0], 278: [40]})
    bad = [b"II*\0", good[:40], file([b""], {256: [9], 257: [9]}), file([b"\x01\x02"], {256: [90000], 257: [90000], 258: [1], 259: [4]}), file([b"abc"], {256: [9], 257: [9], 258: [8], 259: [5]})]
    rng = np.random.default_rng(1)
    noise = [file([rng.integers(0, 256, 60).astype(np.uint8).tobytes()], {256: [120], 257: [40], 258: [1], 259: [c], 262: [0]}) for c in (2, 3, 4) for _ in range(20)]
    df = spark.createDataFrame([(f"{k}.tif", c) for k, c in enumerate([good, *bad, *noise])], "image_path string, content binary")
    rows = {r.image_path: r.status for r in io.grey_images(df).collect()}
    assert rows["0.tif"] == "ok" and all(rows[f"{k}.tif"] == "err" for k in range(1, 6)) and len(rows) == 66


def test_few_decoded_images_are_held_at_a_time(spark, monkeypatch):
    """A batch of many small files is not decoded into one batch of pixels."""
    from psephos.sources import io

    class Images:
        sparkSession = spark

        def select(self, *_):
            return self

        def mapInPandas(self, run, schema):
            return run

    content = tiff.scan(np.eye(40) > 0)
    run = io.grey_images(Images())
    out = list(run(iter([pd.DataFrame({"image_path": [f"{k}.tif" for k in range(300)], "content": [content] * 299 + [b"no image"]})])))
    assert max(map(len, out)) <= 64 and sum(map(len, out)) == 300
    assert [s for o in out for s in o["status"]] == ["ok"] * 299 + ["err"]
