"""Queries on whole pages: contests from pixels, alignment, straightening; pages are drawn by key and their truth is worked out from the key in SQL."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from psephos.operators import align, contests, digits, edges, patches, pixels, strokes, vendors
from psephos.plans import views as v
from psephos.plans.queries import long, query
from psephos.sources import io, tiff


def drawn(df: DataFrame, draw, *columns: str, at_once: int = 8) -> DataFrame:
    """df with the page that draw makes of a row's columns as patch; a few pages are held at a time."""
    def run(it):
        for pdf in it:
            for f in range(0, len(pdf), at_once):
                own = pdf.iloc[f : f + at_once]
                yield own.assign(patch=[patches.pack(draw(*row)) for row in zip(*[own[c] for c in columns])])

    return df.mapInPandas(run, ", ".join([*[f"`{c}` {k}" for c, k in df.dtypes], f"patch {patches.PATCH}"]))


def scanned(page: np.ndarray, seed: int, noise: float = 0.05) -> np.ndarray:
    return np.clip(page + np.random.default_rng(int(seed)).normal(0, noise, page.shape), 0, 1)


def form(h: int, w: int, seed: int = 3) -> np.ndarray:
    """A printed page: boxes and words."""
    rng, a = np.random.default_rng(seed), np.ones((h, w))
    for _ in range(14):
        y, x, k, m = int(rng.integers(5, h - 40)), int(rng.integers(5, w - 60)), int(rng.integers(10, 35)), int(rng.integers(20, 55))
        a[y : y + 2, x : x + m] = a[y + k : y + k + 2, x : x + m] = 0
        a[y : y + k, x : x + 2] = a[y : y + k, x + m : x + m + 2] = 0
    for _ in range(120):
        y, x = int(rng.integers(5, h - 8)), int(rng.integers(5, w - 14))
        a[y : y + 3, x : x + int(rng.integers(2, 9))] = 0.1
    return a


def frames(boxes, targets, seed: int, shape=(420, 320)) -> np.ndarray:
    """Boxes of two-pixel lines with a gap in each half of each side, and filled targets."""
    rng, a = np.random.default_rng(int(seed)), np.ones(shape)
    for x1, y1, x2, y2 in boxes:
        a[y1 : y1 + 2, x1 : x2 + 2] = a[y2 : y2 + 2, x1 : x2 + 2] = 0
        a[y1 : y2 + 2, x1 : x1 + 2] = a[y1 : y2 + 2, x2 : x2 + 2] = 0
        for k in (0, 1):
            x, y = (int(rng.integers(p + 12 + k * (q - p) // 2, p - 12 + (k + 1) * (q - p) // 2)) for p, q in ((x1, x2), (y1, y2)))
            a[y1 : y1 + 2, x : x + 3] = a[y2 : y2 + 2, x + 2 : x + 5] = 1
            a[y : y + 3, x1 : x1 + 2] = a[y + 2 : y + 5, x2 : x2 + 2] = 1
    for x1, y1, x2, y2 in targets:
        a[y1:y2, x1:x2] = 0.2
    return a


def suppliers(spark, d) -> DataFrame:
    """A key for each page; dealt out to all tasks, as a page is much work for a narrow row."""
    return v.read(spark, d, "supplier").select(*long("s_suppkey", "s_nationkey")).repartition(4 * spark.sparkContext.defaultParallelism)


PLACED = """b AS (SELECT s_suppkey, k * 2 + t AS target_id, 12 + s_suppkey % 18 AS x1, 30 + 90 * k AS y1, 140::BIGINT AS x2, 100 + 90 * k AS y2 FROM supplier, range(3) r(k), range(2) u(t) WHERE k < 1 + s_nationkey % 3
 UNION ALL SELECT s_suppkey, 6 + t, 170 + s_suppkey % 5, 40, 280, 300 FROM supplier, range(2) u(t))"""


@query("j11_o16_page_contests", f"WITH {PLACED} SELECT * FROM b")
def _(spark, d):
    """Pages of broken lines: up to three boxes of two targets in one column; in the other, a frame with two targets, one of which has a box of its own within it on every other page: one contest."""
    s = suppliers(spark, d)
    column = F.explode(F.sequence(F.lit(0).cast("long"), F.col("s_nationkey") % 3)).alias("k")
    x = 12 + F.col("s_suppkey") % 18
    t = F.explode(F.array(F.lit(0).cast("long"), F.lit(1).cast("long"))).alias("t")
    left = s.select("s_suppkey", x.alias("x"), column).select("*", t).select("s_suppkey", (F.col("k") * 2 + F.col("t")).alias("target_id"), (F.col("x") + 8).alias("x1"), (50 + 90 * F.col("k") + 25 * F.col("t")).alias("y1"))
    right = s.select("s_suppkey", t).select("s_suppkey", (6 + F.col("t")).alias("target_id"), F.lit(195).cast("long").alias("x1"), (80 + 120 * F.col("t")).alias("y1"))
    targets = left.unionByName(right).select("*", (F.col("x1") + 12).alias("x2"), (F.col("y1") + 8).alias("y2"))

    def draw(key, nation):
        x, n, o = 12 + key % 18, 1 + nation % 3, 170 + key % 5
        boxes = [(x, 30 + 90 * k, 140, 100 + 90 * k) for k in range(n)] + [(o, 40, 280, 300)] + [(180, 60, 270, 120)] * (key % 2)
        spots = [(x + 8, 50 + 90 * k + 25 * t, x + 20, 58 + 90 * k + 25 * t) for k in range(n) for t in (0, 1)] + [(195, 80 + 120 * t, 207, 88 + 120 * t) for t in (0, 1)]
        return scanned(frames(boxes, spots, key), key)

    return strokes.page_contests(drawn(s, draw, "s_suppkey", "s_nationkey"), targets, "s_suppkey", 320, 420)


MOVES = "s_suppkey % 21 - 10 AS turn, s_suppkey % 41 - 20 AS dx, s_suppkey % 31 - 15 AS dy"


@query("j5_global_alignment", f"SELECT s_suppkey, {MOVES}, s_suppkey % 3 * 4 + 96 AS percent, 'ok' AS status FROM supplier")
def _(spark, d):
    """Scans of one form, turned by up to 10 degrees, moved by up to an eighth of the page and scaled by up to 4 %: the motion is found without a start near it."""
    blank = form(220, 180)

    def draw(k):
        h = align.similar(k % 41 - 20, k % 31 - 15, k % 21 - 10, (k % 3 * 4 + 96) / 100, blank.shape)
        return scanned(pixels.affine(blank, np.linalg.inv(h), 1.0), k)

    def found(a):
        dx, dy, turn, scale = align.parts(align.global_similarity(a, blank), blank.shape)
        return {"turn": round(turn), "dx": round(dx), "dy": round(dy), "percent": round(scale * 100)}

    return patches.map_patch(drawn(suppliers(spark, d).select("s_suppkey"), draw, "s_suppkey"), found, "turn long, dx long, dy long, percent long")


SPOTS = [(32 + 60 * c, 32 + 70 * r, 40 + 60 * c, 36 + 70 * r) for r in range(4) for c in range(4)]


def with_marks(page: np.ndarray, levels) -> np.ndarray:
    """Targets with a border, filled by levels."""
    a = page.copy()
    for (x1, y1, x2, y2), f in zip(SPOTS, levels):
        a[y1 - 4 : y2 + 4, x1 - 4 : x2 + 4] = 0
        a[y1 - 3 : y2 + 3, x1 - 3 : x2 + 3] = 1
        a[y1 - 2 : y2 + 2, x1 - 2 : x2 + 2] = f
    return a


@query("j6_targets_by_cells", "SELECT s_suppkey, CAST(i AS INT) AS target_id, (s_suppkey + i * 37) % 9 + 1 AS level, TRUE AS near FROM supplier, range(16) r(i)")
def _(spark, d):
    """Pages whose quadrants are moved and turned differently: each target's level in tenths, and whether its mean intensity is within 2 of the level's."""
    page = form(320, 280, 5)
    blank = with_marks(page, [1.0] * 16)
    level = lambda k, i: (k + i * 37) % 9 + 1

    def draw(k):
        flat = with_marks(page, [level(k, i) / 10 for i in range(16)])
        out = np.ones(flat.shape)
        for q in range(4):
            y, x = q // 2 * 160, q % 2 * 140
            out[y : y + 160, x : x + 140] = pixels.affine(flat, pixels.rigid((k + q) % 5 - 2, (k + 2 * q) % 5 - 2, ((k + q) % 7 - 3) / 10, flat.shape), 1.0, (x, y, x + 140, y + 160))
        return out

    found = align.extract_by_cells(drawn(suppliers(spark, d).select("s_suppkey"), draw, "s_suppkey"), blank, SPOTS)
    tenths = F.round(F.col("intensity") / 25.5).cast("long")
    return found.select("s_suppkey", "target_id", tenths.alias("level"), (F.abs(F.col("intensity") - tenths * 25.5) <= 2).alias("near"))


@query("j12_line_angles", "SELECT s_suppkey, (s_suppkey % 33 - 16) / 4 AS angle, 'ok' AS status FROM supplier")
def _(spark, d):
    """Pages of lines and words turned by quarters of a degree: the angle by Hough peaks, to the nearest quarter."""
    page = np.ones((320, 280))
    for y in range(40, 300, 60):
        page[y : y + 2, 30:250] = 0
    for x in (30, 120, 249):
        page[40:282, x : x + 2] = 0
    words = np.minimum(page, form(320, 280, 9))

    def draw(k):
        return scanned(pixels.affine(words, pixels.rigid(0, 0, (k % 33 - 16) / 4, page.shape), 1.0), k, 0.08)

    return patches.map_patch(drawn(suppliers(spark, d).select("s_suppkey"), draw, "s_suppkey"), lambda a: {"angle": round(align.hough_angle(a, most=4.5) * 4) / 4}, "angle double")


@query("o28_numbers_on_pages", "SELECT s_suppkey, lpad(CAST(s_suppkey * 7919 % 1000000 AS VARCHAR), 6, '0') AS number, CAST(18 + s_suppkey % 5 AS INT) AS x, CAST(27 + s_suppkey % 9 AS INT) AS y FROM supplier")
def _(spark, d):
    """Six-digit numbers some pixels off their box, on pages with a black border, every other one upside down: the digits and where the first one stands."""
    from psephos.plans.queries_more import glyphs

    signs = glyphs()

    def draw(k, code):
        a = np.ones((76, 130))
        for i, c in enumerate(code):
            x, y = 18 + k % 5 + 10 * i, 27 + k % 9
            a[y : y + 8, x : x + 6] = signs[c]
        a = np.pad(scanned(a, k), ((k % 4, 0), (k % 3, 0)))
        return pixels.flip(a) if k % 2 else a

    s = suppliers(spark, d).select("s_suppkey", F.lpad((F.col("s_suppkey") * 7919 % 1000000).cast("string"), 6, "0").alias("code"), (F.col("s_suppkey") % 2 == 1).alias("turned"))
    found = digits.numbers(drawn(s, draw, "s_suppkey", "code"), "s_suppkey", signs, 6, 10, (18, 28, 82, 40), "turned")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "digit"))), lambda z: z["digit"]), "")
    first = found.groupBy("s_suppkey").agg(joined.alias("number"), F.min(F.struct("place", "x", "y")).alias("at"))
    border = F.col("s_suppkey")
    return first.select("s_suppkey", "number", (F.col("at.x") - border % 3).cast("int").alias("x"), (F.col("at.y") - border % 4).cast("int").alias("y"))


@query("j7_labels_by_halving", "SELECT s_suppkey, 'a' || s_suppkey % 8 AS label, 20 + s_suppkey % 7 AS x, 14 + s_suppkey % 5 AS y, 15::BIGINT AS correlations, 'ok' AS status FROM supplier")
def _(spark, d):
    """One of eight patterns some pixels from its box: told from the others with 15 correlations instead of 32."""
    rng = np.random.default_rng(4)
    signs = {f"a{k}": pixels.resize(rng.random((7, 7)), (24, 28)) for k in range(8)}

    def draw(k):
        a = np.ones((60, 70))
        a[14 + k % 5 : 38 + k % 5, 20 + k % 7 : 48 + k % 7] = signs[f"a{k % 8}"]
        return scanned(a, k)

    pages = drawn(suppliers(spark, d).select("s_suppkey"), draw, "s_suppkey")
    return digits.attributes_by_halving(pages, signs, (20, 14, 48, 38)).select("s_suppkey", "label", "x", "y", "correlations", "status")


def _at(dy: int, dx: int) -> str:
    return f"e[LEAST(GREATEST(y + {dy}, 0), 7) * 8 + LEAST(GREATEST(x + {dx}, 0), 7) + 1]"


GX, GY = (" + ".join(f"{k} * ({_at(*(d, 1) if along else (1, d))} - {_at(*(d, -1) if along else (-1, d))})" for d, k in ((-1, 1), (0, 2), (1, 1))) for along in (True, False))


@query(
    "o26_edges",
    f"""WITH RECURSIVE i AS (SELECT vec_id, embedding::DOUBLE[] AS e, p // 8 AS y, p % 8 AS x FROM embeddings, range(64) r(p)),
g AS MATERIALIZED (SELECT vec_id, y, x, {GX} AS gx, {GY} AS gy FROM i),
s AS MATERIALIZED (SELECT vec_id, y, x, sqrt(gx * gx + gy * gy) AS s, (CAST(ROUND(atan2(gy, gx) * 4 / pi()) AS INT) % 4 + 4) % 4 AS k FROM g),
w AS (SELECT *, CASE WHEN k = 2 THEN 0 WHEN k = 3 THEN -1 ELSE 1 END AS dx, CASE WHEN k = 0 THEN 0 ELSE 1 END AS dy FROM s),
r AS MATERIALIZED (SELECT w.vec_id, w.y, w.x, w.s FROM w LEFT JOIN s a ON a.vec_id = w.vec_id AND a.y = w.y + dy AND a.x = w.x + dx LEFT JOIN s b ON b.vec_id = w.vec_id AND b.y = w.y - dy AND b.x = w.x - dx
 WHERE w.s > 0.5 AND w.s >= COALESCE(a.s, -1) AND w.s > COALESCE(b.s, -1)),
f AS (SELECT vec_id, y, x FROM r WHERE s > 0.9 UNION SELECT r.vec_id, r.y, r.x FROM f JOIN r ON r.vec_id = f.vec_id AND abs(r.y - f.y) <= 1 AND abs(r.x - f.x) <= 1)
SELECT e.vec_id, CAST(COUNT(f.y) AS BIGINT) AS n_edge, CAST(COALESCE(SUM(f.y * 8 + f.x), 0) AS BIGINT) AS places FROM embeddings e LEFT JOIN f ON e.vec_id = f.vec_id GROUP BY e.vec_id""",
)
def _(spark, d):
    """Vectors as images of 8 by 8: how many pixels their edges have, and the sum of these pixels' places."""
    images = patches.from_array(v.read(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x")), "x", 8).drop("x")

    def found(a):
        at = np.flatnonzero(edges.edges(a, 0.5, 0.9, 0))
        return {"n_edge": len(at), "places": int(at.sum())}

    return patches.map_patch(images, found, "n_edge long, places long").drop("status")


PAIRED = "bx AS (SELECT p_partkey AS ballot, ['Measure ' || p_partkey % 3, p_name, p_brand, 'goes on', p_type, 'Size ' || p_size] AS t FROM part)"


@query(
    "i12_multibox_pairs",
    f"""WITH {PAIRED}, k AS (SELECT ballot AS known_ballot, t AS u FROM bx WHERE ballot <= 3),
d AS (SELECT ballot, known_ballot, (levenshtein(t[1], u[1]) + list_min(list_transform(range(5), lambda r: list_sum(list_transform(range(5), lambda j: levenshtein(u[j + 2], t[(j + r) % 5 + 2])))))) / (len(array_to_string(t, '')) + len(array_to_string(u, ''))) AS distance FROM bx, k)
SELECT ballot, known_ballot, 0::BIGINT AS a, 1::BIGINT AS b, ROUND(distance, 6) AS distance FROM d WHERE distance < 0.2""",
)
def _(spark, d):
    """Measures in two boxes: those on all ballots that read like one of the three known ones."""
    p = v.read(spark, d, "part").select(F.col("p_partkey").cast("long").alias("ballot"), F.array(F.concat(F.lit("Measure "), (F.col("p_partkey") % 3).cast("string")), "p_name", "p_brand").alias("first"), F.array(F.lit("goes on"), F.col("p_type"), F.concat(F.lit("Size "), F.col("p_size").cast("string"))).alias("second"))
    box = lambda k, c: p.select("ballot", F.lit(k).cast("long").alias("box"), F.col(c).alias("texts"))
    order = p.select("ballot", F.lit(0).cast("long").alias("a"), F.lit(1).cast("long").alias("b"))
    found = contests.multibox_pairs(box(0, "first").unionByName(box(1, "second")), order, order.where("ballot <= 3"))
    return found.select("ballot", "known_ballot", "a", "b", F.round("distance", 6).alias("distance"))


@query("a3_tiff_scans", "WITH p AS (SELECT vec_id, unnest(embedding::DOUBLE[]) AS v, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings) SELECT a.vec_id, CAST(COUNT(*) FILTER (WHERE a.v < b.v) AS BIGINT) AS n_dark, CAST(COALESCE(SUM(a.i * 64 + b.i) FILTER (WHERE a.v < b.v), 0) AS BIGINT) AS places, 'ok' AS status FROM p a JOIN p b ON a.vec_id = b.vec_id GROUP BY a.vec_id")
def _(spark, d):
    """Which component is less than which, as a scan of two levels in a TIFF file coded by runs, read back: how many pixels are dark, and the sum of their places."""
    def write(it):
        for pdf in (batch.iloc[f : f + io.AT_ONCE] for batch in it for f in range(0, len(batch), io.AT_ONCE)):
            scans = [tiff.scan(np.less.outer(x, x)) for x in (np.asarray(x, float) for x in pdf["x"])]
            yield pd.DataFrame({"image_path": pdf["vec_id"].astype(str) + ".tif", "content": scans})

    vectors = v.read(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"))
    read = io.grey_images(vectors.mapInPandas(write, "image_path string, content binary"))

    def dark(a):
        at = np.flatnonzero(a == 0)
        return {"n_dark": len(at), "places": int(at.sum())}

    found = patches.map_patch(read.drop("status"), dark, "n_dark long, places long")
    return found.select(F.split("image_path", r"\.")[0].cast("long").alias("vec_id"), "n_dark", "places", "status")


@query(
    "c17_similar_texts",
    """WITH t AS (SELECT p_partkey AS id, p_size AS block, p_name AS title, [p_brand, p_type, 'Size ' || p_partkey % 7] AS c FROM part),
k AS (SELECT *, list_min([c, [c[2], c[3], c[1]], [c[3], c[1], c[2]]]) AS f FROM t),
r AS MATERIALIZED (SELECT MIN(id) AS id, block, title, f AS c, length(title) + length(f[1]) + length(f[2]) + length(f[3]) AS n FROM k GROUP BY block, title, f),
p AS MATERIALIZED (SELECT a.id AS a_id, b.id AS b_id, a.title AS ta, b.title AS tb, a.c AS x, b.c AS y, a.n + b.n AS n FROM r a JOIN r b ON a.block = b.block AND a.id < b.id),
d AS (SELECT a_id, b_id, (levenshtein(ta, tb) + list_min(list_transform(range(3), lambda r: list_sum(list_transform(range(3), lambda j: levenshtein(x[j + 1], y[(j + r) % 3 + 1])))))) / n AS distance FROM p)
SELECT a_id, b_id, ROUND(distance, 6) AS distance FROM d WHERE distance <= 0.18""",
)
def _(spark, d):
    """Names and three lines each, in blocks of one size: pairs of distinct texts that are near, by an index of rare characters."""
    part = v.read(spark, d, "part").select(F.col("p_partkey").cast("long").alias("id"), F.col("p_size").alias("block"), F.col("p_name").alias("title"), F.array("p_brand", "p_type", F.concat(F.lit("Size "), (F.col("p_partkey") % 7).cast("string"))).alias("choices"))
    pairs, _ = contests.similar_pairs(part.withColumn("size", F.aggregate("choices", F.lit(0), lambda s, t: s + F.length(t))), ["block"], 0.18)
    return pairs.select("a_id", "b_id", F.round("distance", 6).alias("distance"))


@query("j2_background", "WITH p AS (SELECT vec_id, unnest(embedding::DOUBLE[]) AS x FROM embeddings), m AS (SELECT *, MIN(x) OVER (PARTITION BY vec_id) AS lo, MAX(x) OVER (PARTITION BY vec_id) AS hi FROM p), b AS (SELECT vec_id, lo, hi, LEAST(9, FLOOR((x - lo) * 10 / (hi - lo))) AS bin, COUNT(*) AS n FROM m GROUP BY ALL), r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY vec_id ORDER BY n DESC, bin) AS r FROM b) SELECT vec_id, ROUND(lo + bin * (hi - lo) / 10, 6) AS background, 'ok' AS status FROM r WHERE r = 1")
def _(spark, d):
    images = patches.from_array(v.read(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x")), "x", 8).drop("x")
    return patches.map_patch(images, lambda a: {"background": round(pixels.background(a), 6)}, "background double")


@query("o20_o45_aligned_groups", "WITH f AS (SELECT s_nationkey, MIN(s_suppkey) AS first FROM supplier GROUP BY 1) SELECT s_suppkey, CAST(s_nationkey AS BIGINT) AS s_nationkey, first % 5 - s_suppkey % 5 AS dx, first % 7 - s_suppkey % 7 AS dy, first % 3 - s_suppkey % 3 AS degrees FROM supplier JOIN f USING (s_nationkey)")
def _(spark, d):
    """Scans of one form in groups, each moved and turned by its key: the motion that brings each onto its group's first."""
    page = form(150, 130, 11)

    def draw(k):
        return scanned(pixels.affine(page, pixels.rigid(k % 5 - 2, k % 7 - 3, k % 3 - 1, page.shape), 1.0), k, 0.02)

    keys = suppliers(spark, d)
    firsts = drawn(keys.groupBy("s_nationkey").agg(F.min("s_suppkey").alias("s_suppkey")), draw, "s_suppkey")
    found = align.onto_first(drawn(keys, draw, "s_suppkey"), ["s_nationkey"], "s_suppkey", "rigid", firsts=firsts)
    # about the middle, the shifts of two rigid motions differ by the first one's shift turned by up to two degrees: under a fifth of a pixel
    return found.select("s_suppkey", "s_nationkey", *[F.round(c).cast("long").alias(c) for c in ("dx", "dy", "degrees")])


BIT = "string_agg(CAST((p_partkey * 2654435761 // CAST(pow(2, k) AS BIGINT)) % 2 AS VARCHAR), '' ORDER BY k)"


@query(
    "l1_vendor_codes",
    f"""WITH b AS (SELECT p_partkey, {BIT} AS b FROM part, range(30) t(k) GROUP BY p_partkey),
r AS (SELECT p_partkey, 'diebold' AS vendor, CASE WHEN p_partkey % 5 = 1 THEN '0' ELSE '1' END || b || (length(replace(b, '0', '')) % 4 // 2) || (length(replace(b, '0', '')) % 2) || '1' AS raw FROM b
 UNION ALL SELECT p_partkey, 'ess', b || CASE WHEN p_partkey % 5 = 1 THEN 'x' ELSE '' END FROM b
 UNION ALL SELECT p_partkey, 'sequoia', CASE WHEN p_partkey % 2 = 1 THEN 'BACK' ELSE substr(b, 1, 8) || ',' || CASE WHEN p_partkey % 5 = 1 THEN '' ELSE substr(b, 9, 8) END END FROM b),
k AS (SELECT *, CASE WHEN p_partkey % 5 = 0 AND raw <> 'BACK' THEN 'ioerr' WHEN p_partkey % 5 = 1 AND raw <> 'BACK' THEN 'err' ELSE 'ok' END AS status FROM r)
SELECT vendor, p_partkey, CASE WHEN status = 'ok' THEN CASE vendor WHEN 'diebold' THEN substr(raw, 2, 32) ELSE raw END END AS code, status FROM k""",
)
def _(spark, d):
    """Bit strings of three vendors, one in five missing and one in five not valid: codes and statuses."""
    from psephos.functions import codes
    from psephos.plans.queries_more import bits

    b, k = bits(spark, d, 30), F.col("p_partkey")
    ones = codes.ones(F.col("truth")) % 4
    raws = {
        "diebold": F.concat(F.when(k % 5 == 1, "0").otherwise("1"), "truth", F.floor(ones / 2).cast("string"), (ones % 2).cast("string"), F.lit("1")),
        "ess": F.concat("truth", F.when(k % 5 == 1, "x").otherwise("")),
        "sequoia": F.concat(F.substring("truth", 1, 8), F.lit(","), F.when(k % 5 == 1, "").otherwise(F.substring("truth", 9, 8))),
    }
    out = None
    for name, raw in raws.items():
        rows = b.select("p_partkey", k.alias("ballot_id"), (k % 2).cast("int").alias("page"), F.when(k % 5 != 0, raw).alias("raw"), F.concat(k.cast("string"), F.lit(".png")).alias("image_path"))
        one = vendors.VENDORS[name]().decode(rows).select(F.lit(name).alias("vendor"), "p_partkey", "code", "status")
        out = one if out is None else out.unionByName(one)
    return out
