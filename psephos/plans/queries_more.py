"""Queries on bar-code images, contest extraction, group splits, files and the other operators added to the first set; registered with the others."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from psephos.functions import codes
from psephos.operators import boxes as bx
from psephos.operators import cluster, contests, decoders, grouping, layout, pairing, patches, pixels, ranking
from psephos.plans import views as v
from psephos.plans.queries import BIG, BOX, TEXTS, big, boxes, long, query, texts
from psephos.sources import io


def drawn(df: DataFrame, draw, *columns: str) -> DataFrame:
    """df with the image that draw makes of a row's columns as patch; narrow rows are dealt out to all tasks first, as an image is much work, and a few images are held at a time."""
    def run(it):
        for pdf in it:
            for f in range(0, len(pdf), 64):
                own = pdf.iloc[f : f + 64]
                yield own.assign(patch=[patches.pack(draw(*row)) for row in zip(*[own[c] for c in columns])])

    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism).mapInPandas(run, ", ".join([*[f"`{c}` {k}" for c, k in df.dtypes], f"patch {patches.PATCH}"]))


def read_drawn(df: DataFrame, draw, read) -> DataFrame:
    """What `read` finds in the images that draw makes of truth and p_partkey; rows are dealt out to all tasks, as drawn does, and an image is read where it is drawn."""
    dealt = df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism)
    return decoders.decode(dealt, read, image=draw, columns=("truth", "p_partkey")).drop("truth")


def noisy(image: np.ndarray, seed: int, turned: bool = False) -> np.ndarray:
    out = np.clip(image + np.random.default_rng(int(seed)).normal(0, 0.05, image.shape), 0, 1)
    return pixels.flip(out) if turned else out


# --- bar codes ------------------------------------------------------------------------------------

TWELVE = "lpad(CAST(p_partkey * 7919 % 1000000 AS VARCHAR), 6, '0') || lpad(CAST(p_partkey * 104729 % 1000000 AS VARCHAR), 6, '0')"
_SUM = " + ".join(f"CAST(substr(c, {i + 1}, 1) AS INT) * {w}" for i, w in enumerate(codes.hart_weights()))
CODE14 = f"tw AS (SELECT p_partkey, {TWELVE} AS c FROM part), su AS (SELECT *, (1 + {_SUM}) % 97 AS t FROM tw), code AS (SELECT p_partkey, c || lpad(CAST(CASE t WHEN 1 THEN 98 WHEN 0 THEN 97 ELSE t END AS VARCHAR), 2, '0') AS raw FROM su)"


def code14(spark, d) -> DataFrame:
    six = lambda k: F.lpad((F.col("p_partkey") * k % 1000000).cast("string"), 6, "0")
    c = v.read(spark, d, "part").select("p_partkey", F.concat(six(7919), six(104729)).alias("c"))
    return c.select("p_partkey", F.concat("c", F.lpad(codes.hart_checksum(F.col("c")).cast("string"), 2, "0")).alias("truth"))


@query("o33_o35_j10_hart_images", f"WITH {CODE14} SELECT p_partkey, raw, p_partkey % 2 = 1 AS is_flipped, 'ok' AS status FROM code")
def _(spark, d):
    """Codes drawn, every other one upside down, with noise, and a blot over a quarter of the bars of every third: read by strips until the check number is right."""
    def draw(truth, k):
        image = decoders.interleaved_image(truth)
        if k % 3 == 0:
            image[6:12, 60:140] = 0
        return noisy(image, k, bool(k % 2))

    return read_drawn(code14(spark, d), draw, decoders.hart)


BITS12 = "string_agg(CAST((p_partkey * 2654435761 // CAST(pow(2, k) AS BIGINT)) % 2 AS VARCHAR), '' ORDER BY k)"


def bits(spark, d, n: int) -> DataFrame:
    digits = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: (F.floor(F.col("p_partkey") * 2654435761 / F.pow(F.lit(2), k)).cast("long") % 2).cast("string"))
    return v.read(spark, d, "part").select("p_partkey", F.array_join(digits, "").alias("truth"))


@query("j10_ess_images", f"SELECT p_partkey, {BITS12} AS raw, FALSE AS is_flipped, 'ok' AS status FROM part, range(12) t(k) GROUP BY p_partkey")
def _(spark, d):
    return read_drawn(bits(spark, d, 12), lambda truth, k: noisy(decoders.timing_image(truth), k), decoders.retried(lambda a: decoders.timing(a, 12, 4, 6)))


_FITS = "length(replace(substr({0}, 2, 30), '0', '')) % 4 = CAST(substr({0}, 32, 1) AS INT) * 2 + CAST(substr({0}, 33, 1) AS INT)"


@query(
    "j10_diebold_images",
    f"""WITH b AS (SELECT p_partkey, {BITS12} AS b FROM part, range(30) t(k) GROUP BY p_partkey), n AS (SELECT *, length(replace(b, '0', '')) % 4 AS n FROM b),
r AS (SELECT p_partkey, '1' || b || (n // 2) || (n % 2) || '1' AS raw FROM n), s AS (SELECT *, reverse(raw) AS turned, p_partkey % 2 = 1 AS odd FROM r)
SELECT p_partkey, CASE WHEN odd AND {_FITS.format('turned')} THEN turned ELSE raw END AS raw, odd AND NOT ({_FITS.format('turned')}) AS is_flipped, 'ok' AS status FROM s""",
)
def _(spark, d):
    """Rows of marks with check bits, every other one upside down: read turned unless the bits fit their check as they stand, which those of some turned ones do."""
    own = bits(spark, d, 30)
    ones = codes.ones(F.col("truth")) % 4
    own = own.withColumn("truth", F.concat(F.lit("1"), "truth", F.floor(ones / 2).cast("string"), (ones % 2).cast("string"), F.lit("1")))
    return read_drawn(own, lambda truth, k: noisy(decoders.row_image(truth), k, bool(k % 2)), decoders.retried(lambda a: decoders.diebold(a, 5, 3)))


@query("f5_j10_sequoia_images", f"SELECT p_partkey, {BITS12} AS raw, FALSE AS is_flipped, 'ok' AS status FROM part, range(8) t(k) GROUP BY p_partkey")
def _(spark, d):
    zero, one = decoders.tall_and_short()
    return read_drawn(bits(spark, d, 8), lambda truth, k: noisy(decoders.side_image(truth), k), decoders.retried(lambda a: decoders.side_bits(a, zero, one, 8)))


@lru_cache
def glyphs() -> dict[str, np.ndarray]:
    """Ten patterns that stand for printed digits."""
    rng = np.random.default_rng(12)
    return {str(k): rng.random((8, 6)) for k in range(10)}


def row_of_digits(code: str) -> np.ndarray:
    out, signs = np.ones((12, 10 * len(code) + 4)), glyphs()
    for i, c in enumerate(code):
        out[2:10, 10 * i + 3 : 10 * i + 9] = signs[c]
    return out


@query("j8_j9_digit_rows", "SELECT p_partkey, lpad(CAST(p_partkey * 7919 % 1000000 AS VARCHAR), 6, '0') AS greedy, lpad(CAST(p_partkey * 7919 % 1000000 AS VARCHAR), 6, '0') AS chained, 'ok' AS status FROM part")
def _(spark, d):
    """Rows of six drawn digits, read place by place and as the best chain."""
    six = v.read(spark, d, "part").select("p_partkey", F.lpad((F.col("p_partkey") * 7919 % 1000000).cast("string"), 6, "0").alias("truth"))
    images = drawn(six, lambda truth, k: noisy(row_of_digits(truth), k), "truth", "p_partkey").drop("truth")
    signs = glyphs()

    def read(a):
        maps = pixels.ncc_maps(a, [signs[k] for k in sorted(signs)])
        return {"greedy": pixels.greedy_digits(a, signs, 6, maps)[0], "chained": pixels.digit_rows(a, signs, 6, 10, maps=maps)[0]}

    return patches.map_patch(images, read, "greedy string, chained string")


# --- pixels ---------------------------------------------------------------------------------------


def grey(spark, d) -> DataFrame:
    return v.read(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"))


def with_arrays(df: DataFrame, fn, schema: str) -> DataFrame:
    """vec_id and what fn makes of each array x."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(it):
        for pdf in it:
            yield pd.DataFrame([(k, *fn(k, np.asarray(x, float))) for k, x in zip(pdf["vec_id"], pdf["x"])], columns=["vec_id", *names])

    return df.mapInPandas(run, f"vec_id long, {schema}")


@query("h6_two_levels", "WITH p AS (SELECT vec_id, unnest(embedding::DOUBLE[]) AS x FROM embeddings), m AS (SELECT *, MIN(x) OVER (PARTITION BY vec_id) AS lo, MAX(x) OVER (PARTITION BY vec_id) AS hi FROM p), b AS (SELECT vec_id, lo, hi, LEAST(9, FLOOR((x - lo) * 10 / (hi - lo))) AS bin, COUNT(*) AS n FROM m GROUP BY ALL), r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY vec_id ORDER BY n DESC, bin DESC) AS r FROM b) SELECT vec_id, ROUND(MIN(lo + (bin + 0.5) * (hi - lo) / 10), 6) AS dark, ROUND(MAX(lo + (bin + 0.5) * (hi - lo) / 10), 6) AS light FROM r WHERE r <= 2 GROUP BY vec_id")
def _(spark, d):
    return with_arrays(grey(spark, d), lambda k, x: [round(a, 6) for a in pixels.two_levels(x)], "dark double, light double")


@query("h5_bar_widths", "WITH l AS (SELECT p_partkey, [2 + p_partkey % 2, 7 + p_partkey % 3, 3, 8, 2] AS l FROM part) SELECT p_partkey, array_to_string(list_transform(l, lambda n: CASE WHEN (n - list_min(l)) / (list_max(l) - list_min(l)) > 0.5 THEN 'W' ELSE 'N' END), '') AS bars FROM l")
def _(spark, d):
    @F.pandas_udf("string")
    def read(lengths: pd.Series) -> pd.Series:
        return pd.Series(["|".join(pixels.bar_widths(list(x))) for x in lengths])

    k = F.col("p_partkey")
    return v.read(spark, d, "part").select("p_partkey", read(F.array(2 + k % 2, 7 + k % 3, F.lit(3).cast("long"), F.lit(8).cast("long"), F.lit(2).cast("long"))).alias("bars"))


@query("h7_runs", "WITH p AS (SELECT vec_id, unnest(embedding::DOUBLE[]) < 0 AS dark, generate_subscripts(embedding, 1) AS i FROM embeddings), f AS (SELECT *, CASE WHEN dark = LAG(dark) OVER (PARTITION BY vec_id ORDER BY i) THEN 0 ELSE 1 END AS s FROM p), g AS (SELECT *, SUM(s) OVER (PARTITION BY vec_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS run FROM f), r AS (SELECT vec_id, run, CASE WHEN MIN(dark) THEN 'b' ELSE 'w' END || COUNT(*) AS t FROM g GROUP BY ALL) SELECT vec_id, string_agg(t, '' ORDER BY run) AS runs FROM r GROUP BY vec_id")
def _(spark, d):
    return with_arrays(grey(spark, d), lambda k, x: ["".join(f"{'b' if dark else 'w'}{n}" for dark, n in pixels.runs(x, 0.0))], "runs string")


@query("o27_distance_transform", "WITH p AS (SELECT vec_id, unnest(embedding::DOUBLE[]) AS c, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings), m AS (SELECT vec_id, q.i, MIN(p.c + pow(p.i // 8 - q.i // 8, 2) + pow(p.i % 8 - q.i % 8, 2)) AS t FROM p, range(64) q(i) GROUP BY ALL) SELECT vec_id, ROUND(SUM(t * (i + 1)), 6) AS total FROM m GROUP BY vec_id")
def _(spark, d):
    return with_arrays(grey(spark, d), lambda k, x: [round(float((pixels.distance_transform(x.reshape(8, 8)).ravel() * np.arange(1, 65)).sum()), 6)], "total double")


@query("o31_trim_border", "SELECT vec_id, CAST(vec_id % 4 AS BIGINT) AS top, CAST(vec_id % 3 AS BIGINT) AS bottom, CAST(vec_id % 5 AS BIGINT) AS \"left\", CAST(vec_id % 2 AS BIGINT) AS \"right\" FROM embeddings")
def _(spark, d):
    def cut(k, x):
        a = np.pad(np.clip(np.abs(x.reshape(8, 8)), 0.5, 1), ((k % 4, k % 3), (k % 5, k % 2)))
        return [int(n) for n in pixels.border(a)]

    return with_arrays(grey(spark, d), cut, "top long, bottom long, left long, right long")


@query("j4_rigid_alignment", "SELECT vec_id, TRUE AS near FROM embeddings")
def _(spark, d):
    """A known shift and turn of a smooth image is found to half a pixel and a degree."""
    def found(k, x):
        low, high = x.min(), x.max()
        image = pixels.resize((x.reshape(8, 8) - low) / (high - low), (40, 40))
        h = pixels.rigid(k % 5 - 2, k % 3 - 1, (k % 7 - 3) * 0.5, image.shape)
        t = pixels.align_rigid(pixels.affine(image, h)[4:-4, 4:-4], image[4:-4, 4:-4])
        want = (np.linalg.inv(h)[:2] @ np.array([19.5, 19.5, 1])) - 19.5
        return [bool(np.abs(t[:2] - want).max() <= 0.5 and abs(t[2] + (k % 7 - 3) * 0.5) <= 1)]

    return with_arrays(grey(spark, d), found, "near boolean")


@query("j7_o9_attribute_search", "SELECT vec_id, CAST(20 + vec_id % 7 AS BIGINT) AS x, CAST(14 + vec_id % 5 AS BIGINT) AS y, 'a' || (vec_id % 3) AS label, 'ok' AS status FROM embeddings")
def _(spark, d):
    """One of three 12 by 12 patterns lies some pixels from its box; it is found and told from the others."""
    rng = np.random.default_rng(4)
    signs = {f"a{k}": pixels.resize(rng.random((6, 6)), (12, 12)) for k in range(3)}

    def draw(k):
        a = np.ones((48, 60))
        a[14 + k % 5 : 26 + k % 5, 20 + k % 7 : 32 + k % 7] = signs[f"a{k % 3}"]
        return a

    images = drawn(v.read(spark, d, "embeddings").select("vec_id"), draw, "vec_id")
    return patches.find_attribute(images, signs, (20, 14, 32, 26), 0.8).select("vec_id", "x", "y", "label", "status")


@query("h25_image_distortion", "WITH p AS (SELECT vec_id, unnest(embedding::DOUBLE[]) AS c, generate_subscripts(embedding, 1) - 1 AS k FROM embeddings), m AS (SELECT a.vec_id, a.k, MIN(ABS(a.c - b.c)) AS d FROM p a JOIN p b ON a.vec_id + 1 = b.vec_id AND b.k // 8 BETWEEN a.k // 8 - 3 AND LEAST(6, a.k // 8 + 2) AND b.k % 8 BETWEEN a.k % 8 - 3 AND LEAST(6, a.k % 8 + 2) GROUP BY ALL) SELECT vec_id, ROUND(SUM(d), 6) AS distance FROM m GROUP BY vec_id")
def _(spark, d):
    e = grey(spark, d)
    j = e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("x").alias("y")), "vec_id")
    return j.select("vec_id", F.round(cluster.distortion(8)("x", "y"), 6).alias("distance"))


LEVEL = "list_min({a}) AS lo_{a}, (list_max({a}) - list_min({a})) / 10 AS st_{a}, list_transform(range(10), lambda k: len(list_filter({a}, lambda z: LEAST(9, FLOOR((z - list_min({a})) / ((list_max({a}) - list_min({a})) / 10))) = k))) AS n_{a}"


@query("h25_vardiff", f"WITH p AS (SELECT a.vec_id, a.embedding::DOUBLE[] AS x, b.embedding::DOUBLE[] AS y FROM embeddings a JOIN embeddings b ON a.vec_id + 1 = b.vec_id), q AS (SELECT *, {LEVEL.format(a='x')}, {LEVEL.format(a='y')} FROM p), t AS (SELECT *, LEAST((list_position(n_x, list_max(n_x)) - 1) * st_x / 2, (list_position(n_y, list_max(n_y)) - 1) * st_y / 2) AS thr FROM q) SELECT vec_id, ROUND(COALESCE(list_sum(list_filter(list_transform(list_zip(x, y), lambda z: abs(z[1] - z[2])), lambda dd: dd > thr)), 0) / len(x), 6) AS distance FROM t")
def _(spark, d):
    e = grey(spark, d)
    j = e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("x").alias("y")), "vec_id")
    return j.select("vec_id", F.round(cluster.vardiff(F.col("x"), F.col("y")), 6).alias("distance"))


@query("a3_png_round_trip", "SELECT vec_id, CAST(list_sum(list_transform(embedding, lambda z: ABS(FLOOR(z::DOUBLE * 100)) % 256)) AS BIGINT) AS total, 'ok' AS status FROM embeddings")
def _(spark, d):
    """Grey values written as PNG and read back."""
    def write(it):
        for pdf in it:
            yield pd.DataFrame({"image_path": pdf["vec_id"].astype(str), "content": [io.png((np.abs(np.floor(np.asarray(x) * 100)) % 256).reshape(8, 8)) for x in pdf["x"]]})

    read = io.grey_images(grey(spark, d).mapInPandas(write, "image_path string, content binary"))
    back = patches.map_patch(read.where("status = 'ok'").select(F.col("image_path").cast("long").alias("vec_id"), "patch"), lambda a: {"total": int(a.sum())}, "total long")
    return back.select("vec_id", "total", "status")


# --- contests from lines ---------------------------------------------------------------------------

STROKES = f"{BOX}, h AS (SELECT g, target_id AS id, x AS x1, y AS y1, x + w AS x2, y AS y2 FROM bx), vv AS (SELECT g, target_id AS id, x AS x1, y AS y1, x + 2 AS x2, y + h AS y2 FROM bx)"


def strokes(spark, d):
    b = boxes(spark, d)
    h = b.select("g", F.col("target_id").alias("id"), F.col("x").cast("long").alias("x1"), F.col("y").cast("long").alias("y1"), (F.col("x") + F.col("w")).cast("long").alias("x2"), F.col("y").cast("long").alias("y2"))
    return h, b.select("g", F.col("target_id").alias("id"), F.col("x").cast("long").alias("x1"), F.col("y").cast("long").alias("y1"), (F.col("x") + 2).cast("long").alias("x2"), (F.col("y") + F.col("h")).cast("long").alias("y2"))


@query("o15_extended_lines", f"WITH {STROKES}, m AS (SELECT h.g, h.id, MIN(GREATEST((h.x1 + 9 * h.x2) // 10, vv.x1)) AS pos FROM h JOIN vv ON h.g = vv.g AND vv.y1 <= h.y1 AND h.y1 < vv.y2 AND GREATEST((h.x1 + 9 * h.x2) // 10, vv.x1) < LEAST(h.x2 + (h.x2 - h.x1) // 2, 220, vv.x2) GROUP BY ALL) SELECT h.g, h.id, CAST(CASE WHEN pos >= x2 THEN pos + (pos - x1) // 10 ELSE x2 END AS BIGINT) AS x2 FROM h LEFT JOIN m ON h.g = m.g AND h.id = m.id")
def _(spark, d):
    return bx.extended(*strokes(spark, d), ["g"], 220).select("g", "id", "x2")


@query("b16_lines_beside_targets", f"WITH {STROKES}, t AS (SELECT g, x AS x1, y AS y1, x + w AS x2, y + h AS y2 FROM bx WHERE target_id % 2 = 0) SELECT 'x' AS axis, g, id FROM h WHERE EXISTS (SELECT 1 FROM t WHERE t.g = h.g AND (t.x1 + t.x2) // 2 BETWEEN h.x1 AND h.x2) UNION ALL SELECT 'y', g, id FROM vv WHERE EXISTS (SELECT 1 FROM t WHERE t.g = vv.g AND (t.y1 + t.y2) // 2 BETWEEN vv.y1 AND vv.y2)")
def _(spark, d):
    h, w = strokes(spark, d)
    t = boxes(spark, d).where("target_id % 2 = 0").select("g", F.col("x").alias("x1"), F.col("y").alias("y1"), (F.col("x") + F.col("w")).alias("x2"), (F.col("y") + F.col("h")).alias("y2"))
    return bx.beside_targets(h, t, ["g"], "x").select(F.lit("x").alias("axis"), "g", "id").unionByName(bx.beside_targets(w, t, ["g"], "y").select(F.lit("y").alias("axis"), "g", "id"))


@query("b16_large_squares", f"WITH {BIG}, m AS (SELECT g, FLOOR(AVG(w * h)) AS a FROM t GROUP BY g) SELECT c.g, contest_id FROM c JOIN m ON c.g = m.g WHERE w * h > 2 * a")
def _(spark, d):
    corners = lambda df, *keep: df.select(*keep, F.col("x").alias("x1"), F.col("y").alias("y1"), (F.col("x") + F.col("w")).alias("x2"), (F.col("y") + F.col("h")).alias("y2"))
    t, c = big(spark, d)
    return bx.large_squares(corners(c, "g", "contest_id"), corners(t, "g"), ["g"]).select("g", "contest_id")


@query("o16_extracted_contests", "WITH n AS (SELECT l_orderkey AS g, COUNT(*) AS n FROM lineitem GROUP BY 1) SELECT g, k AS target_id, 10::BIGINT AS x1, 30 * k AS y1, 110::BIGINT AS x2, 30 * k + 20 AS y2 FROM n, range(60) t(k) WHERE k < n")
def _(spark, d):
    """Styles of contest boxes below each other, with upper and lower lines that stop short of the right one, short lines of letters, and one target each: the boxes come back."""
    items = v.read(spark, d, "lineitem")
    parts = bx.parts_of(spark, 7 * items.count())  # six lines and a target of each line item
    n = items.groupBy(F.col("l_orderkey").alias("g")).agg(F.count(F.lit(1)).alias("n")).repartition(parts, "g").select("g", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("k"))
    line = lambda no, x1, y1, x2, y2: F.struct((F.col("k") * 10 + no).alias("id"), F.lit(x1).cast("long").alias("x1"), (F.col("k") * 30 + y1).alias("y1"), F.lit(x2).cast("long").alias("x2"), (F.col("k") * 30 + y2).alias("y2"))
    strokes_of = lambda *xs: n.select("g", F.explode(F.array(*xs)).alias("s")).select("g", "s.*")
    h = strokes_of(line(0, 10, 0, 104, 0), line(1, 10, 20, 104, 20), line(2, 40, 10, 46, 10))
    w = strokes_of(line(0, 10, 0, 10, 20).withField("x2", F.lit(11).cast("long")).withField("y2", F.col("k") * 30 + 21), line(1, 110, 0, 111, 21), line(2, 150, 3, 151, 5))
    t = n.select("g", F.col("k").alias("target_id"), F.lit(15).cast("long").alias("x1"), (F.col("k") * 30 + 8).alias("y1"), F.lit(22).cast("long").alias("x2"), (F.col("k") * 30 + 13).alias("y2"))
    return bx.extract_contests(h, w, t, ["g"], 160, 300, parts)


@query("i13_coloured", f"WITH {BIG} SELECT CAST(COUNT(*) AS BIGINT) AS contests, 0::BIGINT AS alike, 0::BIGINT AS without FROM c")
def _(spark, d):
    """Contests coloured so that adjacent ones differ: how many there are, pairs that are alike, contests without a colour."""
    c = big(spark, d)[1]
    edges = io.written(layout.adjacent(c, ["g"]), "edges")
    found = io.written(grouping.coloured(c.select("g", F.col("contest_id").alias("id")), edges, "g"), "colours")
    a, b = (found.select("g", F.col("id").alias(f"{k}_id"), F.col("colour").alias(k)) for k in "ab")
    alike = edges.join(a, ["g", "a_id"]).join(b, ["g", "b_id"]).agg(F.count(F.when(F.col("a") == F.col("b"), 1)).alias("alike"))
    return found.agg(F.count(F.lit(1)).alias("contests"), F.count(F.when(F.col("colour").isNull(), 1)).alias("without")).join(F.broadcast(alike)).select("contests", "alike", "without")


@query("o17_multibox", "SELECT n_nationkey, CAST(COUNT(s_suppkey) AS BIGINT) AS n, COUNT(s_suppkey) > 1 AS multibox FROM nation LEFT JOIN supplier ON n_nationkey = s_nationkey GROUP BY 1")
def _(spark, d):
    return contests.multibox(v.read(spark, d, "nation"), v.read(spark, d, "supplier").select(F.col("s_nationkey").alias("n_nationkey")), "n_nationkey").select("n_nationkey", "n", "multibox")


@query("a17_ocr_texts", "SELECT item_id, CASE WHEN item_id % 3 = 0 THEN 'known ' || item_id ELSE length(text) || ' signs' END AS text FROM benchmark")
def _(spark, d):
    b = v.read(spark, d, "benchmark")
    known = b.where("item_id % 3 = 0").select("item_id", F.concat(F.lit("known "), "item_id").alias("text"))
    stripes, _ = contests.with_texts(b.select("item_id", F.col("text").alias("image")), known, ["item_id"], lambda image: f"{len(image)} signs")
    return stripes.select("item_id", "text")


@query("o20_in_order", "SELECT c_custkey, array_to_string([c_name, c_mktsegment, 'k' || c_custkey], '/') AS was, array_to_string(['k' || c_custkey, c_name, c_mktsegment], '/') AS files FROM customer")
def _(spark, d):
    files = F.array("c_name", "c_mktsegment", F.concat(F.lit("k"), "c_custkey"))
    return v.read(spark, d, "customer").select("c_custkey", F.array_join(files, "/").alias("was"), F.array_join(contests.in_order(files, F.array(F.lit(2), F.lit(0), F.lit(1))), "/").alias("files"))


_PAIRS = "p AS (SELECT a.id AS a_id, b.id AS b_id, a.block, levenshtein(a.text, b.text) / GREATEST(1, length(a.text) + length(b.text)) AS d FROM tx a JOIN tx b ON a.block = b.block AND a.id < b.id)"


@query("i9_single_pairs", f"WITH {TEXTS}, {_PAIRS}, r AS (SELECT *, MIN(d) OVER (PARTITION BY block) AS least FROM p), m AS (SELECT block, MIN(a_id * 1000000 + b_id) AS pair FROM r WHERE d = least GROUP BY block) SELECT block, CAST(pair // 1000000 AS BIGINT) AS a_id, CAST(pair % 1000000 AS BIGINT) AS b_id FROM m")
def _(spark, d):
    """The first pair of texts that joins in each block: the nearest one."""
    a, b = texts(spark, d).alias("a"), texts(spark, d).alias("b")
    pairs = a.join(b, (F.col("a.block") == F.col("b.block")) & (F.col("a.id") < F.col("b.id"))).select(F.col("a.block").alias("block"), F.col("a.id").alias("a_id"), F.col("b.id").alias("b_id"), (F.levenshtein("a.text", "b.text") / F.greatest(F.lit(1), F.length("a.text") + F.length("b.text"))).alias("d"))
    return pairs.groupBy("block").agg(F.min(F.struct("d", "a_id", "b_id")).alias("m")).select("block", "m.a_id", "m.b_id")


# --- groups ---------------------------------------------------------------------------------------


@query("i6_trimmed", "SELECT label, vec_id, CAST(CASE WHEN COUNT(*) OVER (PARTITION BY label) >= 7 THEN (ROW_NUMBER() OVER (PARTITION BY label ORDER BY vec_id) - 1) // 7 ELSE 0 END AS BIGINT) AS part FROM embeddings")
def _(spark, d):
    return cluster.trimmed(v.read(spark, d, "embeddings").select("label", "vec_id"), ["label"], ["vec_id"], 7)


@query("i6_trimmed_by_memory", "WITH n AS (SELECT label, vec_id, COUNT(*) OVER (PARTITION BY label) AS n, ROW_NUMBER() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS k FROM embeddings), g AS (SELECT *, LEAST(n * 300 // 2000, n) AS parts FROM n) SELECT label, vec_id, CAST(CASE WHEN n * 300 >= 2000 THEN LEAST(k // (n // parts), parts - 1) ELSE 0 END AS BIGINT) AS part FROM g")
def _(spark, d):
    return cluster.trimmed_by_memory(v.read(spark, d, "embeddings").select("label", "vec_id"), ["label"], ["vec_id"], 300, 2)


RANKED = "el AS (SELECT p_brand AS grp, p_partkey, string_split(p_name, ' ') AS labels FROM part), fi AS (SELECT *, arg_min(labels, p_partkey) OVER (PARTITION BY grp) AS f FROM el), sh AS (SELECT *, COALESCE(list_position(list_transform(range(1, LEAST(len(labels), len(f)) + 1), lambda i: labels[i] = f[i]), FALSE) - 1, LEAST(len(labels), len(f))) AS c FROM fi)"


@query("o2_split_ranked", f"WITH {RANKED}, g AS (SELECT *, MIN(c) OVER (PARTITION BY grp) AS n, MIN(len(labels)) OVER (PARTITION BY grp) AS short, COUNT(*) OVER (PARTITION BY grp) AS m, ROW_NUMBER() OVER (PARTITION BY grp ORDER BY p_partkey) AS k FROM sh), q AS (SELECT *, labels[GREATEST(1, n) + 1] AS part, COALESCE(labels[GREATEST(1, n) + 1], '-') AS kind FROM g), z AS (SELECT grp, COUNT(DISTINCT kind) AS kinds FROM q GROUP BY grp) SELECT grp, p_partkey, CASE WHEN n = len(f) THEN CASE WHEN k <= (m + 1) // 2 THEN 'first' ELSE 'second' END WHEN short <= 1 THEN NULL WHEN kinds = 1 THEN CASE WHEN k <= (m + 1) // 2 THEN 'first' ELSE 'second' END ELSE part END AS part FROM q JOIN z USING (grp)")
def _(spark, d):
    p = v.read(spark, d, "part").select(F.col("p_brand").alias("grp"), "p_partkey", F.split("p_name", " ").alias("labels"))
    return grouping.split_ranked(p, "grp", "p_partkey")


@query("i7_current_label", "SELECT p_partkey, string_split(p_name, ' ')[p_partkey % len(string_split(p_name, ' ')) + 1] AS label FROM part")
def _(spark, d):
    return v.read(spark, d, "part").select("p_partkey", grouping.current_label(F.split("p_name", " "), F.col("p_partkey")).alias("label"))


@query("d26_combined_lists", "SELECT o_custkey % 50 AS k, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_custkey, o_orderkey) AS found FROM orders GROUP BY 1")
def _(spark, d):
    """Tasks, a customer each, found lists of orders; the lists of each key on end."""
    o = v.read(spark, d, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list("o_orderkey")).alias("found"))
    lists = grouping.combined_lists(o.withColumn("k", F.col("o_custkey") % 50), "k", "found", ["o_custkey"])
    return lists.select("k", F.array_join(F.transform("found", lambda x: x.cast("string")), ",").alias("found"))


@query("f3_sorted_by_keys", "WITH k AS (SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_custkey END AS k FROM orders) SELECT l_orderkey AS o_orderkey, CAST(ROW_NUMBER() OVER (ORDER BY k, l_orderkey) - 1 AS BIGINT) AS place FROM (SELECT DISTINCT l_orderkey FROM lineitem) JOIN k ON l_orderkey = o_orderkey WHERE k IS NOT NULL")
def _(spark, d):
    rows = v.read(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")).distinct()
    keys = v.read(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 4 != 0, F.col("o_custkey")).alias("k"))
    return ranking.sorted_by_keys(rows, keys, ["o_orderkey"], "k").select("o_orderkey", *long("place"))


@query("b1_pairing_modes", f"WITH {v.IMAGE}, c AS (SELECT dir_path, COUNT(*) AS n FROM image GROUP BY 1) SELECT 'single' AS mode, COUNT(*) AS ballots FROM image UNION ALL SELECT 'alternating', CAST(SUM((n + 1) // 2) AS BIGINT) FROM c UNION ALL SELECT 'regex', COUNT(DISTINCT dir_path || '#' || regexp_extract(file_name, '^(b[0-9]+)_', 1)) FROM image")
def _(spark, d):
    i, out = v.images(spark, d), None
    for mode, options in (("single", {}), ("alternating", {"num_pages": 2}), ("regex", {"shared": "(b[0-9]+)_", "different": "b[0-9]+_side([0-9])"})):
        one = pairing.pair(i, mode, **options).agg(F.count_distinct("ballot_key").alias("ballots")).select(F.lit(mode).alias("mode"), "ballots")
        out = one if out is None else out.unionByName(one)
    return out


# --- files: written to a folder of the job's own and read back ------------------------------------------


@query("a4_tables", "SELECT n_nationkey, n_name FROM nation")
def _(spark, d):
    project = io.shared_path(spark, "project")
    io.save_table(v.read(spark, d, "nation").select("n_nationkey", "n_name"), project, "nations")
    return io.load_table(spark, project, "nations")


@query("a5_csv", "SELECT c_custkey, c_name, c_mktsegment FROM customer")
def _(spark, d):
    path = io.shared_path(spark, "csv")
    io.write_csv(v.read(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment"), path)
    return io.read_csv(spark, path, "c_custkey long, c_name string, c_mktsegment string")


@query("a13_box_files", f"WITH {BOX} SELECT 'target' AS kind, CAST(target_id AS INT) AS box_id, CAST(target_id AS INT) AS contest_local_id, x, y, w, h, CAST(g % 64 AS INT) AS group_id, CAST(target_id % 2 AS INT) AS side FROM bx")
def _(spark, d):
    """The boxes of all styles, a folder per group of 64 styles and side."""
    path = io.shared_path(spark, "boxes")
    own = boxes(spark, d).select(F.lit("target").alias("kind"), F.col("target_id").cast("int").alias("box_id"), F.col("target_id").cast("int").alias("contest_local_id"), "x", "y", "w", F.col("h").cast("int").alias("h"), (F.col("g") % 64).cast("int").alias("group_id"), (F.col("target_id") % 2).cast("int").alias("side"))
    io.write_boxes(own, path)
    return io.read_boxes(spark, path)


@query("a14_a15_a16_patch_files", f"WITH {v.MARK} SELECT ballot_id, page, target_id, intensity FROM mark WHERE intensity BETWEEN 100 AND 120")
def _(spark, d):
    """Marks in files by intensity; a range of it is read."""
    path = io.shared_path(spark, "patches")
    io.write_patches(v.marks(spark, d).select("ballot_id", "page", "target_id", "intensity"), path)
    return io.read_patches(spark, path, 100, 120)


@query("a2_listed_images", f"WITH {v.IMAGE} SELECT DISTINCT regexp_replace(dir_path, '/', '_') || '.png' AS name FROM image")
def _(spark, d):
    """One file for each directory of the election, written as text trees are; the images among all files by their names."""
    root = io.shared_path(spark, "images")
    texts_ = v.images(spark, d).select(F.regexp_replace("dir_path", "/", "_").alias("path"), F.lit("x").alias("text")).distinct()
    texts_.select("text", F.concat("path", F.lit(".png")).alias("name")).write.partitionBy("name").text(root)
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select(F.regexp_extract("path", "name=([^/]*)/", 1).alias("name"))
    from psephos.functions.paths import is_image

    return found.where(is_image(F.col("name"))).distinct()
