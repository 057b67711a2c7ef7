"""Queries on boxes, vendors and pixels; registered with the others."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from psephos.operators import boxes as bx
from psephos.operators import pairing, pixels, vendors
from psephos.plans import views as v
from psephos.plans.queries import BIG, BOX, HART, WEIGHTS, big, boxes, hart, query

LINES = f"{BOX}, hl AS (SELECT g, target_id AS id, y, x AS x1, x + w AS x2 FROM bx), vl AS (SELECT g, target_id AS id, x, y AS y1, y + h AS y2 FROM bx), hm AS MATERIALIZED (SELECT * FROM hl), vm AS MATERIALIZED (SELECT * FROM vl), hv AS MATERIALIZED (SELECT hm.g, hm.id AS h_id, vm.id AS v_id, vm.x, hm.y, x1, x2, y1, y2 FROM hm JOIN vm ON hm.g = vm.g), cr AS (SELECT g, h_id, v_id, x, y FROM hv WHERE x BETWEEN x1 AND x2 AND y BETWEEN y1 AND y2)"


def lines(spark, d):
    b = boxes(spark, d)
    h = b.select("g", F.col("target_id").alias("id"), "y", F.col("x").alias("x1"), (F.col("x") + F.col("w")).alias("x2"))
    return h, b.select("g", F.col("target_id").alias("id"), "x", F.col("y").alias("y1"), (F.col("y") + F.col("h")).alias("y2"))


def scored(spark, d):
    return boxes(spark, d).withColumn("score", F.round((F.col("x") * 7 + F.col("y") * 3) % 101 / 100, 2))


@query("b12_score_filter", f"WITH {BOX} SELECT g, target_id, ROUND((x * 7 + y * 3) % 101 / 100, 2) AS score FROM bx WHERE ROUND((x * 7 + y * 3) % 101 / 100, 2) >= 0.8")
def _(spark, d):
    return bx.score_filter(scored(spark, d), 0.8).select("g", "target_id", "score")


@query(
    "c14_greedy_accept",
    f"""WITH RECURSIVE {BOX}, sc AS (SELECT g, target_id AS id, x + w / 2 AS cx, y + h / 2 AS cy, w, h, ROW_NUMBER() OVER (PARTITION BY g ORDER BY ROUND((x * 7 + y * 3) % 101 / 100, 2) DESC, target_id) AS k FROM bx),
s AS (SELECT g, id, k, TRUE AS taken, [struct_pack(a := cx, b := cy)] AS held FROM sc WHERE k = 1
 UNION ALL SELECT sc.g, sc.id, sc.k, len(list_filter(s.held, lambda t: NOT (abs(cx - t.a) >= 0.5 * w OR abs(cy - t.b) >= 0.5 * h))) = 0,
  CASE WHEN len(list_filter(s.held, lambda t: NOT (abs(cx - t.a) >= 0.5 * w OR abs(cy - t.b) >= 0.5 * h))) = 0 THEN list_append(s.held, struct_pack(a := cx, b := cy)) ELSE s.held END
  FROM s JOIN sc ON s.g = sc.g AND s.k + 1 = sc.k)
SELECT g, id, taken FROM s""",
)
def _(spark, d):
    return bx.greedy_accept(scored(spark, d).withColumnRenamed("target_id", "id"), "g")


@query(
    "e13_snap_columns",
    f"""WITH RECURSIVE {BOX}, so AS (SELECT g, target_id AS id, x, y, ROW_NUMBER() OVER (PARTITION BY g ORDER BY target_id) AS k FROM bx),
s AS (SELECT g, id, k, y, CAST(x AS DOUBLE) AS col, [CAST(x AS DOUBLE)] AS cols FROM so WHERE k = 1
 UNION ALL SELECT so.g, so.id, so.k, so.y, COALESCE(list_filter(cols, lambda c: abs(c - x) < 15)[1], x), CASE WHEN len(list_filter(cols, lambda c: abs(c - x) < 15)) > 0 THEN cols ELSE list_append(cols, CAST(x AS DOUBLE)) END FROM s JOIN so ON s.g = so.g AND s.k + 1 = so.k)
SELECT g, id, col, ROW_NUMBER() OVER (PARTITION BY g ORDER BY col, y, id) - 1 AS place FROM s""",
)
def _(spark, d):
    return bx.snap_columns(boxes(spark, d).select("g", F.col("target_id").alias("id"), "x", "y", F.lit(300).alias("page_width")), "g")


@query("c19_line_crossings", f"WITH {LINES} SELECT g, h_id, v_id, x, y FROM cr")
def _(spark, d):
    return bx.crossings(*lines(spark, d), ["g"])


@query(
    "i14_rectangles",
    f"WITH {LINES}, cm AS MATERIALIZED (SELECT * FROM cr), ab AS MATERIALIZED (SELECT a.g, a.v_id AS l, b.v_id AS r, a.x AS x1, b.x AS x2, a.y FROM cm a JOIN cm b ON a.g = b.g AND a.h_id = b.h_id), top AS MATERIALIZED (SELECT * FROM ab WHERE x1 < x2), tu AS MATERIALIZED (SELECT t.g, t.x1, t.y AS y1, t.x2, u.y AS y2 FROM top t JOIN top u ON t.g = u.g AND t.l = u.l AND t.r = u.r) SELECT * FROM tu WHERE y1 < y2 AND (x2 - x1) * (y2 - y1) >= 4",
)
def _(spark, d):
    return bx.rectangles(bx.crossings(*lines(spark, d), ["g"]), ["g"], 4)


SMALL = f"{BIG}, sm AS (SELECT t.g, t.target_id, arg_min(struct_pack(x1 := c.x, y1 := c.y, x2 := c.x + c.w, y2 := c.y + c.h), struct_pack(a := c.w * c.h, x1 := c.x, y1 := c.y, x2 := c.x + c.w, y2 := c.y + c.h)) AS m FROM t JOIN c ON t.g = c.g AND t.x + t.w / 2 BETWEEN c.x AND c.x + c.w AND t.y + t.h / 2 BETWEEN c.y AND c.y + c.h GROUP BY ALL)"


def small(spark, d):
    t, c = big(spark, d)
    corners = c.select("g", F.col("x").alias("x1"), F.col("y").alias("y1"), (F.col("x") + F.col("w")).alias("x2"), (F.col("y") + F.col("h")).alias("y2"))
    return bx.smallest_boxes(corners, t, ["g"])


@query("i15_smallest_boxes", f"WITH {SMALL} SELECT g, target_id, m.x1, m.y1, m.x2, m.y2 FROM sm")
def _(spark, d):
    return small(spark, d)


@query("i12_merge_contests", f"WITH {SMALL} SELECT g, target_id // 4 AS group_no, MIN(m.x1) AS x1, MIN(m.y1) AS y1, MAX(m.x2) AS x2, MAX(m.y2) AS y2, CAST(COUNT(*) AS BIGINT) AS n_targets FROM sm GROUP BY ALL")
def _(spark, d):
    given = big(spark, d)[0].select("g", "target_id", F.floor(F.col("target_id") / 4).alias("group_no"))
    return bx.merge_contests(small(spark, d), given, ["g"])


@query("h23_split_contest", f"WITH {BIG}, s AS (SELECT g, contest_id, y AS y1, y + h AS y2, y + h // 2 AS cut, CAST(FLOOR(h * 0.05) AS INT) AS m FROM c) SELECT g, contest_id, 0 AS part, CAST(y1 AS BIGINT) AS y1, CAST(LEAST(y2, cut + m) AS BIGINT) AS y2 FROM s UNION ALL SELECT g, contest_id, 1, CAST(GREATEST(y1, cut - m) AS BIGINT), CAST(y2 AS BIGINT) FROM s")
def _(spark, d):
    c = big(spark, d)[1].select("g", "contest_id", F.col("y").alias("y1"), (F.col("y") + F.col("h")).alias("y2"), (F.col("y") + F.floor(F.col("h") / 2)).alias("at"))
    return bx.split_at(c).select("g", "contest_id", "part", F.col("y1").cast("long").alias("y1"), F.col("y2").cast("long").alias("y2"))


@query(
    "h22_stripes",
    f"WITH {BIG}, k AS (SELECT a.g, a.contest_id, a.target_id, t.y AS top, LEAD(t.y) OVER w AS nxt, ROW_NUMBER() OVER w AS stripe FROM asg a JOIN t ON a.g = t.g AND a.target_id = t.target_id WHERE a.contest_id IS NOT NULL WINDOW w AS (PARTITION BY a.g, a.contest_id ORDER BY t.y, a.target_id)), j AS (SELECT k.*, c.y AS cy, c.h AS ch FROM k JOIN c ON k.g = c.g AND k.contest_id = c.contest_id) SELECT g, contest_id, CAST(stripe AS INT) AS stripe, top, COALESCE(nxt, cy + ch) AS bottom FROM j UNION ALL SELECT g, contest_id, 0, cy, top FROM j WHERE stripe = 1",
)
def _(spark, d):
    from psephos.operators.layout import assign_targets

    t, c = big(spark, d)
    own = assign_targets(t, c, ["g"]).where("contest_id is not null")
    return bx.stripes(c, own, ["g"])


@query("j_alignment_grid", "WITH e AS (SELECT (l_partkey % 21 - 10) / 1.0 AS dx, (l_suppkey % 15 - 7) / 1.0 AS dy, (l_linenumber - 4) / 40.0 AS dt FROM lineitem) SELECT CAST(t AS DOUBLE) AS tolerance, CAST(COUNT(*) FILTER (WHERE ABS(dx) <= t AND ABS(dy) <= t AND ABS(dt) <= t / 100.0) AS BIGINT) AS good, CAST(COUNT(*) AS BIGINT) AS n FROM e, (VALUES (2), (4), (6), (8)) g(t) GROUP BY t")
def _(spark, d):
    e = v.read(spark, d, "lineitem").select(((F.col("l_partkey") % 21 - 10) / 1.0).alias("dx"), ((F.col("l_suppkey") % 15 - 7) / 1.0).alias("dy"), ((F.col("l_linenumber") - 4) / 40.0).alias("dt"))
    return bx.alignment_grid(e, [2, 4, 6, 8])


@query("l_o37_vendor_decode", f"WITH c AS (SELECT {HART} AS code FROM lineitem), s AS (SELECT code, (1 + {WEIGHTS}) % 97 AS t FROM c), k AS (SELECT CASE WHEN CASE t WHEN 1 THEN 98 WHEN 0 THEN 97 ELSE t END = CAST(substr(code, 13, 2) AS INT) THEN 'ok' ELSE 'err' END AS status FROM s) SELECT status, CAST(COUNT(*) AS BIGINT) AS n FROM k GROUP BY 1")
def _(spark, d):
    rows = hart(spark, d).select(F.col("code").alias("raw"), F.col("l_orderkey").alias("ballot_id"), F.col("l_linenumber").alias("page"))
    return vendors.VENDORS["hart"]().decode(rows).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query("l_d8_directory_partitions", f"WITH {v.IMAGE}, t AS (SELECT ballot_id, arg_min(split_part(dir_path, '/', 2), page) AS tag FROM image GROUP BY 1) SELECT ballot_id, tag, CAST(DENSE_RANK() OVER (ORDER BY tag) - 1 AS BIGINT) AS partition_id FROM t")
def _(spark, d):
    parts, _ = vendors.partition(v.images(spark, d), "dirname")
    return parts.select("ballot_id", "tag", "partition_id")


@query("o22_o23_exemplar_lists", f"WITH {v.IMAGE}, r AS (SELECT precinct, image_path, ROW_NUMBER() OVER (PARTITION BY precinct ORDER BY image_path) AS k FROM image JOIN attr USING (ballot_id) WHERE img_ord = 0) SELECT precinct, string_agg(image_path, ',' ORDER BY image_path) AS exemplars FROM r WHERE k <= 5 GROUP BY 1")
def _(spark, d):
    first = v.images(spark, d).where("img_ord = 0").join(v.attributes(spark, d).select("ballot_id", "precinct"), "ballot_id")
    return pairing.first_n(first, ["precinct"], ["image_path"], 5).groupBy("precinct").agg(F.array_join(F.array_sort(F.collect_list("image_path")), ",").alias("exemplars"))


def _patches(spark, d):
    return v.read(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("patch"))


@query("j_flip", "SELECT vec_id, ROUND(embedding[64]::DOUBLE, 6) AS first, ROUND(embedding[1]::DOUBLE, 6) AS last FROM embeddings")
def _(spark, d):
    def run(it):
        for pdf in it:
            f = [pixels.flip(np.reshape(p, (8, 8))).ravel() for p in pdf["patch"]]
            yield pd.DataFrame({"vec_id": pdf["vec_id"], "first": [round(x[0], 6) for x in f], "last": [round(x[-1], 6) for x in f]})

    return _patches(spark, d).mapInPandas(run, "vec_id long, first double, last double")


@query("j_f6_best_match", "SELECT vec_id, CAST(vec_id % 5 AS BIGINT) AS x, CAST(vec_id % 4 AS BIGINT) AS y, 1.0::DOUBLE AS score FROM embeddings")
def _(spark, d):
    """A 4 by 4 piece cut out of each 8 by 8 patch is found where it was."""
    def run(it):
        for pdf in it:
            out = []
            for i, p in zip(pdf["vec_id"], pdf["patch"]):
                a = np.reshape(p, (8, 8))
                x, y, s = pixels.best_match(a, a[i % 4 : i % 4 + 4, i % 5 : i % 5 + 4])
                out.append((i, x, y, round(s, 6)))
            yield pd.DataFrame(out, columns=["vec_id", "x", "y", "score"])

    return _patches(spark, d).mapInPandas(run, "vec_id long, x long, y long, score double")


@query("j_align_evaluation", "SELECT t::DOUBLE AS tolerance, CAST(COUNT(*) AS BIGINT) AS good, CAST(COUNT(*) AS BIGINT) AS n FROM embeddings, (VALUES (0.5), (1), (2)) g(t) GROUP BY t")
def _(spark, d):
    """Known shifts of smooth images, recovered; the errors' share within tolerances."""
    def run(it):
        for pdf in it:
            rows = []
            for i, p in zip(pdf["vec_id"], pdf["patch"]):
                image = pixels.resize(np.reshape(p, (8, 8)), (40, 40))
                dx, dy = int(i % 5) - 2, int(i % 3) - 1
                moved = pixels.affine(image, np.array([[1, 0, dx], [0, 1, dy], [0, 0, 1.0]]))
                found = pixels.align_shift(moved[4:-4, 4:-4], image[4:-4, 4:-4])
                rows.append((found[0] + dx, found[1] + dy, 0.0))
            yield pd.DataFrame(rows, columns=["dx", "dy", "dt"])

    return bx.alignment_grid(_patches(spark, d).mapInPandas(run, "dx double, dy double, dt double"), [0.5, 1, 2])


@query("d15_target_extraction", "SELECT vec_id, CAST(t AS INT) AS target_id, ROUND(255 * (embedding[t * 4 + 1]::DOUBLE + embedding[t * 4 + 2]::DOUBLE + embedding[t * 4 + 9]::DOUBLE + embedding[t * 4 + 10]::DOUBLE) / 4, 3) + 0.0::DOUBLE AS intensity FROM embeddings, range(2) g(t)")
def _(spark, d):
    """Mean intensity of two 2 by 2 targets of every 8 by 8 patch."""
    from psephos.operators import patches

    p = patches.from_array(_patches(spark, d).withColumnRenamed("patch", "values"), "values", 8).select("vec_id", "patch")
    return patches.extract(p, [(0, 0, 2, 2), (4, 0, 6, 2)]).select("vec_id", "target_id", (F.round("intensity", 3) + 0.0).alias("intensity"))


@query("i11_equivalence_classes")
def _(spark, d):
    from psephos.operators.contests import equivalence_classes
    from psephos.plans.queries import texts

    return equivalence_classes(texts(spark, d).select("id", F.lit("eng").alias("language"), "title", "choices"))
