"""Boxes found in scans: order-dependent choices within a style, lines and rectangles, contests from targets."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def score_filter(found: DataFrame, least: float) -> DataFrame:
    """Matches with a score of `least` or more."""
    return found.where(F.col("score") >= least)


def in_turn(df: DataFrame, by: str, order: list, columns: list[str], fn, schema: str) -> DataFrame:
    """What fn makes of each group's rows, in order: rows are sorted by group within partitions and handed over in batches, so a style costs its rows and no table of its own.

    fn takes lists of the columns and returns lists of what schema has after `by`.
    """
    def run(it):
        held = None
        for pdf in it:
            pdf = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            if not len(pdf):
                continue
            keys = pdf[by].to_numpy()
            cuts = [0, *(np.nonzero(keys[1:] != keys[:-1])[0] + 1).tolist()]
            held = pdf.iloc[cuts[-1] :].reset_index(drop=True)  # the last group may go on
            if len(cuts) > 1:
                yield made(pdf.iloc[: cuts[-1]], cuts)
        if held is not None:
            yield made(held, [0, len(held)])

    def made(pdf, cuts):
        values, keys, out = [pdf[c].tolist() for c in columns], pdf[by].tolist(), []
        for f, e in zip(cuts[:-1], cuts[1:]):
            out += [(keys[f], *row) for row in zip(*fn(*[x[f:e] for x in values]))]
        return pd.DataFrame(out, columns=[c.split()[0] for c in schema.split(", ")])

    return df.repartition(by).sortWithinPartitions(by, *order).select(by, *columns).mapInPandas(run, schema)


def greedy_accept(found: DataFrame, by: str, apart: float = 0.5) -> DataFrame:
    """Best first within a style, a match is taken unless its centre is within `apart` of its size of one taken before (style, id, x, y, w, h, score).

    Taken ones lie in a grid of the style's largest size, so each match is held against its neighbours only.
    """
    def run(ids, x, y, w, h):
        taken: dict = {}
        keep, sx, sy = [], max(max(w) * apart, 1e-9), max(max(h) * apart, 1e-9)
        for a, b, u, v in zip(x, y, w, h):
            cx, cy = a + u / 2, b + v / 2
            i, j = int(cx // sx), int(cy // sy)
            near = (t for p in (i - 1, i, i + 1) for q in (j - 1, j, j + 1) for t in taken.get((p, q), ()))
            free = all(abs(cx - tx) >= apart * u or abs(cy - ty) >= apart * v for tx, ty in near)
            keep.append(free)
            if free:
                taken.setdefault((i, j), []).append((cx, cy))
        return ids, keep

    return in_turn(found, by, [F.desc("score"), "id"], ["id", "x", "y", "w", "h"], run, f"{by} {dict(found.dtypes)[by]}, id long, taken boolean")


def snap_columns(targets: DataFrame, by: str, share: float = 20.0) -> DataFrame:
    """Reading order within a style: x is snapped to the first column within width / share, in order of id; then by column and y (style, id, x, y, page_width)."""
    def run(ids, x, y, width):
        columns: list[float] = []
        snapped = []
        for a, w in zip(x, width):
            near = next((c for c in columns if abs(c - a) < w / share), None)
            if near is None:
                columns.append(near := a)
            snapped.append(float(near))
        order = sorted(range(len(ids)), key=lambda i: (snapped[i], y[i], ids[i]))
        return [ids[i] for i in order], [snapped[i] for i in order], list(range(len(ids)))

    return in_turn(targets, by, ["id"], ["id", "x", "y", "page_width"], run, f"{by} {dict(targets.dtypes)[by]}, id long, col double, place long")


def crossings(horizontal: DataFrame, vertical: DataFrame, on: list[str]) -> DataFrame:
    """Where lines cross: horizontal (id, y, x1, x2) and vertical (id, x, y1, y2)."""
    h, v = horizontal.alias("h"), vertical.alias("v")
    cond = (F.col("v.x").between(F.col("h.x1"), F.col("h.x2"))) & (F.col("h.y").between(F.col("v.y1"), F.col("v.y2")))
    for k in on:
        cond = cond & (F.col(f"h.{k}") == F.col(f"v.{k}"))
    return h.join(v, cond).select(*[F.col(f"h.{k}") for k in on], F.col("h.id").alias("h_id"), F.col("v.id").alias("v_id"), F.col("v.x").alias("x"), F.col("h.y").alias("y"))


def rectangles(cross: DataFrame, on: list[str], least_area: int, parts: int | None = None) -> DataFrame:
    """Four crossings of two horizontal with two vertical lines: 4-cycles of the line graph, of least_area or more.  parts: crossings and sides are dealt into so many parts, if given."""
    dealt = lambda df, *by: df if parts is None else df.repartition(parts, *by)
    cross = dealt(cross, *on, "h_id")
    a, b = cross.alias("a"), cross.alias("b")
    same = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in on]
    side = (F.col("a.h_id") == F.col("b.h_id")) & (F.col("a.x") < F.col("b.x"))
    for s in same:
        side = side & s
    top = a.join(b, side).select(*[F.col(f"a.{k}") for k in on], F.col("a.v_id").alias("left"), F.col("b.v_id").alias("right"), F.col("a.x").alias("x1"), F.col("b.x").alias("x2"), F.col("a.y").alias("y"))
    top = dealt(top, *on, "left", "right")
    t, u = top.alias("t"), top.alias("u")
    cond = (F.col("t.left") == F.col("u.left")) & (F.col("t.right") == F.col("u.right")) & (F.col("t.y") < F.col("u.y"))
    for k in on:
        cond = cond & (F.col(f"t.{k}") == F.col(f"u.{k}"))
    found = t.join(u, cond).select(*[F.col(f"t.{k}") for k in on], "t.x1", F.col("t.y").alias("y1"), "t.x2", F.col("u.y").alias("y2"))
    return found.where((F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1")) >= least_area)


def smallest_boxes(boxes: DataFrame, targets: DataFrame, on: list[str]) -> DataFrame:
    """Each target goes to the smallest box that holds its centre (ties by corner); boxes that get none are dropped.  Returns on, target_id, x1, y1, x2, y2."""
    b, t = boxes.alias("b"), targets.alias("t")
    cx, cy = F.col("t.x") + F.col("t.w") / 2, F.col("t.y") + F.col("t.h") / 2
    cond = cx.between(F.col("b.x1"), F.col("b.x2")) & cy.between(F.col("b.y1"), F.col("b.y2"))
    for k in on:
        cond = cond & (F.col(f"b.{k}") == F.col(f"t.{k}"))
    area = (F.col("b.x2") - F.col("b.x1")) * (F.col("b.y2") - F.col("b.y1"))
    best = F.min(F.struct(area.alias("area"), F.col("b.x1").alias("x1"), F.col("b.y1").alias("y1"), F.col("b.x2").alias("x2"), F.col("b.y2").alias("y2"))).alias("m")
    return t.join(b, cond).groupBy(*[F.col(f"t.{k}") for k in on], F.col("t.target_id")).agg(best).select(*on, "target_id", "m.x1", "m.y1", "m.x2", "m.y2")


def merge_contests(assigned: DataFrame, given: DataFrame, on: list[str]) -> DataFrame:
    """Boxes that share a given target group are one contest: its bounding box (assigned: on, target_id, box corners; given: on, target_id, group_no)."""
    j = assigned.join(given, [*on, "target_id"])
    return j.groupBy(*on, "group_no").agg(F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2"), F.count(F.lit(1)).alias("n_targets"))


def split_at(contests: DataFrame, axis: str = "y", pad: float = 0.05) -> DataFrame:
    """A contest (id, x1..y2, at) cut in two at a coordinate; each part keeps a margin of pad of the whole over the cut."""
    lo, hi = f"{axis}1", f"{axis}2"
    margin = F.floor((F.col(hi) - F.col(lo)) * pad)
    first = contests.withColumn("part", F.lit(0)).withColumn(hi, F.least(F.col(hi), F.col("at") + margin))
    second = contests.withColumn("part", F.lit(1)).withColumn(lo, F.greatest(F.col(lo), F.col("at") - margin))
    return first.unionByName(second)


def stripes(contests: DataFrame, targets: DataFrame, on: list[str]) -> DataFrame:
    """Horizontal stripes of a contest box, one above the first target and one for each, down to the next (contest_id, x, y, w, h; targets with contest_id)."""
    w = Window.partitionBy(*on, "contest_id").orderBy("y", "target_id")
    t = targets.select(*on, "contest_id", "target_id", F.col("y").alias("top"), F.lead("y").over(w).alias("next"), (F.row_number().over(w)).alias("stripe"))
    j = t.join(contests.select(*on, "contest_id", F.col("y").alias("cy"), F.col("h").alias("ch")), [*on, "contest_id"])
    own = j.select(*on, "contest_id", "stripe", "top", F.coalesce("next", F.col("cy") + F.col("ch")).alias("bottom"))
    title = j.where("stripe = 1").select(*on, "contest_id", F.lit(0).alias("stripe"), F.col("cy").alias("top"), F.col("top").alias("bottom"))
    return own.unionByName(title)


def alignment_grid(errors: DataFrame, tolerances: list[float]) -> DataFrame:
    """Share of alignments within each tolerance (dx, dy, dt found against expected)."""
    grid = F.explode(F.array(*[F.lit(float(t)) for t in tolerances])).alias("tolerance")
    rows = errors.select("dx", "dy", "dt", grid)
    good = (F.abs("dx") <= F.col("tolerance")) & (F.abs("dy") <= F.col("tolerance")) & (F.abs("dt") <= F.col("tolerance") / 100)
    return rows.groupBy("tolerance").agg(F.count(F.when(good, 1)).alias("good"), F.count(F.lit(1)).alias("n"))


# --- contests from lines -------------------------------------------------------------------------

#: Lines and targets of the styles that one task holds, but for a style that has more.
ROWS = 500_000


def parts_of(spark, rows: int) -> int:
    """Parts for so many lines and targets.  The number is given to Spark, which otherwise sizes tasks by what is shuffled, and knows nothing of what is made of it."""
    return max(spark.sparkContext.defaultParallelism, -(-rows // ROWS))


def _same(a: str, b: str, on: list[str]):
    cond = F.lit(True)
    for k in on:
        cond = cond & (F.col(f"{a}.{k}") == F.col(f"{b}.{k}"))
    return cond


def extended(horizontal: DataFrame, vertical: DataFrame, on: list[str], width: int) -> DataFrame:
    """Horizontal lines that stop short of a vertical one, drawn on to it (both: on, id, x1, y1, x2, y2).

    A vertical line that covers the row is looked for from a tenth before the right end to half the line's length beyond it, within the image.  If the first one lies beyond the end, the
    line goes to it and a tenth of its length further; all by whole numbers.
    """
    h, v = horizontal.alias("h"), vertical.alias("v")
    start, stop = F.floor((F.col("h.x1") + 9 * F.col("h.x2")) / 10), F.least(F.col("h.x2") + F.floor((F.col("h.x2") - F.col("h.x1")) / 2), F.lit(width))
    cond = _same("h", "v", on) & (F.col("v.y1") <= F.col("h.y1")) & (F.col("h.y1") < F.col("v.y2")) & (F.greatest(start, "v.x1") < F.least(stop, F.col("v.x2")))
    at = F.when(F.col("v.x1").isNotNull(), F.greatest(start, "v.x1"))
    out = h.join(v, cond, "left").groupBy(*[F.col(f"h.{c}").alias(c) for c in horizontal.columns]).agg(F.min(at).alias("_at"))  # within the style: no line is moved again
    end = F.when(F.col("_at") >= F.col("x2"), F.col("_at") + F.floor((F.col("_at") - F.col("x1")) / 10)).otherwise(F.col("x2"))
    return out.withColumn("x2", end.cast("long")).drop("_at")


def beside_targets(lines: DataFrame, targets: DataFrame, on: list[str], axis: str) -> DataFrame:
    """Lines along `axis` (x or y) that some target's centre (in whole numbers) lies beside: between the line's ends.  Both have x1, y1, x2, y2."""
    centre = F.floor((F.col(f"t.{axis}1") + F.col(f"t.{axis}2")) / 2)
    return lines.alias("l").join(targets.alias("t"), _same("l", "t", on) & centre.between(F.col(f"l.{axis}1"), F.col(f"l.{axis}2")), "left_semi")


def large_squares(squares: DataFrame, targets: DataFrame, on: list[str]) -> DataFrame:
    """Squares of more than twice the mean area (in whole numbers) of their style's targets."""
    area = (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))
    mean = targets.groupBy(*on).agg(F.floor(F.avg(area)).alias("_mean"))
    return squares.join(mean, on).where(area > 2 * F.col("_mean")).drop("_mean")


def holding(squares: DataFrame, targets: DataFrame, on: list[str]) -> DataFrame:
    """Each target goes to the smallest square (ties by corner) that holds more than half of it and is more than twice as high; on, target_id, x1, y1, x2, y2.  Squares that get none are no contests."""
    b, t = squares.alias("b"), targets.alias("t")
    both = F.greatest(F.lit(0), F.least("b.x2", "t.x2") - F.greatest("b.x1", "t.x1")) * F.greatest(F.lit(0), F.least("b.y2", "t.y2") - F.greatest("b.y1", "t.y1"))
    inside = (2 * both > (F.col("t.x2") - F.col("t.x1")) * (F.col("t.y2") - F.col("t.y1"))) & (F.col("b.y2") - F.col("b.y1") > 2 * (F.col("t.y2") - F.col("t.y1")))
    area = (F.col("b.x2") - F.col("b.x1")) * (F.col("b.y2") - F.col("b.y1"))
    best = F.min(F.struct(area.alias("area"), *[F.col(f"b.{c}").alias(c) for c in ("x1", "y1", "x2", "y2")])).alias("m")
    return t.join(b, _same("b", "t", on) & inside).groupBy(*[F.col(f"t.{k}").alias(k) for k in [*on, "target_id"]]).agg(best).select(*on, "target_id", "m.x1", "m.y1", "m.x2", "m.y2")


def extract_contests(horizontal: DataFrame, vertical: DataFrame, targets: DataFrame, on: list[str], width: int, height: int, dealt: int | None = None) -> DataFrame:
    """The contest box of each target, from a style's lines: on, target_id, x1, y1, x2, y2.

    Short lines go, horizontal ones are drawn on to vertical ones, lines that no target lies beside go, crossings make rectangles, small rectangles go, and each target takes the smallest that
    holds it.  All by joins on the style; styles are dealt into parts by their number of rows, so a task's memory does not grow with the tables.  Lines and targets: on, id or target_id, x1, y1,
    x2, y2.  dealt: the number of parts (see parts_of) that the caller has dealt all three tables into by `on` already.
    """
    parts = dealt
    if parts is None:
        parts = parts_of(targets.sparkSession, sum(df.count() for df in (horizontal, vertical, targets)))
        horizontal, vertical, targets = (df.repartition(parts, *on) for df in (horizontal, vertical, targets))
    long_ = (F.col("x2") - F.col("x1") > width // 10) | (F.col("y2") - F.col("y1") > height // 30)
    h, v = horizontal.where(long_), vertical.where(long_)
    h = beside_targets(extended(h, v, on, width), targets, on, "x").select(*on, "id", F.col("y1").alias("y"), "x1", "x2")
    v = beside_targets(v, targets, on, "y").select(*on, "id", F.col("x1").alias("x"), "y1", "y2")
    many = parts if parts > int(targets.sparkSession.conf.get("spark.sql.shuffle.partitions")) else None  # else as many as Spark makes, and it sizes them by these very rows
    found = rectangles(crossings(h, v, on), on, 1, many).repartition(parts, *on).distinct()
    return holding(large_squares(found, targets, on), targets, on)
