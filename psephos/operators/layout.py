"""Geometry of boxes: x1, y1, x2, y2, or x, y, w, h."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def canonical(x1: Column, y1: Column, x2: Column, y2: Column) -> list[Column]:
    return [F.least(x1, x2), F.least(y1, y2), F.greatest(x1, x2), F.greatest(y1, y2)]


def area(b: str) -> Column:
    return F.greatest(F.lit(0), F.col(f"{b}.x2") - F.col(f"{b}.x1")) * F.greatest(F.lit(0), F.col(f"{b}.y2") - F.col(f"{b}.y1"))


def common_area(a: str, b: str) -> Column:
    w = F.least(f"{a}.x2", f"{b}.x2") - F.greatest(f"{a}.x1", f"{b}.x1")
    h = F.least(f"{a}.y2", f"{b}.y2") - F.greatest(f"{a}.y1", f"{b}.y1")
    return F.greatest(F.lit(0), w) * F.greatest(F.lit(0), h)


def union_box(a: str, b: str) -> list[Column]:
    return [F.least(f"{a}.x1", f"{b}.x1").alias("x1"), F.least(f"{a}.y1", f"{b}.y1").alias("y1"), F.greatest(f"{a}.x2", f"{b}.x2").alias("x2"), F.greatest(f"{a}.y2", f"{b}.y2").alias("y2")]


def clamp(width: int, height: int, c=F.col) -> dict[str, Column]:
    """The part of a box inside an image; at least one pixel wide and high."""
    x1, y1 = F.greatest(F.lit(0), F.least(c("x1"), F.lit(width - 1))), F.greatest(F.lit(0), F.least(c("y1"), F.lit(height - 1)))
    return {"x1": x1, "y1": y1, "x2": F.greatest(x1 + 1, F.least(c("x2"), F.lit(width))), "y2": F.greatest(y1 + 1, F.least(c("y2"), F.lit(height)))}


def expanded(share: float, width: int, height: int, c=F.col) -> dict[str, Column]:
    """A box grown by share of its size on each side, within the image."""
    dx, dy = F.floor((c("x2") - c("x1")) * share), F.floor((c("y2") - c("y1")) * share)
    return {"x1": F.greatest(F.lit(0), c("x1") - dx), "y1": F.greatest(F.lit(0), c("y1") - dy), "x2": F.least(F.lit(width), c("x2") + dx), "y2": F.least(F.lit(height), c("y2") + dy)}


def assign_targets(targets: DataFrame, contests: DataFrame, on: list[str], slack: float = 0.1) -> DataFrame:
    """The first contest (by contest_id) that holds the whole target, each side eased by the target's own width or height times slack, rounded.

    Both have x, y, w, h; `on` keeps the join a hash join.
    """
    t, c = targets.alias("t"), contests.alias("c")
    dx, dy = (F.round(F.col(f"t.{k}").cast("double") * slack) for k in "wh")
    inside = (F.col("t.x") + dx >= F.col("c.x")) & (F.col("t.y") + dy >= F.col("c.y")) & (F.col("t.x") + F.col("t.w") - dx <= F.col("c.x") + F.col("c.w")) & (F.col("t.y") + F.col("t.h") - dy <= F.col("c.y") + F.col("c.h"))
    cond = inside
    for k in on:
        cond = cond & (F.col(f"t.{k}") == F.col(f"c.{k}"))
    found = t.join(c, cond).groupBy(*[F.col(f"t.{k}") for k in on], F.col("t.target_id")).agg(F.min("c.contest_id").alias("contest_id"))
    return targets.join(found, [*on, "target_id"], "left")


def adjacent(boxes: DataFrame, on: list[str], c: float = 0.2) -> DataFrame:
    """Pairs of boxes side by side or one above the other: from the far edge of the one that begins first to the near edge of the other it is
    less than c times the lesser size, and their other sides overlap or just touch."""
    a, b = boxes.alias("a"), boxes.alias("b")

    def facing(x: str, w: str):
        a_first = (F.col(f"a.{x}") < F.col(f"b.{x}")) | (F.col(f"a.{x}") == F.col(f"b.{x}")) & (F.col("a.x") <= F.col("b.x"))  # begun alike: the one further left
        first = F.when(a_first, F.col(f"a.{x}") + F.col(f"a.{w}")).otherwise(F.col(f"b.{x}") + F.col(f"b.{w}"))
        return F.abs(first - F.greatest(F.col(f"a.{x}"), F.col(f"b.{x}"))) < c * F.least(f"a.{w}", f"b.{w}")

    def level(x: str, w: str):
        return F.greatest(F.col(f"a.{x}"), F.col(f"b.{x}")) <= F.least(F.col(f"a.{x}") + F.col(f"a.{w}"), F.col(f"b.{x}") + F.col(f"b.{w}"))

    cond = (F.col("a.contest_id") < F.col("b.contest_id")) & (facing("x", "w") & level("y", "h") | facing("y", "h") & level("x", "w"))
    for k in on:
        cond = cond & (F.col(f"a.{k}") == F.col(f"b.{k}"))
    return a.join(b, cond).select(*[F.col(f"a.{k}") for k in on], F.col("a.contest_id").alias("a_id"), F.col("b.contest_id").alias("b_id"))


def bounding_box(boxes: DataFrame, by: list[str]) -> DataFrame:
    return boxes.groupBy(*by).agg(F.min("x").alias("x1"), F.min("y").alias("y1"), F.max(F.col("x") + F.col("w")).alias("x2"), F.max(F.col("y") + F.col("h")).alias("y2"))


def cell(x: Column, step: int, cells: int) -> Column:
    """Grid cell of a centre."""
    return F.least(F.lit(cells - 1), F.floor(x / step)).cast("int")


def layout_scores(layouts: DataFrame, events: list[str]) -> DataFrame:
    """Anomaly of each (style, page): the sum over events of ln(count of its observation / count of all); the lowest are reviewed first."""
    out = layouts
    for e in events:
        n = layouts.groupBy(e).agg(F.count(F.lit(1)).alias(f"_n_{e}"))
        out = out.join(n, e)
    size = layouts.agg(F.count(F.lit(1)).alias("_all"))
    score = sum((F.log(F.col(f"_n_{e}")) for e in events), F.lit(0.0))
    return out.join(F.broadcast(size)).withColumn("score", score - len(events) * F.log("_all")).drop("_all", *[f"_n_{e}" for e in events])  # one row


def resize_factor(w: Column, h: Column, most: int, least: int) -> Column:
    """Scale to bring the longer side to `most`, without taking the shorter below `least`; never above 1."""
    f = F.least(F.lit(1.0), most / F.greatest(w, h))
    return F.least(F.lit(1.0), F.greatest(f, least / F.least(w, h)))


def box_checks(targets: DataFrame, contests: DataFrame, on: list[str]) -> DataFrame:
    """What is wrong with a layout, a row per rule: rule, fatal, n."""
    assigned = assign_targets(targets, contests, on)
    empty = contests.join(assigned.where("contest_id is not null").select(*on, "contest_id").distinct(), [*on, "contest_id"], "left_anti")
    rules = (("target outside all contests", True, assigned.where("contest_id is null")), ("contest without targets", False, empty), ("target of no size", True, targets.where("w <= 0 or h <= 0")))
    out = None
    for rule, fatal, bad in rules:
        row = bad.agg(F.count(F.lit(1)).alias("n")).select(F.lit(rule).alias("rule"), F.lit(fatal).alias("fatal"), "n", (F.col("n") == 0).alias("ok"))
        out = row if out is None else out.unionByName(row)
    return out


def targets_within(contests: DataFrame, targets: DataFrame, on: list[str], share: float = 1 / 3) -> DataFrame:
    """on, contest_id, n: targets that lie in a contest's box, which they may overlap by a share of their size (x, y, w, h); contests without any are left out."""
    t, c = targets.alias("t"), contests.alias("c")
    dx, dy = F.col("t.w") * share, F.col("t.h") * share
    cond = (F.col("t.x") >= F.col("c.x") - dx) & (F.col("t.y") >= F.col("c.y") - dy) & (F.col("t.x") + F.col("t.w") <= F.col("c.x") + F.col("c.w") + dx) & (F.col("t.y") + F.col("t.h") <= F.col("c.y") + F.col("c.h") + dy)
    for k in on:
        cond = cond & (F.col(f"t.{k}") == F.col(f"c.{k}"))
    return t.join(c, cond).groupBy(*[F.col(f"c.{k}").alias(k) for k in [*on, "contest_id"]]).agg(F.count(F.lit(1)).alias("n"))


def single_contests(targets: DataFrame) -> DataFrame:
    """Every target as a contest of its own, with the target's box."""
    return targets.withColumn("contest_id", F.col("target_id"))


def slope_angle(points: DataFrame, by: Column, x: Column, y: Column) -> DataFrame:
    """by, angle: the angle in degrees of the line through each group's points."""
    return points.groupBy(by).agg(F.degrees(F.atan(F.regr_slope(y, x))).alias("angle"))
