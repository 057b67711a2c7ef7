"""Mark intensities: histograms, the threshold search, outliers, views for review."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values of the two-Gaussian error: pi and e as the search has them.
PI, E = 3.14, 2.71


def histogram(marks: DataFrame, bins: int = 256) -> DataFrame:
    """Count of each intensity from 0 to bins - 1, empty bins included."""
    n = marks.groupBy("intensity").agg(F.count(F.lit(1)).alias("n"))
    return marks.sparkSession.range(bins).select(F.col("id").cast("int").alias("intensity")).join(n, "intensity", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def threshold_errors(hist: DataFrame) -> DataFrame:
    """Error of a cut at each line from 1 to 254: how far all bins on either side, empty ones too, are from a Gaussian of their mean and variance.

    A side that is empty, or has one bin with marks only, has no error; so a degenerate cut can win, and callers may override the line.
    """
    last = 254
    lines = hist.sparkSession.range(1, last + 1).select(F.col("id").cast("int").alias("line"))
    both = lines.join(F.broadcast(hist)).withColumn("side", (F.col("intensity") >= F.col("line")).cast("int"))  # 254 lines by 256 bins
    stats = both.groupBy("line", "side").agg(F.sum("n").alias("total"), F.count(F.when(F.col("n") > 0, 1)).alias("bins"), (F.sum(F.col("intensity") * F.col("n")) / F.sum("n")).alias("mean"), F.sum(F.col("intensity").cast("double") * F.col("intensity") * F.col("n")).alias("sq"))
    stats = stats.where("bins > 1").withColumn("var", F.col("sq") / F.col("total") - F.col("mean") * F.col("mean"))
    joined = both.join(stats, ["line", "side"])
    gauss = F.pow(F.lit(E), -((F.col("intensity") - F.col("mean")) * (F.col("intensity") - F.col("mean"))) / (2 * F.col("var"))) / F.sqrt(2 * PI * F.col("var"))
    sums = joined.groupBy("line").agg(F.sum(F.abs(F.col("n") / F.col("total") - gauss)).alias("error"))
    return lines.join(sums, "line", "left").withColumn("error", F.coalesce("error", F.lit(0.0)))


def best_line(errors: DataFrame) -> DataFrame:
    """The line of the least error, the first of several."""
    return errors.agg(F.min(F.struct(F.round("error", 9).alias("error"), "line")).alias("x")).select("x.line", "x.error")


def otsu(hist: DataFrame) -> DataFrame:
    """Otsu's cut: the line of the greatest variance between both sides, the first of several."""
    w = Window.orderBy("intensity").rowsBetween(Window.unboundedPreceding, -1)  # 256 bins
    every = Window.partitionBy(F.lit(1))
    t = hist.withColumns({"w0": F.coalesce(F.sum("n").over(w), F.lit(0)), "s0": F.coalesce(F.sum(F.col("n") * F.col("intensity")).over(w), F.lit(0)), "all": F.sum("n").over(every), "s": F.sum(F.col("n") * F.col("intensity")).over(every)})
    m0, m1 = F.col("s0") / F.col("w0"), (F.col("s") - F.col("s0")) / (F.col("all") - F.col("w0"))
    t = t.where("w0 > 0 and w0 < all").withColumn("between", F.col("w0") * (F.col("all") - F.col("w0")).cast("double") * (m0 - m1) * (m0 - m1))
    return t.orderBy(F.desc(F.round("between", 3)), "intensity").limit(1).select(F.col("intensity").alias("line"), F.round("between", 3).alias("between"))


def outliers(errors: DataFrame, by: list[str], value: str, order: list[str], n: int) -> DataFrame:
    """Values in falling order; one is an outlier if any of the next n differs by more than half the range, and all before it are outliers."""
    w = Window.partitionBy(*by).orderBy(F.desc(value), *order)
    whole = Window.partitionBy(*by)
    half = (F.max(value).over(whole) - F.min(value).over(whole)) / 2
    gaps = [F.coalesce(F.col(value) - F.lead(value, k).over(w) > half, F.lit(False)) for k in range(1, n + 1)]
    hit = gaps[0]
    for g in gaps[1:]:
        hit = hit | g
    flagged = errors.withColumn("_hit", hit.cast("int"))
    return flagged.withColumn("outlier", F.min("_hit").over(w.rowsBetween(Window.unboundedPreceding, 0)) == 1).drop("_hit")


def view(results: DataFrame, which: str) -> DataFrame:
    """What a reviewer looks at: all, every second mark, filled ones."""
    conditions = {"all": "true", "even": "rnk % 2 = 0", "filled": "is_filled"}
    return results.where(conditions[which])


def lonely(values: DataFrame, by: list[str], value: str, height: float, c: float = 2.0) -> DataFrame:
    """Values without another within c * height."""
    w = Window.partitionBy(*by).orderBy(value)
    return values.withColumn("lonely", (F.coalesce(F.col(value) - F.lag(value).over(w), F.lit(1e18)) > c * height) & (F.coalesce(F.lead(value).over(w) - F.col(value), F.lit(1e18)) > c * height))


def columns_of(values: DataFrame, by: list[str], x: str, width: float) -> DataFrame:
    """Column number: sorted by x, a new one where the gap is over half a width."""
    from psephos.operators.ranking import islands

    w = Window.partitionBy(*by).orderBy(x)
    return islands(values, by, [x], F.col(x) - F.lag(x).over(w) > width / 2, "col_no")


def mean_intensity(patch: Column) -> Column:
    """Mean of an array of pixel values."""
    return F.aggregate(patch, F.lit(0.0), lambda a, v: a + v) / F.size(patch)
