"""From image files to ballots: four ways of pairing, and checks of the number of pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from psephos.functions.paths import natural_key
from psephos.operators.ranking import islands


def single_sided(images: DataFrame) -> DataFrame:
    """Each image is a ballot of its own; the path, unique, is its key."""
    return images.withColumn("ballot_key", F.col("image_path")).withColumn("img_ord", F.lit(0))


def alternating(images: DataFrame, num_pages: int) -> DataFrame:
    """Images of a directory in natural order, num_pages to a ballot.  divides: whether the directory's count is a multiple of num_pages."""
    w = Window.partitionBy("dir_path").orderBy(natural_key(F.col("file_name")), "file_name")
    at = F.row_number().over(w) - 1
    chunk = F.floor(at / num_pages).cast("long")
    ok = F.count(F.lit(1)).over(Window.partitionBy("dir_path")) % num_pages == 0
    return images.withColumns({"img_ord": (at % num_pages).cast("int"), "ballot_key": F.concat_ws("#", "dir_path", chunk.cast("string")), "divides": ok})


def by_regex(images: DataFrame, shared: str, different: str) -> DataFrame:
    """Images of a directory whose names agree in `shared` (group 1) are a ballot, in the order of `different` (group 1).  Names that do not match both from their start are left out."""
    name = F.col("file_name")
    kept = images.where(name.rlike(f"^(?:{shared})") & name.rlike(f"^(?:{different})"))
    parts = kept.withColumns({"_shared": F.regexp_extract(name, f"^(?:{shared})", 1), "_diff": F.regexp_extract(name, f"^(?:{different})", 1)})
    w = Window.partitionBy("dir_path", "_shared").orderBy("_diff", "file_name")
    return parts.withColumns({"img_ord": (F.row_number().over(w) - 1).cast("int"), "ballot_key": F.concat_ws("#", "dir_path", "_shared")}).drop("_shared", "_diff")


def by_counter(images: DataFrame, partition: list[str], n1: str = "n1", n2: str = "n2") -> DataFrame:
    """Consecutive counters: a new ballot begins where n1 does not follow the one before or n2 does not grow."""
    w = Window.partitionBy(*partition).orderBy(n1, n2)
    starts = (F.col(n1) != F.lag(n1).over(w) + 1) | (F.col(n2) <= F.lag(n2).over(w))
    return islands(images, partition, [n1, n2], starts, "ballot_no")


MODES = {"single": single_sided, "alternating": alternating, "regex": by_regex, "counter": by_counter}


def pair(images: DataFrame, mode: str, **options) -> DataFrame:
    return MODES[mode](images, **options)


def page_histogram(images: DataFrame, ballot: str = "ballot_id") -> DataFrame:
    """How many ballots have how many images."""
    return images.groupBy(ballot).agg(F.count(F.lit(1)).alias("pages")).groupBy("pages").agg(F.count(F.lit(1)).alias("n_ballots"))


def expected_pages(images: DataFrame, pages: int, ballot: str = "ballot_id") -> DataFrame:
    """weird: the ballot's number of images is not the expected one; dense_id numbers the others from 0."""
    counts = images.groupBy(ballot).agg(F.count(F.lit(1)).alias("pages"))
    good = counts.where(F.col("pages") == pages)
    ranked = _dense(good, ballot)
    return counts.join(ranked, ballot, "left").select(ballot, "pages", (F.col("pages") != pages).alias("weird"), "dense_id")


def _dense(df: DataFrame, key: str) -> DataFrame:
    from psephos.operators.ranking import global_rank

    return global_rank(df.select(key), [F.shiftright(key, 12)], [key], "dense_id").withColumn("dense_id", F.col("dense_id").cast("long"))


def page_counts(images: DataFrame) -> DataFrame:
    """Images per page number, and whether these counts are uneven."""
    n = images.groupBy("page").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("uneven", F.min("n").over(Window.partitionBy(F.lit(1))) != F.max("n").over(Window.partitionBy(F.lit(1))))


def dense_pages(images: DataFrame) -> DataFrame:
    """Page numbers as 0, 1, 2, ... in their order, over all images."""
    pages = images.select("page").distinct().withColumn("norm_page", (F.dense_rank().over(Window.orderBy("page")) - 1).cast("int"))
    return images.join(pages, "page")


def first_n(df: DataFrame, by: list[str], order: list[Column | str], n: int) -> DataFrame:
    """The first n rows of each group."""
    return df.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("place") <= n)


def distinct_pages(images: DataFrame) -> DataFrame:
    """Ballots on which a page number comes twice: to quarantine."""
    return images.groupBy("ballot_id").agg(F.count(F.lit(1)).alias("images"), F.count_distinct("page").alias("pages")).where("images <> pages")


def sample(df: DataFrame, key: str, share: float, least: int, most: int, seed: int = 0) -> DataFrame:
    """A repeatable sample: share of the rows, but at least `least` and at most `most`, in hash order."""
    n = max(least, min(most, round(df.count() * share)))
    return df.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), key).limit(n)


def page_sets(images: DataFrame) -> DataFrame:
    """ballot_id, pages: the pages of each ballot in order, as text."""
    return images.groupBy("ballot_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("page")), lambda p: p.cast("string")), ",").alias("pages"))


def templates(images: DataFrame, exemplars: DataFrame, on: list[str], overridden: Column) -> DataFrame:
    """image_path, template: the exemplar of its kind (on, exemplar) where that is to stand in, else the image itself."""
    return images.join(exemplars.select(*on, "exemplar"), on, "left").select("image_path", F.when(overridden & F.col("exemplar").isNotNull(), F.col("exemplar")).otherwise(F.col("image_path")).alias("template"))
