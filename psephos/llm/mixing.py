"""Mixing sources to target weights with exact budgets, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from psephos.llm.common import few_or_join, free_name, n_words, table, written


def targets(sizes: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """One row per source (skey, source, source_size) -> the same with target.

    Sources by code point, null last, take the weights in turn.  The budget, share times all sizes,
    is dealt by weight; no target passes most times its source's size, and what is over goes to the
    others by weight.  That level is found in closed form: in order of cap by weight, the level at which
    the remaining budget fits the remaining weights peaks at the first source that is not full.
    """
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights) + 1).cast("int"))
    caps = sizes.withColumn("w", w).withColumn("cap", F.lit(float(most)) * F.col("source_size")).withColumn("ratio", F.col("cap") / F.col("w"))
    order = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    full = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing))
    everything = Window.partitionBy(F.lit(1))
    level = (F.lit(float(share)) * F.sum("source_size").over(everything) - full) / rest
    return caps.withColumn("level", level).withColumn("target", F.least("cap", F.max("level").over(everything) * F.col("w"))).select("skey", "source_size", "target")


def mix(docs: DataFrame, size: Column, doc_id: str = "doc_id", source: str = "source", weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: str = "mix", in_range: int = 50_000, whole: bool = False) -> DataFrame:
    """What the mix takes of each document: doc_id, size, source_size, target, taken.

    Each document has a hash-random key (MD5 of seed and id).  Keys are range-split by their leading
    bits, into as many ranges (a power of two) as hold about in_range of all documents each; sums by range, then running sums over
    them, give every range its start, and only rows within one range are sorted.  A source takes all its documents as
    often as its target holds its size, then more of them in key order up to the exact word.  With
    whole=True the document on the cut is taken whole if more than half of it lies before the cut, else not at all.

    Null text or size counts 0 words; such documents take 0.  Null is a source of its own.  Rows with equal
    ids are documents of their own, one after another.  Other columns are ignored.  An empty table gives no rows.
    """
    part = F.greatest(F.lit(0).cast("long"), F.least("size", "left"))
    if whole:
        part = F.when(F.col("left") * 2 > F.col("size"), F.col("size")).otherwise(F.lit(0))
    placed = _placed(docs, size, doc_id, source, weights, share, most, seed, in_range)
    return placed.select("doc_id", "size", "source_size", "target", (F.col("times") * F.col("size") + part).cast("long").alias("taken"))


def _keys(doc_id: str, source: str, seed: str) -> tuple[Column, Column]:
    """A document's hash-random key and the name of its source, which is never null."""
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit("null"))))
    return key, F.coalesce(F.concat(F.lit("s"), F.col(source).cast("string")), F.lit("-"))


def _placed(docs: DataFrame, size: Column, doc_id: str, source: str, weights: tuple[float, ...], share: float, most: float, seed: str, in_range: int) -> DataFrame:
    """skey, key, doc_id, size, source_size, target, times, left: how often a source is taken whole, and what its budget has left beyond that before each document in key order."""
    key, skey = _keys(doc_id, source, seed)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).cast("string").alias("source"), F.coalesce(size.cast("long"), F.lit(0)).alias("size"), key.alias("key"), skey.alias("skey"))
    rows = written(rows, "mix")
    bits = min(32, max(4, (rows.count() // in_range).bit_length()))
    rows = rows.withColumn("range", F.shiftright(F.conv(F.substring("key", 1, 8), 16, 10).cast("long"), 32 - bits))
    sums = rows.groupBy("skey", "range").agg(F.sum("size").alias("in_range"), F.first("source").alias("source"))
    by_source = Window.partitionBy("skey")
    starts = sums.select("skey", "range", F.coalesce(F.sum("in_range").over(by_source.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    plan = targets(sums.groupBy("skey").agg(F.first("source").alias("source"), F.sum("in_range").alias("source_size")), weights, share, most)
    ranges = starts.join(plan, "skey")
    within = Window.partitionBy("skey", "range").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.join(ranges, ["skey", "range"]).withColumn("before", F.col("start") + F.coalesce(F.sum("size").over(within), F.lit(0)))
    times = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    placed = placed.withColumn("times", times).withColumn("left", F.floor(F.col("target") - F.col("times") * F.col("source_size")) - F.col("before"))
    return placed.select("skey", "key", "doc_id", "size", "source_size", "target", "times", "left")


def mixed(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text", weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: str = "mix", in_range: int = 50_000) -> DataFrame:
    """The documents of the mix, whole, each as often as it is taken; the columns stay as they are, whatever their names.

    What a source takes beyond whole rounds is the start of its key order, up to a document.  So a row for each source, with that document's key, id and size, says of every text where it is read how
    often it is taken, and no text is moved.  Of rows that agree in key, id and size with the last one, as many are taken as fit, the first by text.
    Documents without a word, null and empty texts among them, are never taken.  A null source is a source of its own.  An empty table stays empty.
    """
    size, key_, skey_, id_, times, place = (free_name(docs, n) for n in ("mix_size", "mix_key", "mix_source", "mix_id", "mix_times", "mix_place"))
    sized = docs.withColumn(size, n_words(text))
    placed = written(_placed(sized, F.col(size), doc_id, source, weights, share, most, seed, in_range), "mix_placed")
    more = (F.col("left") * 2 > F.col("size")) & (F.col("size") > 0)
    at = F.struct("key", "doc_id", "size")
    plan = placed.groupBy("skey").agg(F.max("times").alias("_times"), F.max(F.when(more, at)).alias("_last"))
    plan = written(plan, "mix_plan")
    sources = plan.count()
    last = placed.join(few_or_join(plan, sources), "skey").where(at == F.col("_last")).groupBy("skey").agg(F.count(F.lit(1)).alias("_alike"), F.count(F.when(more, 1)).alias("_fit"))
    plan = written(plan.join(last, "skey", "left").select(F.col("skey").alias(skey_), "_times", "_last", "_alike", "_fit"), "mix_plan")
    key, skey = _keys(doc_id, source, seed)
    own = F.struct(F.col(key_).alias("key"), F.col(id_).alias("doc_id"), F.col(size).alias("size"))
    judged = sized.withColumn(key_, key).withColumn(skey_, skey).withColumn(id_, F.col(doc_id)).where(F.col(size) > 0).join(few_or_join(plan, sources), skey_)
    on_last = F.coalesce(own == F.col("_last"), F.lit(False)) & (F.col("_alike") > 1)
    sure = judged.where(~on_last).withColumn(times, F.col("_times") + F.coalesce((own <= F.col("_last")).cast("long"), F.lit(0)))
    tied = judged.where(on_last).withColumn(place, F.row_number().over(Window.partitionBy(skey_).orderBy(text))).withColumn(times, F.col("_times") + (F.col(place) <= F.col("_fit")).cast("long"))
    copies = lambda df: df.where(F.col(times) > 0).select(*docs.columns, F.explode(F.sequence(F.lit(1), F.col(times).cast("int"))).alias(times)).select(*docs.columns)
    return copies(sure).unionByName(copies(tied))


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target, taken of every document; nulls, long and empty texts, repeated rows and empty tables as in mix."""
    docs = table(spark, sf_dir, "documents")
    return mix(docs, n_words("text"))


OP1_SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(COALESCE(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size, md5('mix:' || COALESCE(CAST(doc_id AS VARCHAR), 'null')) AS key FROM documents),
s AS (SELECT source, CAST(SUM(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT source, source_size, CASE (ROW_NUMBER() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w FROM s),
c AS (SELECT *, 2.0::DOUBLE * source_size AS cap, 2.0::DOUBLE * source_size / w AS ratio FROM w),
l AS (SELECT *, (1.5::DOUBLE * SUM(source_size) OVER () - COALESCE(SUM(cap) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / SUM(w) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM c),
t AS (SELECT source, source_size, LEAST(cap, MAX(level) OVER () * w) AS target FROM l),
p AS (SELECT d.doc_id, d.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN FLOOR(t.target / t.source_size) ELSE 0 END AS times,
  COALESCE(SUM(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, CAST(times * size + GREATEST(0, LEAST(size, FLOOR(target - times * source_size) - before)) AS BIGINT) AS taken FROM p
"""
