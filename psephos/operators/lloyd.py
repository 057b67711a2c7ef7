"""Clustering within groups of any size: each round is one pass over the vectors and one aggregation by group and cluster."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from psephos.operators.ranking import placed_within
from psephos.sources.io import removed, written

#: Numbers (groups x clusters x components) up to which the centres come to the driver and go to all tasks (8 MB); beyond, they are joined by a shuffle.
FEW = 1_000_000
#: Members of a cluster whose distances to each other one task computes at a time.
BLOCK = 4096


def _squares(x: Column, c: Column) -> Column:
    """Squared distance over the components that both have."""
    return F.aggregate(F.zip_with(x, c, lambda a, b: F.when(F.isnan(a) | F.isnan(b) | a.isNull() | b.isNull(), 0.0).otherwise((a - b) * (a - b))), F.lit(0.0), lambda s, d: s + d)


def _numbers(centres: DataFrame) -> int:
    return centres.agg(F.sum(F.size("centre"))).first()[0] or 0


def _matrix(vectors) -> np.ndarray:
    """Vectors as rows; what is missing, at the end of shorter ones as well, is NaN."""
    own = [np.asarray(v, np.float64) for v in vectors]
    width = max((len(v) for v in own), default=0)
    return np.stack([v if len(v) == width else np.concatenate([v, np.full(width - len(v), np.nan)]) for v in own]) if own else np.zeros((0, 0))


def _held(centres: DataFrame, on: list[str]) -> dict:
    """The centres of each group, by c: at most FEW numbers."""
    out: dict = {}
    for r in sorted(centres.select(*on, "c", "centre").collect(), key=lambda r: r.c):
        out.setdefault(tuple(r[k] for k in on), {})[r.c] = r.centre
    return out


def _each(pdf: pd.DataFrame, on: list[str], held: dict):
    """For the rows of each group that has centres: their places in pdf, vectors, nearest c and squared distance over the components that both have (ties to the lower c)."""
    for group, at in pdf.groupby(on, sort=False).indices.items():
        if (own := held.get(tuple(group))) is None:
            continue
        x, names = _matrix(pdf["x"].iloc[at]), np.array(list(own))
        d = np.empty((len(x), len(names)))
        for i, centre in enumerate(_matrix(own.values())):
            width = min(x.shape[1], len(centre))
            away = x[:, :width] - centre[:width]
            d[:, i] = np.nansum(away * away, axis=1)
        first = d.argmin(axis=1)
        yield group, at, x, names[first], d[np.arange(len(x)), first]


def _nearest(rows: DataFrame, centres: DataFrame, on: list[str]) -> DataFrame:
    """rows with c and d: the nearest centre of their group (ties to the lower c) and the squared distance."""
    if _numbers(centres) <= FEW:
        held, schema = _held(centres, on), ", ".join(f"`{c}` {k}" for c, k in rows.dtypes)

        def run(it):
            for pdf in it:
                for _, at, _, c, d in _each(pdf, on, held):
                    yield pdf.iloc[at].assign(c=c, d=d)

        return rows.mapInPandas(run, f"{schema}, c int, d double")
    listed = centres.groupBy(*on).agg(F.array_sort(F.collect_list(F.struct("c", "centre"))).alias("_centres"))  # k of each group
    joined = rows.join(listed, on)
    best = F.array_min(F.transform("_centres", lambda z: F.struct(_squares(F.col("x"), z["centre"]).alias("d"), z["c"].alias("c"))))
    return joined.withColumn("_best", best).drop("_centres").select(*rows.columns, F.col("_best.c").alias("c"), F.col("_best.d").alias("d"))


def _means(assigned: DataFrame, on: list[str]) -> DataFrame:
    """on, c, centre: the mean of each cluster's known components, to 9 digits."""
    parts = assigned.select(*on, "c", F.posexplode("x").alias("at", "v"))
    return _listed(parts.groupBy(*on, "c", "at").agg(F.round(F.avg(F.when(~F.isnan("v"), F.col("v"))), 9).alias("m")), on)


def _listed(means: DataFrame, on: list[str]) -> DataFrame:
    listed = means.groupBy(*on, "c").agg(F.array_sort(F.collect_list(F.struct("at", "m"))).alias("l"))
    return listed.select(*on, "c", F.transform("l", lambda z: F.coalesce(z["m"], F.lit(float("nan")))).alias("centre"))


def _summed(rows: DataFrame, held: dict, on: list[str]) -> DataFrame:
    """As _means of the rows nearest to each centre: a pass in which a task adds up the vectors of each cluster, so what is shuffled is a row for each cluster and batch."""
    def run(it):
        for pdf in it:
            out = []
            for group, _, x, c, _ in _each(pdf, on, held):
                for name in np.unique(c):
                    own = x[c == name]
                    out.append((*group, name, np.nansum(own, axis=0), (~np.isnan(own)).sum(axis=0)))
            yield pd.DataFrame(out, columns=[*on, "c", "s", "n"])

    kinds = dict(rows.dtypes)
    parts = rows.mapInPandas(run, ", ".join([*[f"`{k}` {kinds[k]}" for k in on], "c int, s array<double>, n array<long>"]))
    flat = parts.select(*on, "c", F.posexplode(F.arrays_zip("s", "n")).alias("at", "z"))
    total = F.sum("z.n")
    return _listed(flat.groupBy(*on, "c", "at").agg(F.round(F.when(total > 0, F.sum("z.s") / total), 9).alias("m")), on)


def _moved(rows: DataFrame, centres: DataFrame, on: list[str], key: str, rounds: int) -> DataFrame:
    """The centres (few) when none moves any more.  Groups whose centres stay are done, as all that follows from them stays too; a round is one pass over the rest."""
    spark, held = rows.sparkSession, _held(centres, on)
    kinds = ", ".join(f"`{k}` {dict(rows.dtypes)[k]}" for k in on)
    left = set(held)
    same = lambda a, b: a.keys() == b.keys() and all(np.array_equal(a[c], b[c], equal_nan=True) for c in a)
    for _ in range(rounds):
        if not left:
            break
        own = rows if len(left) == len(held) else rows.join(F.broadcast(spark.createDataFrame(list(left), kinds)), on, "left_semi")
        new = _held(_summed(own, {g: held[g] for g in left}, on), on)
        if any(new.get(g, {}).keys() != held[g].keys() for g in left):  # empty clusters
            now = written(spark.createDataFrame([(*g, c, x) for g in left for c, x in held[g].items()], centres.schema), "centres")
            new = _held(_means(_filled(_nearest(own, now, on), now, on, key), on), on)
        left = {g for g in new if not same(new[g], held[g])}
        held |= new
    return written(spark.createDataFrame([(*g, c, x) for g, own in held.items() for c, x in own.items()], centres.schema), "centres")


def _filled(assigned: DataFrame, centres: DataFrame, on: list[str], key: str) -> DataFrame:
    """Each empty cluster gets a vector: in order, those farthest from their own centres (ties by key).  Where none is empty, rows are returned as they are."""
    used = assigned.select(*on, "c").distinct()
    empty = centres.select(*on, "c").join(used, [*on, "c"], "left_anti")
    if not empty.count():
        return assigned
    empty = written(empty.withColumn("_place", F.row_number().over(Window.partitionBy(*on).orderBy("c"))), "empty")
    far = assigned.join(F.broadcast(empty.select(*on).distinct()) if empty.count() <= FEW else empty.select(*on).distinct(), on, "left_semi")
    far = far.select(*on, key, F.row_number().over(Window.partitionBy(*on).orderBy(F.desc("d"), key)).alias("_place"))
    most = empty.agg(F.max("_place")).first()[0]  # under k
    moved = far.where(F.col("_place") <= most).join(empty.withColumnRenamed("c", "_c"), [*on, "_place"]).select(*on, key, "_c")
    return assigned.join(F.broadcast(moved), [*on, key], "left").withColumn("c", F.coalesce("_c", "c")).drop("_c")


def _mark(centres: DataFrame, *columns: str):
    """Whether two rounds left the same."""
    return centres.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64(*columns).cast("decimal(38,0)")).alias("h")).first()


def _prepared(vectors: DataFrame, group: str, key: str, vector: str, most: int | None) -> DataFrame:
    from psephos.operators.cluster import trimmed

    parts = trimmed(vectors, [group], [key], most) if most else vectors.withColumn("part", F.lit(0).cast("long"))
    rows = parts.select(group, "part", key, F.col(vector).cast("array<double>").alias("x")).where(F.col(group).isNotNull() & F.col("x").isNotNull())
    return placed_within(rows, [group, "part"], [key], "place")


def _seeds(rows: DataFrame, on: list[str], k: int) -> DataFrame:
    """The vectors at k places spread evenly from a group's first to its last; all of a group no larger than k."""
    sizes = rows.groupBy(*on).agg((F.max("place") + 1).alias("_n"))
    places = F.transform(F.sequence(F.lit(0), F.least(F.lit(k), F.col("_n")) - 1), lambda i: F.when(F.col("_n") <= k, i).otherwise(F.floor(i * (F.col("_n") - 1) / max(1, k - 1))))
    at = sizes.select(*on, F.posexplode(places).alias("c", "place")).withColumn("place", F.col("place").cast("long"))
    return rows.join(F.broadcast(at) if at.count() <= FEW else at, [*on, "place"])


def kmeans_in_groups(vectors: DataFrame, group: str, k: int, key: str, vector: str = "embedding", rounds: int = 200, most: int | None = None) -> DataFrame:
    """group, key, cluster: k-means within each group, for vectors that may hold NaN (means and distances take the components that are there), until no centre moves.

    Seeds are spread over the group in key order; an empty cluster gets the vector farthest from its own centre; each vector of a group no larger than k is its own cluster.  Centres are means to
    9 digits, summed by group, cluster and component before they are shuffled, so no group has to fit a task.  Keys are unique within a group; rows without a group or a vector are left out.
    most, an option: groups of `most` or more are cut along the key into parts, which are clustered each (clusters k to 2k - 1 are of the second part, and so on).
    """
    on = [group, "part"]
    rows = written(_prepared(vectors, group, key, vector, most), "lloyd")
    centres = written(_seeds(rows, on, k).select(*on, "c", F.col("x").alias("centre")), "centres")
    if _numbers(centres) <= FEW:
        centres = _moved(rows, centres, on, key, rounds)
        rounds = 0
    was = _mark(centres, *on, "c", "centre")
    for _ in range(rounds):
        new = written(_means(_filled(_nearest(rows, centres, on), centres, on, key), on), "centres")
        now = _mark(new, *on, "c", "centre")
        spent, centres = centres, new
        if now == was:
            break
        removed(spent)
        was = now
    assigned = _filled(written(_nearest(rows, centres, on).select(*on, key, "c", "d"), "assigned"), centres, on, key)
    return assigned.select(group, key, (F.col("c") + k * F.col("part")).cast("long").alias("cluster"))


#: Squared distances under this share of both vectors' squares are summed up from differences, as too few of a product's digits are left of them.
CLOSE = 1e-4


def _apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """All distances of the rows of x to those of y, from a product of matrices."""
    both = (x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1)
    d = both - 2 * (x @ y.T)
    i, j = np.nonzero(d < CLOSE * both)
    for f in range(0, len(i), 65536):
        own = slice(f, f + 65536)
        d[i[own], j[own]] = ((x[i[own]] - y[j[own]]) ** 2).sum(axis=1)
    return np.sqrt(d, out=d)


def _sums_within(key: str, schema: str):
    """Rows of two blocks of one cluster -> each member's distances to the other block's members (to all, within one block), summed."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(pdf["x"].to_list()).astype(float)
        block = pdf["block"].to_numpy()
        a, b = (np.flatnonzero(block == v) for v in (block.min(), block.max()))
        total = np.zeros(len(x))
        for f in range(0, len(a), 256):
            d = _apart(x[a[f : f + 256]], x[b])
            total[a[f : f + 256]] += d.sum(axis=1)
            if block.min() != block.max():
                total[b] += d.sum(axis=0)
        return pd.DataFrame({**{c: pdf[c] for c in schema if c != "total"}, "total": total})

    return run


def kmedoids_in_groups(vectors: DataFrame, group: str, k: int, key: str, vector: str = "embedding", rounds: int = 200, most: int | None = None) -> DataFrame:
    """group, key, cluster, medoid: k-medoids within each group until no medoid changes; a medoid is the member with the least sum of distances (to 9 digits, ties by key) to its cluster.

    These sums need all distances within a cluster, which is the algorithm's own cost; they are dealt out as pairs of blocks of at most some 4096 members, so no task holds a group or a
    matrix of it.  Seeds, keys and `most` as in kmeans_in_groups; an empty cluster keeps its medoid.
    """
    on = [group, "part"]
    rows = written(_prepared(vectors, group, key, vector, most), "medoids")
    centres = written(_seeds(rows, on, k).select(*on, "c", F.col(key).alias("medoid"), F.col("x").alias("centre")), "centres")
    kinds = dict(rows.dtypes)
    own = [*on, "c"]
    schema = f"{group} {kinds[group]}, part long, c int, {key} {kinds[key]}, total double"
    left = rows
    for _ in range(rounds):
        assigned = written(_nearest(left, centres.select(*own, "centre"), on).select(*own, key, "x"), "assigned")
        blocks = assigned.groupBy(*own).agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
        dealt = assigned.join(F.broadcast(blocks) if blocks.count() <= FEW else blocks, own).withColumn("block", F.pmod(F.xxhash64(key), "blocks").cast("int"))
        pairs = dealt.select(*own, key, "x", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")).withColumns({"lo": F.least("block", "other"), "hi": F.greatest("block", "other")})
        sums = pairs.groupBy(*own, "lo", "hi").applyInPandas(_sums_within(key, [*own, key, "total"]), schema).groupBy(*own, key).agg(F.round(F.sum("total"), 9).alias("total"))
        best = sums.groupBy(*own).agg(F.min(F.struct("total", key)).alias("m")).select(*own, F.col(f"m.{key}").alias("medoid"))
        kept = centres.join(best.select(*own), own, "left_anti")
        moved = best.join(assigned.select(*own, F.col(key).alias("medoid"), F.col("x").alias("centre")), [*own, "medoid"]).select(*centres.columns)
        new = written(moved.unionByName(kept), "centres")
        moving = written(new.join(centres.select(*own, "medoid"), [*own, "medoid"], "left_anti").select(*on).distinct(), "moving")  # groups whose medoids stay are done
        removed(assigned)
        centres, n = new, moving.count()
        if not n:
            break
        left = rows.join(F.broadcast(moving) if n <= FEW else moving, on, "left_semi")
    found = _nearest(rows, centres.select(*own, "centre"), on).join(F.broadcast(centres.select(*own, "medoid")) if centres.count() <= FEW else centres.select(*own, "medoid"), own)
    return found.select(group, key, (F.col("c") + k * F.col("part")).cast("long").alias("cluster"), "medoid")
