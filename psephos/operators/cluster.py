"""Clustering of vectors, and splits of groups."""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from psephos.operators.lloyd import kmeans_in_groups, kmedoids_in_groups  # noqa: F401  by their old place as well
from psephos.operators.ranking import global_rank
from psephos.sources.io import written


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def l1(a: Column, b: Column) -> Column:
    """Mean absolute difference; a missing pixel (NaN) on either side does not count."""
    d = F.filter(F.zip_with(a, b, lambda x, y: F.abs(x - y)), lambda x: ~F.isnan(x))
    return F.aggregate(d, F.lit(0.0), lambda s, x: s + x) / F.size(d)


def _floor_level(a: Column) -> Column:
    """Half the way from the least value to the background: the lower edge of the fullest of ten bins, the first of several."""
    def level(x: Column) -> Column:
        step = (x["high"] - x["low"]) / 10
        places = F.transform(x["known"], lambda v: F.least(F.lit(9), F.floor((v - x["low"]) / step)))
        counts = F.aggregate(places, F.array_repeat(F.lit(0), 10), lambda n, k: F.transform(n, lambda c, i: F.when(i == k, c + 1).otherwise(c)))
        return F.struct(F.when(step > 0, F.transform(F.array(counts), lambda n: (F.array_position(n, F.array_max(n)) - 1) * step / 2)[0]).otherwise(F.lit(0.0)).alias("level"))

    known = F.filter(a, lambda x: ~F.isnan(x))
    bounds = F.transform(F.array(known), lambda k: F.struct(k.alias("known"), F.array_min(k).alias("low"), F.array_max(k).alias("high")))
    return F.transform(bounds, level)[0]["level"]


def vardiff(a: Column, b: Column) -> Column:
    """Sum of the absolute differences above the lesser floor level of both, per known pixel of a: faint differences of the background do not count."""
    pair = F.transform(F.array(F.least(_floor_level(a), _floor_level(b))), lambda t: F.filter(F.zip_with(a, b, lambda x, y: F.abs(x - y)), lambda d: ~F.isnan(d) & (d > t)))[0]
    return F.aggregate(pair, F.lit(0.0), lambda s, x: s + x) / F.size(F.filter(a, lambda x: ~F.isnan(x)))


def image_distortion(a: np.ndarray, b: np.ndarray, m: int = 3, clipped: bool = False) -> float:
    """Sum over the pixels of a of the least difference from those of b up to m rows and columns before and less than m after, the last row and column left out; NaN does not count.

    clipped: values below the lesser floor level of both are 0 first.
    """
    if clipped:
        level = min(_numpy_level(a), _numpy_level(b))
        a, b = (np.where(x < level, 0.0, x) for x in (a, b))
    h, w = a.shape
    least = np.full(a.shape, np.inf)
    for dy in range(-m, m):  # all pixels at once, a shift at a time
        for dx in range(-m, m):
            y1, y2, x1, x2 = max(0, -dy), min(h, h - 1 - dy), max(0, -dx), min(w, w - 1 - dx)
            if y1 < y2 and x1 < x2:
                own = least[y1:y2, x1:x2]
                np.fmin(own, np.abs(a[y1:y2, x1:x2] - b[y1 + dy : y2 + dy, x1 + dx : x2 + dx]), out=own)
    return float(least[np.isfinite(least)].sum())


def _numpy_level(x: np.ndarray) -> float:
    known = x[~np.isnan(x)]
    n, edges = np.histogram(known, bins=10)
    return float((edges[n.argmax()] - known.min()) / 2)


def distortion(width: int, m: int = 3, clipped: bool = False):
    """image_distortion as a function of two array columns of images `width` wide."""
    @F.pandas_udf("double")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([image_distortion(np.reshape(np.asarray(x, float), (-1, width)), np.reshape(np.asarray(y, float), (-1, width)), m, clipped) for x, y in zip(a, b)])

    return run


#: Distances of array columns by name; the image distortion ones need the images' width.
DISTANCES = {"L2": l2, "L1": l1, "vardiff": vardiff}


def kmeans(vectors: DataFrame, k: int, vector: str = "embedding", seed: int = 1) -> DataFrame:
    """vectors with their cluster, 0 to k - 1."""
    data = vectors.withColumn("_v", array_to_vector(F.col(vector).cast("array<double>")))
    return KMeans(k=k, seed=seed, featuresCol="_v", predictionCol="cluster").fit(data).transform(data).drop("_v")


def pca(vectors: DataFrame, n: int, vector: str = "embedding") -> DataFrame:
    data = vectors.withColumn("_v", array_to_vector(F.col(vector).cast("array<double>")))
    return PCA(k=n, inputCol="_v", outputCol="_p").fit(data).transform(data).withColumn("components", vector_to_array("_p")).drop("_v", "_p")


def split_mid(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Two halves of each group, the second the larger if they differ; a group of one stays whole (half 1)."""
    w = Window.partitionBy(*by)
    n, place = F.count(F.lit(1)).over(w), F.row_number().over(w.orderBy(*order))
    return df.withColumn("half", F.when((n == 1) | (place <= F.floor(n / 2)), 1).otherwise(2))


def trimmed(df: DataFrame, by: list[str], order: list[str], most: int) -> DataFrame:
    """Groups of `most` members or more cut along the order into parts of `most`; adds part, from 0."""
    w = Window.partitionBy(*by)
    place = F.row_number().over(w.orderBy(*order)) - 1
    return df.withColumn("part", F.when(F.count(F.lit(1)).over(w) >= most, F.floor(place / most)).otherwise(0).cast("long"))


def trimmed_by_memory(df: DataFrame, by: list[str], order: list[str], kb_each: int, most_mb: int) -> DataFrame:
    """Groups whose images (kb_each kilobytes) take most_mb megabytes or more, cut into as many parts as that is times most_mb, divided down, all of one size but the last; adds part, from 0."""
    w = Window.partitionBy(*by)
    n = F.count(F.lit(1)).over(w)
    parts = F.least(F.floor(n * kb_each / (most_mb * 1000)), n)
    size = F.floor(n / parts)
    place = F.row_number().over(w.orderBy(*order)) - 1
    return df.withColumn("part", F.when(n * kb_each >= most_mb * 1000, F.least(F.floor(place / size), parts - 1)).otherwise(0).cast("long"))


def split(df: DataFrame, group: str, key: str, mode: str = "kmeans", vector: str = "embedding", most: int | None = None) -> DataFrame:
    """Each group in two: group, part, key, cluster (0 or 1).  Groups of `most` or more are cut into parts first.

    mode: mid, kmeans, pca (k-means of three principal components), kmeans2 (distances as vardiff has them), kmedoids (likewise).  Where fewer than two clusters come out, the group is halved
    in the middle; groups of two become two of one; a group of one stays.
    """
    parts = trimmed(df, [group], [key], most) if most else df.withColumn("part", F.lit(0).cast("long"))
    if mode == "mid":
        return split_mid(parts, [group, "part"], [key]).select(group, "part", key, (F.col("half") - 1).cast("long").alias("cluster"))

    def run(ids: tuple, own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values(key)
        x = np.array(own[vector].tolist(), float)
        found = np.zeros(len(x), np.int64) if len(x) < 3 else _two(x, mode)
        if len(x) > 1 and len(np.unique(found)) < 2:
            found = (np.arange(len(x)) >= len(x) // 2).astype(np.int64)
        return pd.DataFrame({group: ids[0], "part": ids[1], key: own[key].to_numpy(), "cluster": found})

    kinds = dict(df.dtypes)
    return parts.groupBy(group, "part").applyInPandas(run, f"{group} {kinds[group]}, part long, {key} {kinds[key]}, cluster long")


def _two(x: np.ndarray, mode: str, rounds: int = 200) -> np.ndarray:
    """Two clusters of the rows of x, seeds the first and the last row; the cluster of the first row is 0."""
    if mode == "pca":
        filled = np.where(np.isnan(x), np.nanmean(x, axis=0), x)
        u, s, _ = np.linalg.svd(filled - filled.mean(axis=0), full_matrices=False)
        x = u[:, :3] * s[:3]
    far = (lambda a, c: np.array([_vardiff(r, c) for r in a])) if mode in ("kmeans2", "kmedoids") else (lambda a, c: np.nansum((a - c) ** 2, axis=1))
    centres, assign = [x[0], x[-1]], None
    for _ in range(rounds):
        new = np.argmin(np.stack([far(x, c) for c in centres], axis=1), axis=1)
        if assign is not None and (new == assign).all():
            break
        assign = new
        if len(np.unique(assign)) < 2:
            break
        if mode == "kmedoids":
            centres = [x[own][np.argmin([far(x[own], r).sum() for r in x[own]])] for own in (assign == 0, assign == 1)]
        else:
            centres = [np.nanmean(x[assign == c], axis=0) for c in (0, 1)]
    return (assign != assign[0]).astype(np.int64)


def _vardiff(a: np.ndarray, b: np.ndarray) -> float:
    d = np.abs(a - b)
    d = d[~np.isnan(d)]
    return float(d[d > min(_numpy_level(a), _numpy_level(b))].sum() / np.count_nonzero(~np.isnan(a)))


#: Numbers of the vectors whose distances _nearest sums up at a time (32 MB).
HELD = 1 << 22


def _nearest(x: np.ndarray, e: np.ndarray, e_id: list) -> tuple[np.ndarray, np.ndarray]:
    """For each row of x its nearest row of e, by the distance to 9 digits and then by id: (distance, row).  NaN is infinitely far.

    Some rows of x at a time, as all pairs may be equally near: of equal exemplars, each is.
    """
    by_id = np.array(sorted(range(len(e_id)), key=e_id.__getitem__))
    e = e[by_id]
    best, at = np.full(len(x), np.inf), np.zeros(len(x), np.int64)
    square, size, some = (x * x).sum(axis=1), (e * e).sum(axis=1), max(1, HELD // (1024 * max(1, x.shape[1])))
    known = bool(np.isfinite(square.sum() + size.sum()))
    for f in range(0, len(e), 1024):
        own, most = e[f : f + 1024], np.nan_to_num(size[f : f + 1024]).max()
        turned = np.ascontiguousarray(-2 * own.T)
        for g in range(0, len(x), some):
            rows = slice(g, g + some)
            # products find who may be nearest, but for the row's own square; the distance itself is summed up from differences
            rough = x[rows] @ turned
            rough += size[f : f + 1024]
            if not known:
                rough = np.nan_to_num(square[rows, None] + rough, nan=np.inf)
            least = rough.min(axis=1)
            near = least + square[rows] if known else least
            slack = 1e-9 * (1 + np.nan_to_num(square[rows]) + most) + 1e-8 * np.sqrt(np.maximum(np.where(np.isfinite(near), near, 0.0), 0.0))
            if known:  # most parts have nothing as near as what was found before: their distances are not summed up
                open_ = np.flatnonzero(near - slack <= best[rows] ** 2 * (1 + 1e-9) + 1e-8 * (1 + best[rows]))
                if not len(open_):
                    continue
                rough, least, slack = rough[open_], least[open_], slack[open_]
            else:
                open_ = np.arange(len(rough))
            i, j = np.nonzero(rough <= (least + slack)[:, None])
            i = open_[i] + g
            d = _distances(x[i], own[j])
            order = np.lexsort((j, d, i))
            first = order[np.concatenate([[True], i[order][1:] != i[order][:-1]])]
            better = (d[first] < best[i[first]]) | ((f == 0) & np.isinf(d[first]))
            k = first[better]
            best[i[k]], at[i[k]] = d[k], f + j[k]
    return best, by_id[at]


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.nan_to_num(np.round(np.sqrt(((x - y) ** 2).sum(axis=-1)), 9), nan=np.inf)


#: Items whose turn comes together; their growth runs on the driver, their distances to earlier exemplars where those are.
TURN = 4096


def exemplars(items: DataFrame, most: int | None = None, turn: int = TURN) -> DataFrame:
    """Exemplar growth: the lightest item of each label is a seed; then items take turns, label by label and lightest first, and each one whose nearest exemplar has
    another label becomes an exemplar at once; passes over the rest are repeated until one adds none.  So no other item's nearest exemplar has a wrong label.

    items: id, label, light, embedding.  Nearest is by the distance to 9 digits and then by id.  most: exemplars of a label beside its seed, no bound if None.  The result
    does not depend on `turn`, so many items at a time come to the driver; exemplars are a written table.
    """
    spark = items.sparkSession
    lightest = F.row_number().over(Window.partitionBy("label").orderBy(F.desc("light"), "id"))
    placed = written(items.select("id", "label", "light", F.col("embedding").cast("array<double>").alias("embedding")).withColumn("k", lightest), "growth")
    shape = placed.select("id", "label", "embedding").schema
    parts = [written(placed.where("k = 1").select("id", "label", "embedding"), "exemplars")]
    chosen = lambda: functools.reduce(DataFrame.unionByName, parts)
    added: dict = {}
    while True:
        rest = placed.join(chosen().select("id"), "id", "left_anti")
        rest = written(global_rank(rest, [F.floor(F.col("k") / 1000), F.col("k")], ["label"], "turn"), "growth")
        n, before = rest.count(), sum(added.values())
        for f in range(0, n, turn):
            own = rest.where(F.col("turn").between(f, f + turn - 1)).orderBy("turn").select("id", "label", "embedding").collect()
            x = np.array([r.embedding for r in own], np.float64)
            found = chosen().mapInPandas(_nearest_of_part(x), "i long, d double, e_id " + shape["id"].dataType.simpleString() + ", e_label " + shape["label"].dataType.simpleString())
            near = {r.i: r.n for r in found.groupBy("i").agg(F.min(F.struct("d", "e_id", "e_label")).alias("n")).collect()}
            new = _grow(own, x, [near[i] for i in range(len(own))], most, added)
            if new:
                parts.append(written(spark.createDataFrame([own[i] for i in new], shape).coalesce(1), "exemplars"))
                if len(parts) > 32:  # plans stay short
                    parts = [written(chosen(), "exemplars")]
        if sum(added.values()) == before:
            return chosen().select("id", "label")


def _nearest_of_part(x: np.ndarray):
    def run(batches):
        for b in batches:
            if len(b):
                ids = b["id"].tolist()
                d, at = _nearest(x, np.array(b["embedding"].tolist(), np.float64), ids)
                yield pd.DataFrame({"i": np.arange(len(x)), "d": d, "e_id": [ids[k] for k in at], "e_label": b["label"].iloc[at].tolist()})

    return run


def _grow(own: list, x: np.ndarray, near: list, most: int | None, added: dict) -> list[int]:
    """Items whose turn has come, in order, and the nearest earlier exemplar of each -> those that become exemplars."""
    d, who, new = np.array([r.d for r in near]), [(r.e_id, r.e_label) for r in near], []
    for i, r in enumerate(own):
        if who[i][1] == r.label or (most is not None and added.get(r.label, 0) >= most):
            continue
        new.append(i)
        added[r.label] = added.get(r.label, 0) + 1
        to = _distances(x[i + 1 :], x[i])
        for j in (np.nonzero(to <= d[i + 1 :])[0] + i + 1).tolist():
            if (to[j - i - 1], r.id) < (d[j], who[j][0]):
                d[j], who[j] = to[j - i - 1], (r.id, r.label)
    return new
