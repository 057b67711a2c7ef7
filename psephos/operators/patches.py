"""Pixel operators over tables: a patch is a struct of h, w and data (float64 bytes); Arrow batches in, Arrow batches out."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from psephos.operators import pixels

PATCH = "struct<h:int,w:int,data:binary>"


def pack(a: np.ndarray) -> dict:
    a = np.ascontiguousarray(a, np.float64)
    return {"h": a.shape[0], "w": a.shape[1], "data": a.tobytes()}


def unpack(p: dict) -> np.ndarray:
    return np.frombuffer(p["data"], np.float64).reshape(p["h"], p["w"])


def from_array(df: DataFrame, column: str, width: int, to: str = "patch") -> DataFrame:
    """An array column of pixel values, row by row, as a patch."""
    def run(it):
        for pdf in it:
            yield pdf.assign(**{to: [pack(np.reshape(np.asarray(x, float), (-1, width))) for x in pdf[column]]})

    kinds = ", ".join(f"`{c}` {k}" for c, k in df.dtypes)
    return df.mapInPandas(run, f"{kinds}, `{to}` {PATCH}")


#: What images that are not as they should be raise; other errors are the function's own and end the job.
BAD_IMAGE = (ValueError, ArithmeticError, LookupError, np.linalg.LinAlgError)


def map_patch(df: DataFrame, fn: Callable[[np.ndarray], dict], schema: str, patch: str = "patch", message: str | None = None) -> DataFrame:
    """df without the patch, with the columns that fn makes of it; a bad image (or none) gives status 'err' and nulls instead of ending the job, and what was wrong in the column `message`, if it is named."""
    names = [c.split()[0] for c in schema.split(", ")]
    rest = [c for c in df.columns if c != patch]
    last = ["status", *([message] if message else [])]

    def run(it):
        for pdf in it:
            rows = []
            for p in pdf[patch]:
                try:
                    if p is None:
                        raise ValueError("no image")
                    found = fn(unpack(p))
                    rows.append((*(found.get(n) for n in names), "ok", None))
                except BAD_IMAGE as e:  # one bad image is a row of its own kind
                    rows.append((*(None for _ in names), "err", f"{type(e).__name__}: {e}"))
            columns = list(zip(*rows)) if rows else [()] * (len(names) + 2)
            made = pd.DataFrame({n: pd.Series(list(c), dtype=None if None not in c else object) for n, c in zip([*names, *last], columns)})
            yield pd.concat([pdf[rest].reset_index(drop=True), made], axis=1)

    kinds = dict(df.dtypes)
    return df.mapInPandas(run, ", ".join([*[f"`{c}` {kinds[c]}" for c in rest], schema, *[f"{c} string" for c in last]]))


def match_exemplars(df: DataFrame, exemplars: dict[str, np.ndarray]) -> DataFrame:
    """label, x, y, score of the exemplar that fits best; exemplars are a bounded set that travels with the function."""
    def best(a):
        found = max(((*pixels.best_match(a, e), k) for k, e in sorted(exemplars.items())), key=lambda m: m[2])
        return {"x": found[0], "y": found[1], "score": round(found[2], 9), "label": found[3]}

    return map_patch(df, best, "x long, y long, score double, label string")


def overlays(df: DataFrame, by: str, patch: str = "patch") -> DataFrame:
    """Least and greatest value per pixel over a group's patches of one size, as arrays; pixels are exploded and aggregated before the shuffle."""
    def run(it):
        for pdf in it:
            yield pd.DataFrame([{by: k, "pixels": unpack(p).ravel().tolist()} for k, p in zip(pdf[by], pdf[patch])], columns=[by, "pixels"])

    flat = df.select(by, patch).mapInPandas(run, f"{by} {dict(df.dtypes)[by]}, pixels array<double>")
    per = flat.select(by, F.posexplode("pixels").alias("pos", "v")).groupBy(by, "pos").agg(F.min("v").alias("low"), F.max("v").alias("high"))
    ordered = per.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("pos", "low", "high"))).alias("x"))
    return ordered.select(by, F.transform("x", lambda p: p["low"]).alias("low"), F.transform("x", lambda p: p["high"]).alias("high"))


def extract(df: DataFrame, boxes: list[tuple[int, int, int, int]], patch: str = "patch") -> DataFrame:
    """A row per target box (x1, y1, x2, y2): target_id and its mean intensity from 0 to 255."""
    rest = [c for c in df.columns if c != patch]

    def run(it):
        for pdf in it:
            rows = [(*own, i, float(unpack(p)[y1:y2, x1:x2].mean() * 255)) for *own, p in zip(*[pdf[c] for c in rest], pdf[patch]) for i, (x1, y1, x2, y2) in enumerate(boxes)]
            yield pd.DataFrame(rows, columns=[*rest, "target_id", "intensity"])

    kinds = dict(df.dtypes)
    return df.mapInPandas(run, ", ".join([*[f"`{c}` {kinds[c]}" for c in rest], "target_id int, intensity double"]))


def aligned(df: DataFrame, by: str, key: str, patch: str = "patch") -> DataFrame:
    """Shift of every patch of a group onto the group's first by key (groups are styles, cut to a bounded size before)."""
    def run(k: tuple, own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values(key)
        first = unpack(own[patch].iloc[0])
        shifts = [pixels.align_shift(unpack(p), first) for p in own[patch]]
        return pd.DataFrame({by: k[0], key: own[key].to_numpy(), "dx": [float(s[0]) for s in shifts], "dy": [float(s[1]) for s in shifts]})

    kinds = dict(df.dtypes)
    return df.groupBy(by).applyInPandas(run, f"{by} {kinds[by]}, {key} {kinds[key]}, dx double, dy double")


def testset(spark, images: list[np.ndarray], dx: list[int], dy: list[int], degrees: list[float], noise: float = 0.01) -> DataFrame:
    """Perturbed copies of images for every combination of the parameters: image_no, dx, dy, degrees, patch."""
    grid = spark.range(len(images)).select(F.col("id").cast("int").alias("image_no"), F.explode(F.array(*map(F.lit, dx))).alias("dx")).select("*", F.explode(F.array(*map(F.lit, dy))).alias("dy")).select("*", F.explode(F.array(*[F.lit(float(x)) for x in degrees])).alias("degrees"))

    def run(it):
        for pdf in it:
            yield pdf.assign(patch=[pack(pixels.perturbed(images[r.image_no], r.dx, r.dy, r.degrees, 0.0, noise, r.image_no)) for r in pdf.itertuples()])

    return grid.mapInPandas(run, f"image_no int, dx int, dy int, degrees double, patch {PATCH}")


def find_attribute(df: DataFrame, exemplars: dict[str, np.ndarray], box: tuple[int, int, int, int], least: float = 0.0, expand: float = 0.5, patch: str = "patch") -> DataFrame:
    """Label, x, y, score of the attribute exemplar that fits best near its box, coarse to fine; a score under `least` leaves the ballot to do (label null)."""
    def best(a):
        found = max(((*pixels.find_near(a, e, box, expand), k) for k, e in sorted(exemplars.items())), key=lambda m: m[2])
        return {"x": found[0], "y": found[1], "score": round(found[2], 9), "label": found[3] if found[2] >= least else None}

    return map_patch(df, best, "x long, y long, score double, label string", patch)


def exemplar_map(exemplars: DataFrame, patches: DataFrame, by: str, key: str) -> DataFrame:
    """by, label, place, patch: the exemplars of each attribute value, numbered, with their patches (exemplars: by, label, key; patches: key, patch)."""
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy(by, "label").orderBy(key)) - 1
    return exemplars.select(by, "label", key, place.alias("place")).join(patches.select(key, "patch"), key).select(by, "label", "place", key, "patch")


def straightened(df: DataFrame, dark: float = 0.5, patch: str = "patch") -> DataFrame:
    """df with each patch turned straight and the angle in degrees; what comes from outside is white."""
    def run(it):
        for pdf in it:
            angles, out = [], []
            for p in pdf[patch]:
                a = unpack(p)
                angle = pixels.straight_angle(a, dark)
                angles.append(angle)
                out.append(pack(pixels.affine(a, pixels.rigid(0, 0, -angle, a.shape), fill=1.0) if angle else a))
            yield pdf.assign(**{patch: out, "angle": angles})

    kinds = ", ".join(f"`{c}` {k}" for c, k in df.dtypes)
    return df.mapInPandas(run, f"{kinds}, angle double")
