"""Vector code compression: a codebook for each part of a vector, learned and searched in whole numbers by Exponion's bounded search."""

from __future__ import annotations

import hashlib
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from psephos.llm.common import FEW, removed, spread_join, table, written

#: Columns of a round's table: vectors (q not null), and each task's sums by part and entry (q null).
ROUND = "vec_id long, lab string, q binary, code binary, part int, entry int, n long, total array<long>"
LONG_MAX = 2**63 - 1


def neighbours(book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each entry of a (k, d) codebook: all entries by squared distance from it (ties by index), and a quarter of these distances, rounded up."""
    apart = ((book[:, None] - book[None]) ** 2).sum(axis=2)
    order = np.argsort(apart, axis=1, kind="stable")
    near = np.take_along_axis(apart, order, axis=1)
    return order, near // 4 + (near % 4 > 0)


def nearest(x: np.ndarray, book: np.ndarray, lists: tuple[np.ndarray, np.ndarray], was: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(entry, squared distance) of whole-number vectors x (n, d), ties to the lower index, and the number of distances computed.

    Exponion (Newling and Fleuret, 2016): an entry as near to a vector as `was`, its previous entry, lies within twice that distance of `was`, so the list of
    `was` is scanned while a quarter of the squared distance between entries is at most the vector's.
    """
    order, quarter = lists
    start = ((x - book[was]) ** 2).sum(axis=1)
    best, at, n = start.copy(), was.copy(), len(x)
    live = np.arange(len(x))
    for rank in range(len(book)):
        live = live[quarter[was[live], rank] <= start[live]]
        if not len(live):
            break
        entry = order[was[live], rank]
        d = ((x[live] - book[entry]) ** 2).sum(axis=1)
        n += len(live)
        nearer = (d < best[live]) | ((d == best[live]) & (entry < at[live]))
        best[live[nearer]], at[live[nearer]] = d[nearer], entry[nearer]
    return at, best, n


def bound(dim: int) -> int:
    """The largest component with which the squared distance of any two vectors is a long."""
    return isqrt(LONG_MAX // max(dim, 1)) // 2


def whole(v: np.ndarray, scale: float, most: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.clip(np.floor(v * scale), -most, most).astype(np.int64)


def _assigned(books: np.ndarray, x: np.ndarray, lists, was: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes (n, parts) and summed errors of vectors x (n, parts, width)."""
    code, error = np.empty(was.shape, np.int64), np.zeros(len(x), np.int64)
    for p, book in enumerate(books):
        code[:, p], d, _ = nearest(x[:, p], book, lists[p], was[:, p])
        error += d
    return code, error


def _unpacked(batch, shape: tuple[int, int]):
    n, (parts, width) = batch.num_rows, shape
    q = np.frombuffer(b"".join(batch.column("q").to_pylist()), "<i4").reshape(n, parts, width).astype(np.int64)
    return q, np.frombuffer(b"".join(batch.column("code").to_pylist()), np.uint8).reshape(n, parts).astype(np.int64)


def _binary(a: np.ndarray) -> pa.Array:
    """A row of a as bytes, each."""
    data, size = np.ascontiguousarray(a).tobytes(), a.itemsize * (a.size // max(len(a), 1))
    return pa.array([data[i * size : (i + 1) * size] for i in range(len(a))], pa.binary())


def _one_round(books: np.ndarray, read):
    """Batches -> the same vectors with their codes by `books`, then this task's sums and counts by part and entry."""
    parts, k, width = books.shape

    def run(batches):
        lists = [neighbours(b) for b in books]
        total, count = np.zeros((parts, k, width), np.int64), np.zeros((parts, k), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            x, was = read(batch)
            code, _ = _assigned(books, x, lists, was)
            for p in range(parts):
                count[p] += np.bincount(code[:, p], minlength=k)
                at = (code[:, p, None] * width + np.arange(width)).ravel()
                total[p] += np.bincount(at, x[:, p].ravel(), k * width).astype(np.int64).reshape(k, width)  # of a batch: far below 2**53
            nothing = pa.nulls(batch.num_rows)
            yield _row(batch.column("vec_id"), batch.column("lab"), _binary(x.astype("<i4")), _binary(code.astype(np.uint8)), nothing, nothing, nothing, nothing)
        p, e = np.nonzero(count)
        nothing = pa.nulls(len(p))
        yield _row(nothing, nothing, nothing, nothing, pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(count[p, e]), pa.array(list(total[p, e]), pa.list_(pa.int64())))

    return run


def _row(*columns) -> pa.RecordBatch:
    types = {"vec_id": pa.int64(), "lab": pa.string(), "q": pa.binary(), "code": pa.binary(), "part": pa.int32(), "entry": pa.int32(), "n": pa.int64(), "total": pa.list_(pa.int64())}
    return pa.RecordBatch.from_arrays([c.cast(t) for c, t in zip(columns, types.values())], names=list(types))


def _moved(books: np.ndarray, done: DataFrame) -> np.ndarray:
    """Each entry is the mean of its parts, rounded down; an unused one stays.  Sums are decimals; parts * entries * width of them come to the driver."""
    sums = done.where("q is null").select("part", "entry", "n", F.posexplode("total").alias("at", "x"))
    out = books.copy()
    for r in sums.groupBy("part", "entry", "at").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("x"), F.sum("n").alias("n")).collect():
        out[r.part, r.entry, r["at"]] = int(r.x) // r.n
    return out


def compressed(vectors: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, scale: float = 4096.0, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label") -> tuple[DataFrame, np.ndarray]:
    """(vec_id, lab, code, error) of every sound vector, a written table, and the codebooks (parts, entries, width).

    A component x is floor(scale * x); vectors are cut into equal consecutive parts.  A part's codebook starts as that part of the vectors with the smallest vec_ids; each round assigns every
    part to its nearest entry and moves entries to the rounded-down means of their parts.  All is whole-number arithmetic, so results do not depend on how rows are dealt out.  A round is a
    written table: it holds each vector with its codes, from which the next round's search starts, and the tasks' sums; the table before it is deleted.  No row is shuffled.

    A vector that is null or holds a null or a non-finite component is dropped, and so is one of another length than most (of lengths equally frequent, the smaller).  A length that `parts`
    does not divide is filled up with zeros.  Components that would make squared distances exceed a long (over bound(length)) count as that bound.  Equal vec_ids are ordered by their vectors;
    a null vec_id comes last; repeated rows count each.  Fewer rows than entries make smaller codebooks.  Labels of any type that casts to string; a null is a label of its own.  Other columns
    are ignored.  An empty table gives no rows and empty codebooks.
    """
    v = F.col(embedding).cast("array<double>")
    lab = F.coalesce(F.concat(F.lit("="), F.col(label).cast("string")), F.lit(""))
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), lab.alias("lab"), v.alias("v"))
    rows = rows.where(F.col("v").isNotNull() & F.forall("v", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False))))
    length = rows.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").limit(1).collect()
    dim = length[0].d if length else 0
    width = -(-dim // parts)
    most = bound(parts * width)
    rows = rows.where(F.size("v") == dim)
    first = rows.select("vec_id", "v").orderBy(F.asc_nulls_last("vec_id"), "v").limit(entries).collect() if dim else []

    def cut(flat: np.ndarray) -> np.ndarray:
        full = np.zeros((len(flat), parts * width), np.int64)
        full[:, :dim] = whole(flat, scale, most)
        return full.reshape(len(flat), parts, width)

    def fresh(batch):
        x = cut(batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim))
        return x, np.zeros((len(x), parts), np.int64)

    books = cut(np.array([r.v for r in first], np.float64).reshape(len(first), dim)).transpose(1, 0, 2)
    if not dim:
        kept = rows.select("vec_id", "lab", F.repeat(F.lit("00"), F.lit(parts)).alias("code"), F.lit(0).cast("long").alias("error"))
        return kept, books
    held, read = rows, fresh
    for _ in range(rounds):
        done = written(held.mapInArrow(_one_round(books, read), ROUND), "codes")
        books = _moved(books, done)
        if held is not rows:
            removed(spent)
        spent, held, read = done, done.where("q is not null"), lambda batch: _unpacked(batch, (parts, width))

    def last(batches):
        lists = [neighbours(b) for b in books]
        for batch in batches:
            if batch.num_rows:
                x, was = read(batch)
                code, error = _assigned(books, x, lists, was)
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("lab"), pa.array([c.tobytes().hex() for c in code.astype(np.uint8)]), pa.array(error)], names=["vec_id", "lab", "code", "error"])

    out = written(held.mapInArrow(last, "vec_id long, lab string, code string, error long"), "coded")
    if held is not rows:
        removed(spent)
    return out, books


def digest(books: np.ndarray) -> str:
    """SHA-256 of all components by part, entry and position, as decimal numbers with commas between."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def with_label_error(coded: DataFrame) -> DataFrame:
    """One more column, the sum of errors of equal labels (a long; beyond its range, the largest long).  Sums are made before the shuffle; few labels go to all tasks, so rows stay where they are."""
    sums = written(coded.groupBy("lab").agg(F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(LONG_MAX).cast("decimal(38,0)")).cast("long").alias("label_error"), F.count(F.lit(1)).alias("n")), "label_errors")
    if sums.count() <= FEW:
        return coded.join(F.broadcast(sums.drop("n")), "lab")
    return spread_join(coded, sums, ["lab"], "n", 4096)


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of every sound vector of `embeddings`; unsound vectors, odd lengths, large components, ties, repeated rows and empty tables as in compressed."""
    coded, books = compressed(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))
    return with_label_error(coded).select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def _sql(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """The same in SQL: a pair of steps for each round."""
    steps = [
        "ok AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings"
        " WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"cut AS MATERIALIZED (SELECT vec_id, p, q[p * (len(q) // {parts}) + 1 : (p + 1) * (len(q) // {parts})] AS x FROM ok, range({parts}) AS r(p))",
        f"b0 AS MATERIALIZED (SELECT p, ROW_NUMBER() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, x AS c FROM cut QUALIFY e < {entries})",
    ]
    for r in range(rounds + 1):
        steps.append(
            f"a{r} AS MATERIALIZED (SELECT vec_id, p, MIN({{'d': d, 'e': e}}) AS best FROM (SELECT vec_id, cut.p, e, list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d"
            f" FROM cut JOIN b{r} ON cut.p = b{r}.p) GROUP BY vec_id, p)"
        )
        if r < rounds:
            steps.append(
                f"m{r} AS MATERIALIZED (SELECT p, e, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS c FROM (SELECT cut.p, best.e AS e, i, SUM(x[i]) AS s, COUNT(*) AS n FROM cut JOIN a{r} USING (vec_id, p),"
                f" (SELECT UNNEST(range(1, (SELECT MAX(len(q)) // {parts} + 1 FROM ok))) AS i) GROUP BY ALL) GROUP BY p, e)"
            )
            steps.append(f"b{r + 1} AS MATERIALIZED (SELECT p, e, COALESCE(m{r}.c, b{r}.c) AS c FROM b{r} LEFT JOIN m{r} USING (p, e))")
    n = rounds
    return (
        "WITH " + ",\n".join(steps) + f",\nrow AS (SELECT vec_id, string_agg(printf('%02x', best.e), '' ORDER BY p) AS code, CAST(SUM(best.d) AS BIGINT) AS error FROM a{n} GROUP BY vec_id),\n"
        "sha AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS s FROM b" + str(n) + ")\n"
        "SELECT vec_id, code, error, CAST(SUM(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, s AS codebooks_sha256 FROM row JOIN ok USING (vec_id), sha"
    )


OP11_SQL = _sql()
