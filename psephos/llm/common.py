"""What the corpus operators share: words, shared folders, written tables, components."""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from psephos.sources.io import removed, shared_path, shared_root, written  # noqa: F401  shared with the operators here

#: A word: a run of characters other than the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def n_words(text: Column | str) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(F.col(text) if isinstance(text, str) else text, F.lit(WORD)), F.lit(0)).cast("long")


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def local_mount(path: str) -> str:
    """The same path for open() and mmap; the shared folder must be a mounted file system where workers map files."""
    if path.startswith("file:"):
        return "/" + path[len("file:") :].lstrip("/")
    if "://" in path:
        raise ValueError(f"memory-mapped models need spark.checkpoint.dir on a mounted file system, not {path}")
    return path


def free_name(df: DataFrame, name: str) -> str:
    """name, or a variant of it that df does not have as a column (Spark's names ignore case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def utf8(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def give_back_memory() -> None:
    """Returns what this worker has freed to the system: workers are used again by stages of other needs."""
    pa.default_memory_pool().release_unused()
    trim = getattr(_LIBC, "malloc_trim", None)
    if trim is not None:
        trim(0)


_LIBC = ctypes.CDLL(None)


# --- joins that no key can make lopsided -----------------------------------------------------------

#: Rows up to which a narrow table is sent to all tasks (some 16 MB); it is counted first, and joined by a shuffle beyond.
FEW = 1_000_000


def few_or_join(df: DataFrame, n: int) -> DataFrame:
    """df, of n narrow rows, to be joined: sent to all tasks if n is at most FEW."""
    return F.broadcast(df) if n <= FEW else df


def spread_join(rows: DataFrame, names: DataFrame, on: list[str], n: str, most: int) -> DataFrame:
    """rows joined with names (one row per key; column n: how many rows have the key).  Keys that over `most` rows have are sent to all tasks, so these rows are not moved;
    there is at most one such key for `most` rows."""
    big = names.where(F.col(n) > most).drop(n)
    many = big.count()
    small = names.drop(n)
    if not 0 < many <= FEW:
        return rows.join(small, on)
    rest = rows.join(F.broadcast(big.select(*on)), on, "left_anti").join(small, on)
    return rest.unionByName(rows.join(F.broadcast(big), on))


# --- components ---------------------------------------------------------------------------------


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For nodes 0..n-1 and edges a-b: each node's root, the smallest node of its component."""
    root = np.arange(n, dtype=np.int64)
    while len(a):
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, before[a], low)
        np.minimum.at(root, before[b], low)
        while True:
            up = root[root]
            if np.array_equal(up, root):
                break
            root = up
        open_ = root[a] != root[b]
        a, b = a[open_], b[open_]
    return root


def _contract(batches):
    """The edges of each run of up to a million as a spanning forest: (node, root) with root < node."""
    held, n = [], 0

    def flush():
        a, b = (np.concatenate(x) for x in zip(*held))
        nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        root = forest(len(nodes), at[: len(a)], at[len(a) :])
        own = root != np.arange(len(nodes))
        return pa.RecordBatch.from_arrays([pa.array(nodes[own]), pa.array(nodes[root[own]])], names=["a", "b"])

    for batch in batches:
        held.append((batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)))
        n += batch.num_rows
        if n >= 1_000_000:
            yield flush()
            held, n = [], 0
    if n:
        yield flush()
    give_back_memory()


def contracted(fn):
    """A function of batches that yields edges, and its edges contracted as they come: one worker does both."""
    return lambda batches: _contract(fn(batches))


def components(edges: DataFrame, name: str = "components", most_rounds: int = 60, crowd: int = 1024, contract: bool = True) -> DataFrame:
    """Connected components of an edge table with two long columns: (node, root), root the smallest node reachable.

    Each partition first contracts its own edges to a spanning forest; then large-star and small-star
    rounds (Kiveris et al., 2014) run until nothing changes.  Every round is a written table, so a
    lost executor costs one round; the table before it is deleted.  Neighbour minima are aggregated before the shuffle; that of a hub
    of over `crowd` edges goes to all tasks, so its edges are not moved.  Nodes without edges are not returned.  contract=False: the edges' partitions are contracted already.
    """
    a, b = edges.columns
    first = edges.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).where("a <> b")
    e = written((first.mapInArrow(_contract, "a long, b long") if contract else first).distinct(), name)
    was = _digest(e)
    if not was.n:
        return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
    for _ in range(most_rounds):
        # large star: u's greater neighbours go to the least of u and its neighbours
        both = e.select(F.col("a").alias("u"), "b").unionByName(e.select(F.col("b").alias("u"), F.col("a").alias("b")))
        least = both.groupBy("u").agg(F.least("u", F.min("b")).alias("m"), F.count(F.lit(1)).alias("n"))
        hubs = least.agg(F.max("n")).first()[0] or 0
        least = written(least, f"{name}_least") if hubs > crowd else least.drop("n")
        upward = both.where("b > u")
        met = spread_join(upward, least, ["u"], "n", crowd) if hubs > crowd else upward.join(least, "u")
        large = written(met.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct(), name)
        # small star: u and its smaller neighbours go to the least of them (edges point to the smaller node)
        lower = large.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
        small = large.join(lower, large.a == lower.u).select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a"), F.col("m").alias("b")))).alias("x")).select("x.*").where("a <> b").distinct()
        after = written(small, name)
        removed(e, least, large)
        e, now = after, _digest(after)
        if now == was or now.n == 0:
            return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
        was = now
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")


def _digest(edges: DataFrame):
    """Number and checksum of edges: whether two rounds left the same."""
    return edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
