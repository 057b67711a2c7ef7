"""Near-duplicate embeddings: iterative quantisation, multi-index Hamming tables, reranking by cosine."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from psephos.llm.common import components, few_or_join, forest, spread_join, table, written
from psephos.llm.simhash import signed

#: Runs of up to so many vectors are compared in one task; longer ones are dealt out as pairs of blocks of half this size.
BLOCK = 4096


def fit_itq(x: np.ndarray, bits: int, rounds: int = 50, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """(mean, projection) of iterative quantisation (Gong and Lazebnik, 2011): the principal directions, rotated so that signs lose least."""
    mean = x.mean(axis=0)
    _, _, vt = np.linalg.svd(x - mean, full_matrices=False)
    w = np.zeros((x.shape[1], bits))
    w[:, : min(bits, len(vt))] = vt[:bits].T
    v = (x - mean) @ w
    r = np.linalg.qr(np.random.default_rng(seed).standard_normal((bits, bits)))[0]
    for _ in range(rounds):
        b = np.where(v @ r >= 0, 1.0, -1.0)
        u, _, s = np.linalg.svd(b.T @ v)
        r = (u @ s).T
    return mean, w @ r


def codes(x: np.ndarray, model: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """64-bit codes (uint64) of unit vectors; unused bits are 0."""
    signs = (x - model[0]) @ model[1] >= 0
    padded = np.zeros((len(x), 64), np.uint8)
    padded[:, : signs.shape[1]] = signs
    return np.packbits(padded, axis=1, bitorder="little").view("<u8").reshape(-1)


def table_masks(bits: int, radius: int, agree: int) -> list[int]:
    """A mask for each choice of `agree` of radius + agree chunks: codes within the radius agree in all chunks of one choice at least."""
    cuts = [bits * i // (radius + agree) for i in range(radius + agree + 1)]
    chunks = [sum(1 << i for i in range(a, b)) for a, b in zip(cuts, cuts[1:])]
    return [sum(own) for own in combinations(chunks, agree)]


def _unit(flat: np.ndarray) -> np.ndarray:
    """Unit vectors, also of components whose squares are beyond what a double holds."""
    scaled = flat / np.abs(flat).max(axis=1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def _vectors(column: pa.Array, dim: int, kind: str) -> np.ndarray:
    return _unit(np.frombuffer(b"".join(x.as_py() for x in column), kind).reshape(-1, dim).astype(np.float64))


def _runs(key: np.ndarray) -> np.ndarray:
    """Where runs of equal keys start, and the end."""
    return np.concatenate([[0], np.nonzero(key[1:] != key[:-1])[0] + 1, [len(key)]])


def _whole_runs(batches, fn):
    """fn of the rows that make up whole runs of equal `key`, as they come; the last run of a batch may go on in the next."""
    held = None
    for batch in batches:
        if held is not None:
            batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        if batch.num_rows:
            last = int(_runs(batch.column("key").to_numpy())[-2])
            if last:
                yield from fn(batch.slice(0, last))
            held = batch.slice(last)
    if held is not None:
        yield from fn(held)


def _near_somebody(reach: int):
    """Rows (key, node, code) clustered by key -> those (key, node) whose code is within `reach` bits of another of the same key."""

    def some(batch):
        key, code = batch.column("key").to_numpy(), batch.column("code").to_numpy().view(np.uint64)
        cuts, ok = _runs(key), np.zeros(len(key), bool)
        for f, e in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            for i in range(f, e, 512):
                d = np.bitwise_count(code[i : min(i + 512, e), None] ^ code[None, f:e])
                ok[i : min(i + 512, e)] = (d <= reach).sum(axis=1) > 1  # itself is one
        yield pa.RecordBatch.from_arrays([batch.column("key").filter(pa.array(ok)), batch.column("node").filter(pa.array(ok))], names=["key", "node"])

    return lambda batches: _whole_runs(batches, some)


def _reranked(masks: np.ndarray, dim: int, kind: str, cosine: float, reach: int):
    """Rows (key, mask, lab, node, code, copies, vec, block) clustered by key -> links (a, b, 0), a forest of each run, and each node's number of links (a, null, links).

    Only pairs of codes within `reach` bits count, and a pair that meets under an earlier mask as well is left to that.  In a run of two blocks only pairs of both count.
    """

    def compared(batch):
        for f, e in zip(*(lambda c: (c[:-1].tolist(), c[1:].tolist()))(_runs(batch.column("key").to_numpy()))):
            if e - f > 1:
                yield one(batch.slice(f, e - f))

    def one(own):
        x, code, lab, block, weight, node = (own.column(c) for c in ("vec", "code", "lab", "block", "copies", "node"))
        x, code, lab, block, weight, node = _vectors(x, dim, kind), code.to_numpy().view(np.uint64), lab.to_numpy(), block.to_numpy(), weight.to_numpy(), node.to_numpy()
        n, links, root, two, earlier = len(x), np.zeros(len(x), np.int64), np.arange(len(x)), (block != block[0]).any(), masks[: own.column("mask")[0].as_py()]
        for i in range(0, n, 512):
            a, b = np.nonzero(np.triu(x[i : i + 512] @ x[i:].T >= cosine, 1))
            a, b = a + i, b + i
            differ = code[a] ^ code[b]
            ok = (lab[a] == lab[b]) & (np.bitwise_count(differ) <= reach)
            if two:
                ok &= block[a] != block[b]
            for m in earlier:
                ok &= differ & m != 0
            a, b = a[ok], b[ok]
            if len(a):
                links += np.bincount(a, weight[b], n).astype(np.int64) + np.bincount(b, weight[a], n).astype(np.int64)
                root = forest(n, np.concatenate([a, np.arange(n)]), np.concatenate([b, root]))
        own, some = np.nonzero(root != np.arange(n))[0], np.nonzero(links)[0]
        right = pa.array(np.concatenate([node[root[own]], node[some]]), mask=np.concatenate([np.zeros(len(own), bool), np.ones(len(some), bool)]))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([node[own], node[some]])), right, pa.array(np.concatenate([np.zeros(len(own), np.int64), links[some]]))], names=["a", "b", "links"])

    return lambda batches: _whole_runs(batches, compared)


def near_duplicates(vectors: DataFrame, cosine: float = 0.93, radius: int = 7, bits: int = 64, sample: int = 10_000, crowd: int = 64, reach: int = 24, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label") -> DataFrame:
    """vec_id, n_links, component_id, kept for every row.

    The rotation is learned from at most `sample` vectors, in hash order; every vector is encoded and indexed.  Codes that differ in at most
    `radius` bits meet in a table for certain; keys take as many chunks as keep runs of the largest label near `crowd`.  Tables hold ids and codes only; vectors that meet a code within
    `reach` bits are then brought together by key, and their cosines are computed in double precision.  A task returns link counts and a forest of links, never pairs.  Equal vectors are one
    class with a count.  A key that over BLOCK classes have is dealt out as pairs of blocks, so that every pair of it still meets once.
    Within the radius all links are found; the rest of recall is measured (README).

    A vector that is null, zero, of another length than most, or that holds a null or a non-finite component, links with nothing, as does a
    null label; labels may be of any type that can be compared.  Such rows have n_links 0 and are their own component.  vec_id is cast to long; a null one names no component.  Components of any
    size (1e-300 or 1e300) are scaled first; vectors may be of any length.  Repeated rows link as copies.  Other columns are ignored.  An empty table gives no rows.
    """
    spark = vectors.sparkSession
    kind = "<f4" if vectors.schema[embedding].dataType.elementType.typeName() == "float" else "<f8"
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).alias("label"), F.col(embedding).cast("array<double>").alias("v"))
    sound = F.coalesce(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("v", lambda x: x != 0) & F.col("label").isNotNull(), F.lit(False))
    rows = written(rows.select("vec_id", F.when(sound, F.xxhash64("label")).alias("lab"), F.when(sound, F.col("v")).alias("v"), F.when(sound, F.xxhash64("label", "v")).alias("node")), "vectors")
    lengths = rows.where("v is not null").groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").limit(1).collect()
    if not lengths:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    dim = lengths[0].d
    right = (F.size("v") == dim) & F.col("v").isNotNull()
    usable = rows.where(right)
    bits = min(bits, 64, dim)
    x = _unit(np.array([r.v for r in usable.select("v").orderBy(F.xxhash64("v"), "vec_id").limit(sample).collect()], np.float64))
    model = spark.sparkContext.broadcast(fit_itq(x, bits))
    grouped = usable.groupBy("lab", "v", "node").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("copies"))

    def encode(batches):
        for b in batches:
            v = b.column("v").flatten().to_numpy().reshape(-1, dim)
            vec = pa.array([row.tobytes() for row in v.astype(kind)], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("lab"), b.column("node"), b.column("least"), b.column("copies"), pa.array(codes(_unit(v), model.value).view(np.int64)), vec], names=["lab", "node", "least", "copies", "code", "vec"])

    classes = written(grouped.select("lab", "node", "least", "copies", "v").mapInArrow(encode, "lab long, node long, least long, copies long, code long, vec binary"), "vector_classes")
    largest = classes.groupBy("lab").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]
    agree = next((t for t in (1, 2, 3) if largest <= crowd * 2 ** (bits * t // (radius + t))), 3)
    masks = table_masks(bits, radius, agree)
    keys = F.posexplode(F.array(*[F.xxhash64(F.lit(i), "lab", F.col("code").bitwiseAND(F.lit(signed(m)))) for i, m in enumerate(masks)])).alias("mask", "key")
    indexed = classes.select(keys, "node", "code")
    heavy = written(indexed.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > BLOCK), "vector_heavy")
    many = heavy.count()
    light = indexed.join(few_or_join(heavy.select("key"), many), "key", "left_anti") if many else indexed
    met = light.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("key"))).where("n > 1").select("key", "node", "code")
    some = written(met.mapInArrow(_near_somebody(reach), "key long, node long"), "vector_some")
    fetched = ["lab", "node", "code", "copies", "vec"]
    wanted = some.join(classes.select(*fetched), "node")
    known = F.array_position(F.array(*[F.xxhash64(F.lit(i), "lab", F.col("code").bitwiseAND(F.lit(signed(m)))) for i, m in enumerate(masks)]), F.col("key")) - 1
    columns = ["key", "mask", *fetched, "block"]
    runs = wanted.withColumn("mask", known.cast("int")).withColumn("block", F.lit(0)).select(*columns)
    if many:
        hot = classes.select(keys, *fetched).join(few_or_join(heavy, many), "key").withColumn("blocks", F.ceil(F.col("size") * 2 / BLOCK).cast("int")).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
        pairs = F.expr("explode(transform(sequence(0, blocks - 1), x -> named_struct('lo', least(x, block), 'hi', greatest(x, block))))").alias("pair")
        runs = runs.unionByName(hot.select(*columns, pairs).withColumn("key", F.xxhash64("key", "pair")).select(*columns))
    found = runs.repartition("key").sortWithinPartitions("key").mapInArrow(_reranked(np.array(masks, np.uint64), dim, kind, cosine, reach), "a long, b long, links long")
    every = written(found, "vector_links")
    linked = components(every.where("b is not null").select("a", "b"), "vectors")
    counts = every.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("others"))
    rooted = written(classes.select("node", "least", "copies").join(linked, "node", "left").withColumn("root", F.coalesce("root", "node")), "vector_roots")
    names = written(rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("members")), "vector_names")
    named = spread_join(rooted, names, ["root"], "members", BLOCK).join(counts, "node", "left")
    named = written(named.select("node", "component_id", "copies", (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "vector_named")
    judged = rows.select("vec_id", F.when(right, F.col("node")).alias("node"))
    held = spread_join(judged.where("node is not null"), named, ["node"], "copies", BLOCK).select("vec_id", "n_links", "component_id")
    alone = judged.where("node is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.lit(None).cast("long").alias("component_id"))
    out = held.unionByName(alone).withColumn("component_id", F.coalesce("component_id", "vec_id"))
    return out.select("vec_id", F.col("n_links").cast("long").alias("n_links"), "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def op5_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, n_links, component_id, kept of every vector; unsound vectors, null labels, repeated rows and empty tables as in near_duplicates."""
    return near_duplicates(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))


#: All pairs of a label; for tables whose links are few.
OP5_SQL = """
WITH RECURSIVE ok AS MATERIALIZED (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= 0.93),
r AS (SELECT vec_id AS node, vec_id AS root FROM embeddings UNION SELECT l.b, r.root FROM r JOIN l ON r.node = l.a),
c AS (SELECT node, MIN(root) AS component_id FROM r GROUP BY node),
n AS (SELECT a, COUNT(*) AS n FROM l GROUP BY a)
SELECT e.vec_id, CAST(COALESCE(n.n, 0) AS BIGINT) AS n_links, c.component_id, e.vec_id = c.component_id AS kept FROM embeddings e JOIN c ON e.vec_id = c.node LEFT JOIN n ON e.vec_id = n.a
"""
