"""SimHash near-duplicates by covering locality-sensitive hashing."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from psephos.llm.common import FEW, components, contracted, few_or_join, forest, free_name, give_back_memory, spread_join, table, utf8, written
from psephos.llm.tokens import span_hashes

#: Sketches that are compared in one task at once; keys with more are dealt out in blocks of half as many.
BLOCK = 4096
#: Shingles that are compared in one task at once, likewise.
SHINGLES = 1 << 19
#: Factors that make the words of a wide sketch from a shingle's hash.
_WORDS = np.array([pow(0x9E3779B97F4A7C15, k + 1, 2**64) for k in range(16)], np.uint64)


def sketch(text: str | bytes | None, shingle: int, at_once: int = 1 << 16) -> int:
    """64 bits; a bit is set if it is set in over half of the shingles' XXH64 with seed 42.

    Words are runs without ASCII white space, A-Z lower-cased; shingles are `shingle` of them joined by spaces, repeats included; fewer are
    one shingle; a text without words has zero.  Long texts are counted in runs of at_once shingles.
    """
    w = (text if isinstance(text, bytes) else utf8(text)).lower().split()
    if not w:
        return 0
    n = max(1, len(w) - shingle + 1)
    joined = b" ".join(w)
    ends = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[:n].tolist()
    stops = ends[min(shingle, len(w)) - 1 :].tolist()
    ones = np.zeros(64, np.int64)
    for i in range(0, n, at_once):
        ones += _ones(np.array([xxhash.xxh64_intdigest(joined[s:e], 42) for s, e in zip(starts[i : i + at_once], stops[i : i + at_once])], np.uint64).reshape(-1, 1))
    return int(_majority(ones, n)[0])


def shingle_set(text: str | bytes | None, shingle: int, at_once: int = 1 << 16) -> np.ndarray:
    """64-bit hashes of the different shingles, sorted.  Long texts are hashed in runs of at_once shingles."""
    w = (text if isinstance(text, bytes) else utf8(text)).lower().split()
    out = []
    for i in range(0, max(1, len(w) - shingle + 1) if w else 0, at_once):
        own = w[i : i + at_once + shingle - 1]
        buffer = np.frombuffer(b" ".join(own), np.uint8)
        spaces = np.nonzero(buffer == 32)[0]
        n = max(1, len(own) - shingle + 1)
        out.append(span_hashes(buffer, np.concatenate([[0], spaces + 1])[:n], np.append(spaces, len(buffer))[min(shingle, len(own)) - 1 :]))
    return np.unique(np.concatenate(out)) if out else np.zeros(0, np.uint64)


def set_sketch(hashes: np.ndarray, words: int) -> np.ndarray:
    """The wide sketch of a set of hashes, `words` 64-bit words, and the id of the set as one word more; no hashes, all zero but the id."""
    ones = np.zeros(64 * words, np.int64)
    for i in range(0, len(hashes), 1 << 14):
        h = hashes[i : i + (1 << 14), None] * _WORDS[:words]
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        ones += _ones(h ^ (h >> np.uint64(32)))
    return np.append(_majority(ones, len(hashes)), np.uint64(xxhash.xxh3_64_intdigest(hashes.tobytes())))


def _ones(h: np.ndarray) -> np.ndarray:
    """How often each bit is set in rows of 64-bit words."""
    bits = np.unpackbits(np.ascontiguousarray(h).view(np.uint8), axis=1, bitorder="little")
    return sum((bits[i : i + 255].sum(axis=0, dtype=np.uint8).astype(np.int64) for i in range(0, len(bits), 255)), np.zeros(bits.shape[1], np.int64))


def _majority(ones: np.ndarray, n: int) -> np.ndarray:
    return np.packbits(ones * 2 > n, bitorder="little").view("<u8").astype(np.uint64)


def covering_masks(radius: int, first: int = 0, bits: int = 64) -> list[int]:
    """2**(radius+1) - 1 masks over bits first .. first+bits-1.

    Bit i has the vector i mod (2**(radius+1) - 1) + 1 of radius+1 binary digits; mask v keeps the bits whose vector has odd overlap with v.
    For any `radius` bits some v overlaps evenly with all their vectors, so two sketches that differ in these bits only agree under that mask.
    """
    most = 2 ** (radius + 1) - 1
    return [sum(1 << (first + i) for i in range(bits) if ((i % most + 1) & v).bit_count() % 2) for v in range(1, most + 1)]


def all_masks(radius: int, segments: int) -> list[int]:
    """Masks for a radius over the whole word: in one of the segments at most radius // segments bits differ."""
    cuts = [64 * i // segments for i in range(segments + 1)]
    return [m for a, b in zip(cuts, cuts[1:]) for m in covering_masks(radius // segments, a, b - a)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _near(s: np.ndarray, a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """Which pairs of rows a, b of the sketches s (n x words, uint64) link."""
    return np.bitwise_count(s[a] ^ s[b]).sum(axis=1, dtype=np.int64) <= most


def links_in_run(s: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links among the sketches s, as row numbers; fewer than len(s) edges whatever the number of links."""
    n = len(s)
    if n <= 512:
        d = np.zeros((n, n), np.int16)
        for k in range(s.shape[1]):
            d += np.bitwise_count(s[:, None, k] ^ s[None, :, k])
        a, b = np.nonzero(np.triu(d <= most, 1))
        if len(a) >= n:
            root = forest(n, a, b)
            b = np.nonzero(root != np.arange(n))[0]
            a = root[b]
        return a, b
    left, from_, to = np.arange(n), [], []
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            at = queue.pop()
            ok = _near(s, np.full(1, at), left, most)
            found = left[ok]
            from_.append(np.full(len(found), at))
            to.append(found)
            queue += found.tolist()
            left = left[~ok]
    return (np.concatenate(from_), np.concatenate(to)) if from_ else (left, left)


def _runs(compare, columns: list[str], flat: bool):
    """Rows clustered by key -> (a, b), the links of each run as nodes.  compare takes a run's columns, as rows of words if `flat`, else as bytes."""

    def run(batches):
        held = None

        def values(batch):
            return np.stack([batch.column(c).to_numpy() for c in columns], axis=1).view(np.uint64) if flat else batch.column(columns[0])

        def found(batch, sizes):
            at, out_a, out_b = np.cumsum(sizes) - sizes, [], []
            x, node = values(batch), batch.column("node").to_numpy()
            if flat:  # the many short runs at once
                for k in (2, 3):
                    own = at[sizes == k]
                    for i in range(k):
                        for j in range(i + 1, k):
                            ok = compare.near(x, own + i, own + j)
                            out_a.append(own[ok] + i)
                            out_b.append(own[ok] + j)
            for f, k in zip(at.tolist(), sizes.tolist()):
                if k > 3 or k > 1 and not flat:
                    a, b = compare(x[f : f + k])
                    out_a.append(a + f)
                    out_b.append(b + f)
            a, b = (np.concatenate([*o, np.zeros(0, np.int64)]).astype(np.int64) for o in (out_a, out_b))
            return pa.RecordBatch.from_arrays([pa.array(node[a]), pa.array(node[b])], names=["a", "b"])

        for batch in batches:
            if held is not None:
                batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            if not batch.num_rows:
                continue
            key = batch.column("key").to_numpy()
            cuts = np.concatenate([[0], np.nonzero(key[1:] != key[:-1])[0] + 1])
            if len(cuts) > 1:
                yield found(batch.slice(0, cuts[-1]), np.diff(cuts))
            held = batch.slice(cuts[-1])  # the last run may go on
        if held is not None:
            yield found(held, np.array([held.num_rows]))
        give_back_memory()

    return run


class Near:
    """Links of sketches: at most `most` differing bits."""

    def __init__(self, most: int):
        self.most = most

    def near(self, s: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return _near(s, a, b, self.most)

    def __call__(self, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return links_in_run(s, self.most)


class Similar:
    """Links of sets of hashes: a Jaccard similarity of `least` or more."""

    def __init__(self, least: float):
        self.least = least

    def __call__(self, hashes: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        return _similar_in_run([np.frombuffer(h.as_py(), np.uint64) for h in hashes], self.least)


def linked(keyed: DataFrame, columns: list[str], compare, limit: int, name: str, weight: Column) -> DataFrame:
    """(node, root): components of what compare links among the rows of one key (key, node, columns).

    Keys are weighed by a partial aggregation.  The rows of a key of at most `limit` meet in one task, and only a forest of their links leaves it.  A heavier key is dealt out in
    blocks of half the limit, each compared in itself; then the rows outside the key's largest component so far are compared with all of the key, block by block.
    So a large group of things that are alike costs as much as its rows, and no link is lost.
    """
    kinds, flat = "a long, b long", columns != ["hashes"]
    carried = ["node", *[c for c in columns if c != "node"]]
    fn = contracted(_runs(compare, columns, flat))
    rows = keyed.select("key", *carried)
    heavy = written(rows.groupBy("key").agg(F.sum(weight).alias("size")).where(F.col("size") > limit), f"{name}_heavy")
    many = heavy.count()
    light = rows.join(few_or_join(heavy.select("key"), many), "key", "left_anti") if many else rows
    met = light.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("key"))).where("n > 1").select("key", *carried)
    edges = met.mapInArrow(fn, kinds)
    if not many:
        return components(edges, name, contract=False)
    dealt = lambda df: df.repartition("key").sortWithinPartitions("key").select("key", *carried).mapInArrow(fn, kinds)
    parts = F.ceil(F.col("size") * 2 / limit).cast("int")
    hot = rows.join(few_or_join(heavy, many), "key").withColumn("blocks", parts).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).drop("size")
    hot = written(hot, f"{name}_hot")
    found = components(edges.unionByName(dealt(hot.withColumn("key", F.xxhash64("key", "block")))), name, contract=False)
    at = written(hot.select("key", "node", weight.alias("weight")).join(found, "node", "left").withColumn("root", F.coalesce("root", "node")), f"{name}_at")
    main = at.groupBy("key", "root").agg(F.sum("weight").alias("w")).groupBy("key").agg(F.max_by("root", F.struct("w", "root")).alias("main"))
    outside = written(at.join(few_or_join(main, many), "key").where("root <> main").select("key", "node", "weight"), f"{name}_outside")
    sizes = outside.groupBy("key").agg(F.ceil(F.sum("weight") * 2 / limit).cast("int").alias("others"))
    if outside.isEmpty():
        return found
    all_ = hot.join(few_or_join(sizes, many), "key")
    own = outside.select(F.col("key").alias("_key"), F.col("node").alias("_node"))
    few = all_.join(own, (F.col("key") == F.col("_key")) & (F.col("node") == F.col("_node")), "left_semi").withColumn("other", F.pmod(F.xxhash64("node"), F.col("others")).cast("int"))
    pair = lambda df, i, j: df.withColumn("key", F.xxhash64("key", i, j)).select("key", *carried)
    one = pair(few.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))), "other", "j")
    two = pair(all_.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("others") - 1))), "i", "block")
    return components(dealt(one.unionByName(two)).unionByName(found.select(F.col("node").alias("a"), F.col("root").alias("b"))), name, contract=False)


def proposed(sketches: DataFrame, words: list[str], radius: int, most: int, segments: int = 1, name: str = "simhash") -> DataFrame:
    """(node, root): components of the links among distinct sketches (a long column node, and words; with one word, words is [node]).

    Sketches link if they differ in at most `most` bits over all words.  Every pair that differs in at most `radius` bits of one of the words meets under one mask at least, so every pair
    that differs in less than (radius + 1) * len(words) bits does.  Sketches with the same mask and masked word (known by a hash) are compared where they meet.
    """
    masks = all_masks(radius, segments)
    keys = F.explode(F.array(*[F.xxhash64(F.lit(k * len(masks) + i), F.col(w).bitwiseAND(F.lit(signed(m)))) for k, w in enumerate(words) for i, m in enumerate(masks)])).alias("key")
    return linked(sketches.select(keys, "node", *[w for w in words if w != "node"]), words, Near(most), BLOCK, name, F.lit(1))


#: Texts whose sketches, and sets, leave a worker at once.
_AT_ONCE = 1024


def with_sketches(docs: DataFrame, shingle: int, names: list[str], text: str, keep: bool = True) -> DataFrame:
    """docs with each text's sketch as long columns `names`: one, of the shingles with repeats; several, those of set_sketch.  The text itself goes unless `keep`."""
    rest = [c for c in docs.columns if keep or c != text]

    def run(batches):
        for whole in batches:
            for f in range(0, whole.num_rows, _AT_ONCE):
                b = whole.slice(f, _AT_ONCE)
                texts = b.column(b.schema.get_field_index(text)).cast(pa.large_binary())
                rows = [sketch(t.as_py(), shingle) if len(names) == 1 else set_sketch(shingle_set(t.as_py(), shingle), len(names) - 1) for t in texts]
                s = np.array(rows, np.uint64).reshape(-1, len(names)).view(np.int64)
                yield pa.RecordBatch.from_arrays([*[b.column(b.schema.get_field_index(c)) for c in rest], *[pa.array(np.ascontiguousarray(s[:, k])) for k in range(len(names))]], names=[*rest, *names])
        give_back_memory()

    kinds = dict(docs.dtypes)
    return docs.mapInArrow(run, ", ".join([*[f"`{c}` {kinds[c]}" for c in rest], *[f"`{n}` long" for n in names]]))


def _similar_in_run(sets: list[np.ndarray], least: float) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links among sets of hashes, as row numbers; a link is a Jaccard similarity of `least` or more."""
    n, size = len(sets), np.array([len(x) for x in sets], np.int64)
    _, token = np.unique(np.concatenate(sets), return_inverse=True)
    starts, owner = np.cumsum(size) - size, np.repeat(np.arange(n), size)
    left, from_, to = np.ones(n, bool), [], []
    for first in range(n):
        queue = [first] if left[first] else []
        left[first] = False
        while queue and left.any():
            at = queue.pop()
            flag = np.zeros(int(token.max(initial=-1)) + 1, bool)
            flag[token[starts[at] : starts[at] + size[at]]] = True
            both = np.bincount(owner[flag[token]], minlength=n)
            found = np.nonzero(left & (both >= least * (size + size[at] - both) - 1e-9))[0]
            left[found] = False
            from_.append(np.full(len(found), at))
            to.append(found)
            queue += found.tolist()
            if len(token) > 2 * int(size[left].sum() + sum(size[q] for q in queue)):  # those that are done are left out
                keep = left.copy()
                keep[queue] = True
                held = keep[owner]
                token, owner = token[held], owner[held]
                own = np.bincount(owner, minlength=n)
                starts = np.cumsum(own) - own
    return (np.concatenate(from_), np.concatenate(to)) if from_ else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def confirmed(docs: DataFrame, classes: DataFrame, groups: DataFrame, shingle: int, least: float, set_id: str, doc_id: str, text: str) -> DataFrame:
    """(node, root): components of the links whose sets of shingles have a Jaccard similarity of `least` or more, within the components (node, root) of what sketches propose.

    Every pair within a component is compared, or joined by other links, also pairs that sketches did not propose.  A class (node, least, set id) sends the set of one document.
    """
    members = groups.unionByName(groups.select(F.col("root").alias("node"), "root").distinct())
    reps = written(classes.select("node", F.col("least").alias("_id"), F.col(set_id).alias("set_id")).join(members, "node"), "proposed")
    ids = reps.select("_id").distinct()
    narrow = docs.select(F.col(doc_id).cast("long").alias("_doc"), F.col(text).alias("_text"))
    many = reps.count()
    own = narrow.join(few_or_join(ids, many), F.col("_doc").eqNullSafe(F.col("_id")), "left_semi").select("_text")

    def run(batches):
        for whole in batches:
            for f in range(0, whole.num_rows, _AT_ONCE):
                x = [shingle_set(t.as_py(), shingle) for t in whole.column(0).slice(f, _AT_ONCE).cast(pa.large_binary())]
                yield pa.RecordBatch.from_arrays([pa.array([int(set_sketch(h, 0)[0].view(np.int64)) for h in x], pa.int64()), pa.array([h.tobytes() for h in x], pa.binary())], names=["set_id", "hashes"])
        give_back_memory()

    # the sets are not moved to find their groups: a row for each class goes where they are made; rows with the id and the set of a class are its copies and do no harm
    named = few_or_join(reps.select("set_id", "node", F.col("root").alias("key")), many)
    sets = written(own.mapInArrow(run, "set_id long, hashes binary").join(named, "set_id").select("key", "node", "hashes"), "sets")
    return linked(sets, ["hashes"], Similar(least), SHINGLES, "similar", F.octet_length("hashes") / 8 + 64)


def near_duplicates(docs: DataFrame, shingle: int = 4, radius: int = 4, words: int = 1, most: int | None = None, segments: int = 1, doc_id: str = "doc_id", text: str = "text", jaccard: float | None = None) -> DataFrame:
    """doc_id, w0, w1, ..., group, component_id for every document: component_id is the smallest doc_id reachable by links, itself included; group numbers components.

    With words = 1 a sketch is that of all shingles, repeats included; with more it is of the set of shingles, and one word more, the last, names the set.  Equal sketches are one class, so copies
    meet no further than one grouped aggregation.  A null text is empty; an empty text has the zero sketch and links like any other; texts of any length are taken whole.
    doc_id is cast to long.  A null doc_id names no component; documents without an id get the smallest id of their component, null if there is none.
    Repeated rows are repeated.  Other columns are ignored, whatever their names; an empty table gives no rows.

    With `jaccard` (words > 1), sketches only propose; a link is a Jaccard similarity of the sets of that much or more.
    """
    sets = words > 1
    sketched = [f"w{k}" for k in range(words)]
    all_words = [*sketched, f"w{words}"] if sets else sketched
    narrow = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("_text"))
    prints = written(with_sketches(narrow, shingle, all_words, "_text", keep=False), "fingerprints")
    node = F.xxhash64(*all_words) if sets else F.col("w0")
    classes = written(prints.groupBy(*all_words).agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")).withColumn("node", node), "classes")
    groups = proposed(classes.select("node", *(all_words if sets else [])), sketched if sets else ["node"], radius, radius if most is None else most, segments)
    if jaccard is not None:
        groups = confirmed(docs, classes, groups, shingle, jaccard, all_words[-1], doc_id, text)
    rooted = written(classes.join(groups, "node", "left").withColumn("root", F.coalesce("root", "node")), "rooted")
    names = written(rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("members")), "names")
    named = written(spread_join(rooted, names, ["root"], "members", BLOCK).select(*all_words, "n", F.col("root").alias("group"), "component_id"), "named")
    return spread_join(prints, named, all_words, "n", BLOCK).select("doc_id", *all_words, "group", "component_id")


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 5, words: int = 1, most_gone: int = FEW, **options) -> DataFrame:
    """The documents that stay: of each group the one with the smallest doc_id; of its rows with that same id, the first by text; all columns as they are.

    Ids that go are few beside the texts: up to most_gone of them are sent to where the texts are read; more are joined.
    Ids that several rows share are told apart by their sketches.  Null ids, null and empty texts, repeated rows and empty tables are as in near_duplicates; columns may have any names.
    """
    groups = written(near_duplicates(docs, shingle=shingle, words=words, doc_id=doc_id, text=text, **options), "groups")
    words += words > 1
    id_, rank, times = (free_name(docs, n) for n in ("kept_id", "kept_rank", "kept_times"))
    repeated = groups.groupBy(F.col("doc_id").alias(id_)).agg(F.count(F.lit(1)).alias(times), F.min(F.col("doc_id").eqNullSafe(F.col("component_id"))).alias(rank))
    repeated = written(repeated.where((F.col(times) > 1) | ~F.col(rank)), "kept")
    few = repeated.count() <= most_gone
    gone = repeated.select(id_)
    once = docs.join(F.broadcast(gone) if few else gone, docs[doc_id].eqNullSafe(F.col(id_)), "left_anti")
    shared = repeated.where(F.col(times) > 1).select(id_)
    if shared.isEmpty():
        return once
    names = [free_name(docs, f"w{k}") for k in range(words)]
    rows = with_sketches(docs.join(shared, docs[doc_id].eqNullSafe(F.col(id_)), "left_semi"), shingle, names, text)
    best = groups.where("doc_id <=> component_id").select(F.col("doc_id").alias(id_), F.col("group").alias(rank), *[F.col(f"w{k}").alias(f"_{times}{k}") for k in range(words)]).distinct()
    same = rows[doc_id].eqNullSafe(best[id_])
    for k, n in enumerate(names):
        same = same & (rows[n] == best[f"_{times}{k}"])
    first = rows.join(best, same).withColumn(times, F.row_number().over(Window.partitionBy(rank).orderBy(text))).where(F.col(times) == 1)
    return once.unionByName(first.select(*docs.columns))


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint, component_id of every document; nulls, empty and long texts, repeated rows and empty tables as in near_duplicates."""
    out = near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), shingle=4, radius=4)
    return out.select("doc_id", F.lower(F.lpad(F.hex("w0"), 16, "0")).alias("fingerprint"), "component_id")
