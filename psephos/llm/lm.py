"""Word trigram and bigram models with interpolated modified Kneser-Ney smoothing, kept as sorted hash arrays that workers map into memory."""

from __future__ import annotations

import functools
import os
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from psephos.llm.common import give_back_memory, local_mount, shared_path, table, written
from psephos.llm.tokens import _SPACE, span_hashes, text_runs

#: Hashes of the marks before and after a text; no word has them but by chance.
BEGIN, END = np.uint64(0x243F6A8885A308D3), np.uint64(0x13198A2E03707344)
_FLUSH = 4_000_000  # tokens whose counts are combined before the shuffle


def mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A 64-bit hash of pairs of hashes."""
    h = (a ^ (a >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + b * np.uint64(0x94D049BB133111EB)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def token_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens on end, each text closed by END; and the number of tokens of each text."""
    joined = b"\n".join([*texts, b""]).lower()
    buffer = np.frombuffer(joined, np.uint8)
    space = _SPACE[buffer]
    starts = np.nonzero(~space & np.concatenate([[True], space[:-1]]))[0]
    ends = np.nonzero(~space & np.concatenate([space[1:], [True]]))[0] + 1
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    n = np.diff(np.searchsorted(starts, np.cumsum(sizes)), prepend=0)
    return np.insert(span_hashes(buffer, starts, ends), np.cumsum(n), END), n + 1


def previous(h: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The token before each: BEGIN at the start of a text."""
    before = np.concatenate([[BEGIN], h[:-1]])
    before[np.cumsum(n) - n] = BEGIN
    return before


def _shard(h: np.ndarray, bits: int) -> np.ndarray:
    return (h >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(h), np.int64)


# --- packed runs of pairs and of counts ------------------------------------------------------------


def _squeeze(*arrays: np.ndarray) -> bytes:
    out = []
    for a in arrays:
        raw = a.tobytes()
        small = pa.compress(raw, codec="zstd", asbytes=True)
        out += [np.array([len(raw), len(small)], "<i8").tobytes(), small]
    return b"".join(out)


def _unsqueeze(data: bytes, *kinds: str) -> list[np.ndarray]:
    out, at = [], 0
    for kind in kinds:
        n, small = np.frombuffer(data, "<i8", 2, at)
        out.append(np.frombuffer(pa.decompress(data[at + 16 : at + 16 + small], int(n), codec="zstd", asbytes=True), kind))
        at += 16 + int(small)
    return out


def _bytes_of(x: np.ndarray) -> np.ndarray:
    """Sorted hashes as differences, byte by byte: high bytes are mostly zero and pack well."""
    return np.ascontiguousarray(np.diff(x, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T)


def _from_bytes(x: np.ndarray) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(x.reshape(8, -1).T).reshape(-1).view(np.uint64))


def _pack_pairs(h1, h2, c) -> bytes:
    """Pairs sorted by h1: contexts as differences, followers by their place among the sorted words of the run."""
    contexts, runs = np.unique(h1, return_counts=True)
    words, at = np.unique(h2, return_inverse=True)
    place = at.astype("<u4").view(np.uint8).reshape(-1, 4).T
    return _squeeze(_bytes_of(contexts), runs.astype("<u4"), _bytes_of(words), np.ascontiguousarray(place), c.astype("<u4"))


def _unpack_pairs(data: bytes):
    contexts, runs, words, place, c = _unsqueeze(data, "u1", "<u4", "u1", "u1", "<u4")
    at = np.ascontiguousarray(place.reshape(4, -1).T).reshape(-1).view("<u4")
    return np.repeat(_from_bytes(contexts), runs), _from_bytes(words)[at], c


_ROWS = "shard int, payload binary"


def _owner(h1: np.ndarray, pair: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """The hash whose leading bits name a pair's shard: that of its context, or for hot contexts that of the pair, so that these are spread over all shards."""
    return np.where(np.isin(h1, hot), pair, h1)


def _count(bits: int, hot: np.ndarray):
    """Texts -> packed pair counts by shard, combined over up to _FLUSH tokens."""

    def run(batches):
        held, size = [], 0

        def flush():
            h1, h2 = (np.concatenate(x) for x in zip(*held))
            pair, first, c = np.unique(mix(h1, h2), return_index=True, return_counts=True)
            h1, h2 = h1[first], h2[first]
            shard = _shard(_owner(h1, pair, hot), bits)
            order = np.lexsort((h1, shard))
            h1, h2, c = h1[order], h2[order], c[order]
            cuts = np.searchsorted(shard[order], np.arange(2**bits + 1))
            shards = np.nonzero(np.diff(cuts))[0]
            packed = [_pack_pairs(h1[a:b], h2[a:b], c[a:b]) for a, b in zip(cuts[shards], cuts[shards + 1])]
            return pa.RecordBatch.from_arrays([pa.array(shards.astype(np.int32)), pa.array(packed, pa.binary())], names=["shard", "payload"])

        for b in batches:
            for _, texts in text_runs(b.column(0)):
                h, n = token_hashes(texts)
                held.append((previous(h, n), h))
                size += len(h)
                if size >= _FLUSH:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    return run


def _frequent(bits: int):
    """Texts -> (word, n): how often hashes that are frequent in a run of texts are contexts there, and for word null how many contexts there are."""

    def run(batches):
        for b in batches:
            for _, texts in text_runs(b.column(0), 4 << 20):
                before = previous(*token_hashes(texts))
                words, n = np.unique(before, return_counts=True)
                often = n * (32 << bits) > len(before)
                yield pa.RecordBatch.from_arrays([pa.array([None, *words[often].view(np.int64).tolist()], pa.int64()), pa.array([len(before), *n[often].tolist()], pa.int64())], names=["word", "n"])

    return run


def hot_contexts(texts: DataFrame, size: int, bits: int, sample_mb: int = 16) -> np.ndarray:
    """Sorted hashes of the words that make up more than an eighth of an average shard, so at most eight a shard, by a sample of about sample_mb.  They only say where pairs are counted."""
    counted = texts.sample(min(1.0, (sample_mb << 20) / max(size, 1)), seed=5).mapInArrow(_frequent(bits), "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    rows = counted.orderBy(F.col("word").isNotNull(), F.desc("n"), "word").limit((8 << bits) + 1).collect()
    every = rows[0].n if rows else 0
    return np.sort(np.array([r.word for r in rows[1:] if r.n * (8 << bits) > every], np.int64).view(np.uint64))


def _save(folder: str, shard: int, **arrays: np.ndarray) -> None:
    """One file per array, put in place by renaming, so a task that runs twice does no harm."""
    os.makedirs(folder, exist_ok=True)
    for name, a in arrays.items():
        part = f"{folder}/.{shard}.{name}.{os.getpid()}"
        with open(part, "wb") as f:
            np.save(f, a)
        os.replace(part, f"{folder}/{shard}.{name}.npy")


def _bytes_with_rest(c: np.ndarray) -> dict[str, np.ndarray]:
    """Counts as bytes; those from 255 on also by place."""
    large = np.nonzero(c >= 255)[0]
    return {"count": np.minimum(c, 255).astype(np.uint8), "large": large.astype(np.int64), "large_count": c[large].astype(np.int64)}


def _levels(c: np.ndarray) -> list[int]:
    return [int((c == k).sum()) for k in (1, 2, 3, 4)]


def _reduce_pairs(folder: str, bits: int, hot: np.ndarray):
    """All of a shard's packed pairs -> its arrays on disk, figures, and packed continuation counts by shard of the word; what hot contexts have here is a row each, to be added up."""

    def run(rows: pa.Table) -> pa.Table:
        shard = rows.column("shard")[0].as_py()
        h1, h2, c = (np.concatenate(x) for x in zip(*(_unpack_pairs(p.as_py()) for p in rows.column("payload"))))
        pair, first, at = np.unique(mix(h1, h2), return_index=True, return_inverse=True)
        c, h1, h2 = np.bincount(at, c).astype(np.int64), h1[first], h2[first]
        del at, first
        order = np.argsort(h1)
        contexts, begins = np.unique(h1[order], return_index=True)
        own = c[order]
        total, ones, twos, size = np.add.reduceat(own, begins), np.add.reduceat(own == 1, begins, dtype=np.int64), np.add.reduceat(own == 2, begins, dtype=np.int64), np.diff(np.append(begins, len(own)))
        more, spread = size - ones - twos, np.isin(contexts, hot)
        _save(folder, shard, pair=pair, **_bytes_with_rest(c), context=contexts[~spread], total=total[~spread].astype(np.int64), ones=ones[~spread].astype(np.uint32), twos=twos[~spread].astype(np.uint32), more=more[~spread].astype(np.uint32))
        figures = [[int(c.sum()), int((contexts[~spread] != BEGIN).sum()), int(c[h2 == END].sum()), *_levels(c)]]
        parts = np.stack([contexts.view(np.int64), total, ones, twos, more], axis=1)[spread].tolist()
        words, followed = np.unique(h2, return_counts=True)
        cuts = np.searchsorted(_shard(words, bits), np.arange(2**bits + 1))
        shards = np.nonzero(np.diff(cuts))[0]
        packed = [_squeeze(_bytes_of(words[a:b]), followed[a:b].astype("<u4")) for a, b in zip(cuts[shards], cuts[shards + 1])]
        return pa.table({"shard": pa.array([-1, *[-2] * len(parts), *shards.tolist()], pa.int32()), "payload": pa.array([b"", *[b""] * len(parts), *packed], pa.binary()), "figures": pa.array([*figures, *parts, *[None] * len(packed)], pa.list_(pa.int64()))})

    return run


def _reduce_words(folder: str):
    def run(rows: pa.Table) -> pa.Table:
        shard = rows.column("shard")[0].as_py()
        words, n = (np.concatenate(x) for x in zip(*((_from_bytes(w), k) for w, k in (_unsqueeze(p.as_py(), "u1", "<u4") for p in rows.column("payload")))))
        words, at = np.unique(words, return_inverse=True)
        n = np.bincount(at, n).astype(np.int64)
        _save(folder, shard, word=words, before=n)
        return pa.table({"figures": pa.array([[int(n.sum()), *_levels(n), int((n > 2).sum())]], pa.list_(pa.int64()))})

    return run


# --- the model ---------------------------------------------------------------------------------


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """Chen and Goodman's D1, D2, D3+; where a count of counts is 0, 0.5, 0.75 and 0.9."""
    if not all((n1, n2, n3, n4)):
        return 0.5, 0.75, 0.9
    y = n1 / (n1 + 2 * n2)
    return tuple(min(max(k - (k + 1) * y * b / a, 0.0), float(k)) for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4)))


@dataclass(frozen=True)
class Model:
    """folder: the shards' arrays; bits: leading hash bits that name a shard."""

    folder: str
    bits: int
    tokens: int  # N: all training tokens
    words: int  # V: distinct ones
    ends: int  # training texts
    pairs: tuple[float, float, float]  # discounts
    singles: tuple[float, float, float]
    before: int  # distinct pairs
    left: float  # what the words' discounts leave for words never seen
    hot: np.ndarray  # contexts whose pairs are in all shards, sorted
    hot_figures: np.ndarray  # total, ones, twos, more of each; with order 3, how often each was seen before these
    triples: tuple[float, float, float] | None = None  # discounts of trigrams; None with order 2

    @property
    def rest(self) -> float:
        return 1.0 / (self.words + 1)


@functools.lru_cache(maxsize=4096)
def _mapped(path: str) -> np.ndarray | None:
    try:
        a = np.load(path, mmap_mode="r")
    except (FileNotFoundError, ValueError):  # no shard of that number, or an array of none
        a = np.load(path) if os.path.exists(path) else None
    return a


def _look_up(model: Model, key: str, owner: np.ndarray, keys: np.ndarray, wanted: tuple[str, ...]) -> list[np.ndarray]:
    """For sorted keys in the shards of owner: the arrays wanted at each key's place, 0 where it is not found."""
    out = [np.zeros(len(keys), np.int64) for _ in wanted]
    shards = _shard(owner, model.bits)
    order = np.argsort(shards, kind="stable")
    cuts = np.searchsorted(shards[order], np.arange(2**model.bits + 1)) if model.bits <= 12 else None
    todo = np.nonzero(np.diff(cuts))[0] if cuts is not None else np.unique(shards)
    for s in todo.tolist():
        own = order[cuts[s] : cuts[s + 1]] if cuts is not None else order[np.searchsorted(shards[order], s) : np.searchsorted(shards[order], s + 1)]
        held = _mapped(f"{model.folder}/{s}.{key}.npy")
        if held is None:
            continue
        at = np.searchsorted(held, keys[own])
        found = at < len(held)
        found[found] = held[at[found]] == keys[own][found]
        own, at = own[found], at[found]
        for o, name in zip(out, wanted):
            v = _mapped(f"{model.folder}/{s}.{name}.npy")[at].astype(np.int64)
            if name == "count" and (full := v == 255).any():
                v[full] = _mapped(f"{model.folder}/{s}.large_count.npy")[np.searchsorted(_mapped(f"{model.folder}/{s}.large.npy"), at[full])]
            o[own] = v
    return out


def _contexts(model: Model, words: np.ndarray, wanted: tuple[str, ...], figures: tuple[str, ...] = ("total", "ones", "twos", "more")) -> list[np.ndarray]:
    """Figures of the sorted words as contexts; 0 where a word is none."""
    out = _look_up(model, "context", words, words, wanted)
    if len(model.hot):
        at = np.minimum(np.searchsorted(model.hot, words), len(model.hot) - 1)
        found = model.hot[at] == words
        for o, name in zip(out, wanted):
            o[found] = model.hot_figures[at[found], figures.index(name)]
    return out


def _less(c: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
    return np.maximum(c - np.array([0.0, *d])[np.minimum(c, 3)], 0.0)


def score_texts(model: Model, texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """n_tokens, n_known, base score and model score of each text."""
    h, n = token_hashes(texts)
    before = previous(h, n)
    words, at = np.unique(h, return_inverse=True)
    (seen,) = _contexts(model, words, ("total",))
    seen[words == END] = model.ends
    (distinct,) = _look_up(model, "word", words, words, ("before",))
    single = model.rest if not model.before else _less(distinct, model.singles) / model.before + model.left * model.rest
    single = np.broadcast_to(single, len(words))
    contexts, back = np.unique(before, return_inverse=True)
    total, ones, twos, more = _contexts(model, contexts, ("total", "ones", "twos", "more"))
    pair, first, which = np.unique(mix(before, h), return_index=True, return_inverse=True)
    (count,) = _look_up(model, "pair", _owner(before[first], pair, model.hot), pair, ("count",))
    d1, d2, d3 = model.pairs
    of = back[first]
    known = total[of] > 0
    divisor = np.where(known, total[of], 1)
    spare = np.where(known, (d1 * ones[of] + d2 * twos[of] + d3 * more[of]) / divisor, 1.0)
    p = np.where(known, _less(count, model.pairs) / divisor, 0.0) + spare * single[at[first]]
    base = np.log10((seen + 1) / (model.tokens + model.words + 1))
    starts = np.cumsum(n) - n
    return n, np.add.reduceat((seen > 0)[at].astype(np.int64), starts), np.add.reduceat(base[at], starts), np.add.reduceat(np.log10(p)[which], starts)


def _train2(texts: DataFrame, text: str, shard_mb: int) -> Model:
    """Counts all texts.  A task combines its pairs, packs them by leading bits of the context's hash, and each shard becomes sorted arrays.

    Pair counts and their contexts' totals come from one shuffle; the number of different words before each word from a second, small one.
    Shards grow in number with the input (about shard_mb of it each).  A context that many pairs share, the start of a text or a very frequent word, is spread over all shards by its pairs, and
    its figures are sums over them.  Only figures of the shards, and of such contexts, come to the driver.  Null and empty texts count as an end alone; texts of any length are counted whole;
    repeated rows count each; without texts every word has the same chance.
    """
    spark = texts.sparkSession
    texts = texts.select(F.col(text).alias("text"))
    size, bits = _sized(texts, shard_mb)
    folder = local_mount(shared_path(spark, "bigrams"))
    os.makedirs(folder, exist_ok=True)
    hot = hot_contexts(texts, size, bits)
    pairs = texts.mapInArrow(_count(bits, hot), _ROWS)
    first = written(pairs.repartition(2**bits, "shard").groupBy("shard").applyInArrow(_reduce_pairs(folder, bits, hot), f"{_ROWS}, figures array<bigint>"), "bigram_words")
    second = first.where("shard >= 0").select("shard", "payload").repartition(2**bits, "shard").groupBy("shard").applyInArrow(_reduce_words(folder), "figures array<bigint>")
    n = 7
    a = np.array(_summed(first.where("shard = -1"), n) or [0] * n, np.int64).tolist()
    b = np.array(_summed(second, 6) or [0] * 6, np.int64).tolist()
    parts = first.where("shard = -2").groupBy(F.col("figures")[0].alias("word")).agg(*[F.sum(F.col("figures")[i]).alias(f"f{i}") for i in range(1, 5)]).collect()
    found = sorted((np.int64(r.word).view(np.uint64), [r.f1, r.f2, r.f3, r.f4]) for r in parts)
    hot = np.array([w for w, _ in found], np.uint64)
    figures = np.array([f for _, f in found], np.int64).reshape(-1, 4)
    singles = discounts(*b[1:5])
    left = (singles[0] * b[1] + singles[1] * b[2] + singles[2] * b[5]) / b[0] if b[0] else 1.0
    words = a[1] + int((hot != BEGIN).sum()) + (a[2] > 0)
    return Model(folder, bits, a[0], words, a[2], discounts(*a[3:7]), singles, b[0], left, hot, figures)


def _sized(texts: DataFrame, shard_mb: int) -> tuple[int, int]:
    """The size of the input as Spark knows it, and the bits that name a shard."""
    size = int(str(texts._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    size = size if size < 1 << 60 else 32 * (shard_mb << 20)  # Spark gives a huge size where it knows none
    return size, max(2, (size // (shard_mb << 20)).bit_length())


def _summed(rows: DataFrame, n: int) -> list[int] | None:
    """The sums of the first n figures; None without rows."""
    r = rows.agg(*[F.sum(F.col("figures")[i]).alias(f"f{i}") for i in range(n)]).first()
    return None if r.f0 is None else [r[f"f{i}"] for i in range(n)]


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs, their text column replaced by n_tokens, n_known, base_score, score; perplexity is 10 ** (-score / n_tokens).

    A null text is empty: one token, the end.  Texts of any length are scored whole.  Rows are scored each; an empty table gives no rows.  Columns of those four names are replaced.
    """
    rest = [c for c in docs.columns if c.lower() not in {text.lower(), "n_tokens", "n_known", "base_score", "score"}]

    def run(batches):
        for b in batches:
            for first, texts in text_runs(b.column(b.schema.get_field_index(text)), 3 << 20):
                yield pa.RecordBatch.from_arrays([*[b.column(b.schema.get_field_index(c)).slice(first, len(texts)) for c in rest], *map(pa.array, (score_texts if model.triples is None else score_texts3)(model, texts))], names=[*rest, "n_tokens", "n_known", "base_score", "score"])

    kinds = dict(docs.dtypes)
    return docs.mapInArrow(run, ", ".join([*[f"`{c}` {kinds[c]}" for c in rest], "n_tokens long, n_known long, base_score double, score double"]))


# --- order 3 -------------------------------------------------------------------------------------
#
# A trigram u v w is counted in the shard of its middle word v, so that all trigrams with it, the contexts u v, the pairs v w and the figures of v are made in one task; if v is hot, in
# the shard of u v, and the pairs v w of hot words are added up by a second, small shuffle.


def _pack_triples(u, v, w, c) -> bytes:
    """Triples, those alike in v and u near each other: places among the sorted words of the run, those of v as differences, byte by byte."""
    words, at = np.unique(np.concatenate([u, v, w]), return_inverse=True)
    i, j, k = at.astype("<u4").reshape(3, -1)
    planes = [np.ascontiguousarray(x.view(np.uint8).reshape(-1, 4).T) for x in (np.diff(j, prepend=np.uint32(0)).astype("<u4"), i, k)]
    return _squeeze(_bytes_of(words), *planes, c.astype("<u4"))


def _unpack_triples(data: bytes):
    words, j, i, k, c = _unsqueeze(data, "u1", "u1", "u1", "u1", "<u4")
    words = _from_bytes(words)
    place = lambda x: np.ascontiguousarray(x.reshape(4, -1).T).reshape(-1).view("<u4")
    return words[place(i)], words[np.cumsum(place(j), dtype=np.uint32)], words[place(k)], c  # differences wrap around


def _distinct(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct keys, where each is first found, and the sum of its counts (how often it is there); with few arrays at a time."""
    order = np.argsort(keys)
    keys = keys[order]
    begins = np.nonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))[0]
    sums = np.diff(np.append(begins, len(keys))) if counts is None else np.add.reduceat(counts[order].astype(np.int64), begins)
    return keys[begins], order[begins], sums


def _places(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct keys, where each is found, and the place among them of every key."""
    order = np.argsort(keys)
    keys = keys[order]
    new = np.concatenate([[True], keys[1:] != keys[:-1]])
    place = np.empty(len(keys), np.int64)
    place[order] = np.cumsum(new) - 1
    return keys[new], order[new], place


def _count_triples(bits: int, hot: np.ndarray):
    """Texts -> packed trigram counts by shard, combined over up to three quarters of _FLUSH tokens."""

    def run(batches):
        held, size = [], 0

        def flush():
            w, n = (np.concatenate(x) for x in zip(*held))
            held.clear()
            v = previous(w, n)
            u = previous(v, n)
            _, first, c = _distinct(mix(mix(u, v), w))
            u = u[first]
            v = v[first]
            w = w[first]
            del n, first
            shard = _shard(_owner(v, mix(u, v), hot), bits)
            # by shard, then by the leading bits of v and of u: neighbours are alike, which is all that packing asks for
            near = v << np.uint64(bits) >> np.uint64(32) << np.uint64(26) | u >> np.uint64(38)
            order = np.argsort(shard.astype(np.uint64) << np.uint64(64 - bits) | near >> np.uint64(bits))
            del near
            u = u[order]
            v = v[order]
            w = w[order]
            c = c[order]
            shard = shard[order]
            cuts = np.searchsorted(shard, np.arange(2**bits + 1))
            shards = np.nonzero(np.diff(cuts))[0]
            packed = [_pack_triples(u[a:b], v[a:b], w[a:b], c[a:b]) for a, b in zip(cuts[shards], cuts[shards + 1])]
            return pa.RecordBatch.from_arrays([pa.array(shards.astype(np.int32)), pa.array(packed, pa.binary())], names=["shard", "payload"])

        for b in batches:
            for _, texts in text_runs(b.column(0)):
                held.append(token_hashes(texts))
                size += len(held[-1][0])
                if size >= 3 * _FLUSH // 4:
                    yield flush()
                    size = 0
        if held:
            yield flush()
        give_back_memory()

    return run


def _save_keys(folder: str, shard: int, name: str, keys: np.ndarray) -> None:
    """Sorted hashes in buckets of about 16 by their leading bits: where buckets begin, and the next 32 bits of each hash.  Another hash is taken for a known one once in 2**28."""
    bits = max(0, len(keys).bit_length() - 5)
    bucket = keys >> np.uint64(64 - bits) if bits else np.zeros(len(keys), np.uint64)
    _save(folder, shard, **{f"{name}_begin": np.searchsorted(bucket, np.arange((1 << bits) + 1, dtype=np.uint64)).astype(np.uint32), f"{name}_low": (keys >> np.uint64(32 - bits)).astype(np.uint32)})


def _find(model: Model, name: str, shard: int, keys: np.ndarray) -> np.ndarray:
    """The place of each hash among the shard's; -1 where it is not."""
    begin, low = _mapped(f"{model.folder}/{shard}.{name}_begin.npy"), _mapped(f"{model.folder}/{shard}.{name}_low.npy")
    if low is None or not len(low):
        return np.full(len(keys), -1)
    bits = (len(begin) - 1).bit_length() - 1
    bucket = (keys >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)
    wanted, lo, hi = (keys >> np.uint64(32 - bits)).astype(np.uint32), begin[bucket].astype(np.int64), begin[bucket + 1].astype(np.int64)
    end = hi.copy()
    while (lo < hi).any():
        mid = (lo + hi) >> 1
        less = (lo < hi) & (low[np.minimum(mid, len(low) - 1)] < wanted)
        lo, hi = np.where(less, mid + 1, lo), np.where(less | (lo >= hi), hi, mid)
    found = (lo < end) & (low[np.minimum(lo, len(low) - 1)] == wanted)
    return np.where(found, lo, -1)


def _save_counts(folder: str, shard: int, name: str, keys: np.ndarray, counts: np.ndarray) -> None:
    """Keys that count 1 apart from the others, whose counts are bytes, those from 255 on by place."""
    one = counts == 1
    _save_keys(folder, shard, f"{name}1", keys[one])
    _save_keys(folder, shard, name, keys[~one])
    _save(folder, shard, **{f"{name}_{k}": x for k, x in _bytes_with_rest(counts[~one]).items()})


def _by_shard(model: Model, owner: np.ndarray):
    shards = _shard(owner, model.bits)
    order = np.argsort(shards, kind="stable")
    cuts = np.concatenate([[0], np.nonzero(np.diff(shards[order]))[0] + 1, [len(order)]])
    return ((int(shards[order[a]]), order[a:b]) for a, b in zip(cuts[:-1], cuts[1:]) if b > a)


def _counts_of(model: Model, name: str, owner: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """What each key counts in the shard of its owner; 0 where it is not found."""
    out = np.zeros(len(keys), np.int64)
    for shard, own in _by_shard(model, owner):
        at = _find(model, name, shard, keys[own])
        hit = at >= 0
        if hit.any():
            v = _mapped(f"{model.folder}/{shard}.{name}_count.npy")[at[hit]].astype(np.int64)
            if (full := v == 255).any():
                v[full] = _mapped(f"{model.folder}/{shard}.{name}_large_count.npy")[np.searchsorted(_mapped(f"{model.folder}/{shard}.{name}_large.npy"), at[hit][full])]
            out[own[hit]] = v
        rest = own[~hit]
        out[rest[_find(model, f"{name}1", shard, keys[rest]) >= 0]] = 1
    return out


def _stats(counts: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Total, ones, twos and more of each run of counts; a shard has far fewer tokens than 32 bits count."""
    out = np.empty((len(begins), 4), np.int32)
    out[:, 0] = np.add.reduceat(counts, begins)
    for k in (1, 2):
        out[:, k] = np.add.reduceat(counts == k, begins, dtype=np.int32)
    out[:, 3] = np.diff(np.append(begins, len(counts))) - out[:, 1] - out[:, 2]
    return out


def _words_rows(words: np.ndarray, n: np.ndarray, bits: int):
    cuts = np.searchsorted(_shard(words, bits), np.arange(2**bits + 1))
    shards = np.nonzero(np.diff(cuts))[0]
    return shards.tolist(), [_squeeze(_bytes_of(words[a:b]), n[a:b].astype("<u4")) for a, b in zip(cuts[shards], cuts[shards + 1])]


_KINDS = "kind int, shard int, payload binary, figures array<bigint>"
_WORDS, _HOT_PAIRS, _FIGURES, _HOT_SEEN, _HOT_STATS = range(5)


def _table(rows: list[tuple]) -> pa.Table:
    kind, shard, payload, figures = zip(*rows)
    return pa.table({"kind": pa.array(kind, pa.int32()), "shard": pa.array(shard, pa.int32()), "payload": pa.array(payload, pa.binary()), "figures": pa.array(figures, pa.list_(pa.int64()))})


def _pairs_made(folder: str, shard: int, bits: int, name: str, v: np.ndarray, w: np.ndarray, n: np.ndarray):
    """Saves the counts of distinct pairs v w; returns figures of the words v, by hash, the words w and in how many pairs each is."""
    pair = mix(v, w)
    order = np.argsort(pair)
    _save_counts(folder, shard, name, pair[order], n[order])
    order = np.argsort(v, kind="stable")
    words, begins = np.unique(v[order], return_index=True)
    return words, (_stats(n[order], begins) if len(words) else np.zeros((0, 4), np.int32)), *np.unique(w, return_counts=True)


def _joined(parts) -> list[np.ndarray]:
    """Tuples of arrays put together, one array after the other."""
    lists = [list(x) for x in zip(*parts)]
    out = []
    while lists:
        out.append(np.concatenate(lists.pop(0)))
    return out


def _reduce_triples(folder: str, bits: int, hot: np.ndarray):
    """All of a shard's trigrams -> its arrays on disk, figures, continuation counts of words, and what is still to be added up for hot words."""

    def run(rows: pa.Table) -> pa.Table:
        shard = rows.column("shard")[0].as_py()
        u, v, w, c = _joined(_unpack_triples(p.as_py()) for p in rows.column("payload"))
        tri, first, c = _distinct(mix(mix(u, v), w), c)
        u = u[first]
        v = v[first]
        w = w[first]
        del first
        _save_counts(folder, shard, "tri", tri, c)
        uv = mix(u, v)
        order = np.argsort(uv)
        uv = uv[order]
        begins = np.nonzero(np.concatenate([[True], uv[1:] != uv[:-1]]))[0]
        contexts = uv[begins]
        stats = _stats(c[order], begins)
        alone = stats[:, 0] == 1
        _save_keys(folder, shard, "context1", contexts[alone])
        _save_keys(folder, shard, "contexts", contexts[~alone])
        kinds, code = np.unique(stats[~alone], axis=0, return_inverse=True)
        _save(folder, shard, kinds=kinds, code=code.reshape(-1).astype(np.uint32 if len(kinds) > 65535 else np.uint16))
        del uv, order, contexts, begins, stats, tri
        _, first, adjusted = _distinct(mix(v, w), np.where(v == BEGIN, c, 1))  # the start has no word before it
        v2, w2 = v[first], w[first]
        words, back = np.unique(v, return_inverse=True)
        seen, spread = np.bincount(back, c, len(words)).astype(np.int64), np.isin(words, hot)
        there = np.isin(v2, hot)
        held, stats, ends, n = _pairs_made(folder, shard, bits, "pair", v2[~there], w2[~there], adjusted[~there])
        _save(folder, shard, context=held, seen=seen[~spread], total=stats[:, 0], ones=stats[:, 1], twos=stats[:, 2], more=stats[:, 3])
        out = [(_FIGURES, -1, b"", [int(c.sum()), int((held != BEGIN).sum()), int(c[w == END].sum()), *_levels(c), *_levels(adjusted[~there])])]
        out += [(_HOT_SEEN, -1, b"", [int(x), int(k)]) for x, k in zip(words[spread].view(np.int64), seen[spread])]
        out += [(_WORDS, k, p, None) for k, p in zip(*_words_rows(ends, n, bits))]
        if there.any():
            v2, w2, adjusted = v2[there], w2[there], adjusted[there]
            owner = _shard(mix(v2, w2), bits)
            order = np.lexsort((v2, owner))
            cuts = np.searchsorted(owner[order], np.arange(2**bits + 1))
            for k in np.nonzero(np.diff(cuts))[0].tolist():
                own = order[cuts[k] : cuts[k + 1]]
                out.append((_HOT_PAIRS, k, _pack_pairs(v2[own], w2[own], adjusted[own]), None))
        give_back_memory()
        return _table(out)

    return run


def _reduce_hot(folder: str, bits: int):
    """The pairs of hot words in a shard, added up -> arrays on disk, figures, continuation counts of words."""

    def run(rows: pa.Table) -> pa.Table:
        shard = rows.column("shard")[0].as_py()
        v, w, c = (np.concatenate(x) for x in zip(*(_unpack_pairs(p.as_py()) for p in rows.column("payload"))))
        _, first, at = np.unique(mix(v, w), return_index=True, return_inverse=True)
        n = np.bincount(at, c).astype(np.int64)
        words, stats, ends, times = _pairs_made(folder, shard, bits, "hot", v[first], w[first], n)
        out = [(_FIGURES, -1, b"", [0, 0, 0, 0, 0, 0, 0, *_levels(n)])]
        out += [(_HOT_STATS, -1, b"", [int(x), *f]) for x, f in zip(words.view(np.int64), stats.tolist())]
        return _table(out + [(_WORDS, k, p, None) for k, p in zip(*_words_rows(ends, times, bits))])

    return run


def train(texts: DataFrame, text: str = "text", shard_mb: int = 16, order: int = 3) -> Model:
    """A model of trigrams (order 3) or bigrams (order 2), counted over all texts; see _train3 and _train2.

    With trigrams what is shuffled grows faster than the input, as each run sends the words it speaks of to every shard.

    Null and empty texts count as an end alone; texts of any length are counted whole; repeated rows count each; without texts every word has the same chance.
    """
    if order not in (2, 3):
        raise ValueError("order must be 2 or 3")
    return (_train2 if order == 2 else _train3)(texts, text, shard_mb)


def _train3(texts: DataFrame, text: str, shard_mb: int) -> Model:
    """The trigram model: as _train2, with a shuffle more, of the pairs of hot words only.  Counts of pairs are of different words before them (at the start of a text, of occurrences)."""
    spark = texts.sparkSession
    texts = texts.select(F.col(text).alias("text"))
    size, bits = _sized(texts, shard_mb)
    folder = local_mount(shared_path(spark, "trigrams"))
    os.makedirs(folder, exist_ok=True)
    hot = hot_contexts(texts, size, bits)
    grouped = lambda df: df.select("shard", "payload").repartition(2**bits, "shard").groupBy("shard")
    first = written(grouped(texts.mapInArrow(_count_triples(bits, hot), _ROWS)).applyInArrow(_reduce_triples(folder, bits, hot), _KINDS), "trigram_words")
    second = written(grouped(first.where(F.col("kind") == _HOT_PAIRS)).applyInArrow(_reduce_hot(folder, bits), _KINDS), "trigram_hot")
    both = first.where(F.col("kind") != _HOT_PAIRS).unionByName(second)
    third = grouped(both.where(F.col("kind") == _WORDS)).applyInArrow(_reduce_words(folder), "figures array<bigint>")
    a = _summed(both.where(F.col("kind") == _FIGURES), 11) or [0] * 11
    b = _summed(third, 6) or [0] * 6
    word = F.col("figures")[0].alias("word")
    seen = {r.word: r.n for r in both.where(F.col("kind") == _HOT_SEEN).groupBy(word).agg(F.sum(F.col("figures")[1]).alias("n")).collect()}
    stats = {r.word: [r.f1, r.f2, r.f3, r.f4] for r in both.where(F.col("kind") == _HOT_STATS).groupBy(word).agg(*[F.sum(F.col("figures")[i]).alias(f"f{i}") for i in range(1, 5)]).collect()}
    found = sorted((np.int64(x).view(np.uint64), x) for x in stats)
    singles = discounts(*b[1:5])
    left = (singles[0] * b[1] + singles[1] * b[2] + singles[2] * b[5]) / b[0] if b[0] else 1.0
    words = a[1] + sum(w != BEGIN for w, _ in found) + (a[2] > 0)
    figures = np.array([[seen[x], *stats[x]] for _, x in found], np.int64).reshape(-1, 5)
    return Model(folder, bits, a[0], words, a[2], discounts(*a[7:11]), singles, b[0], left, np.array([w for w, _ in found], np.uint64), figures, discounts(*a[3:7]))


def score_texts3(model: Model, texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """As score_texts, by trigrams."""
    w, n = token_hashes(texts)
    v = previous(w, n)
    u = previous(v, n)
    words, _, at = _places(w)
    figures = ("seen", "total", "ones", "twos", "more")
    (seen,) = _contexts(model, words, ("seen",), figures)
    seen[words == END] = model.ends
    (distinct,) = _look_up(model, "word", words, words, ("before",))
    p1 = np.broadcast_to(model.rest if not model.before else _less(distinct, model.singles) / model.before + model.left * model.rest, len(words))
    # pairs
    middle, _, back = _places(v)
    stats = np.stack(_contexts(model, middle, figures[1:], figures), axis=1)
    pair, first, of = _places(mix(v, w))
    hot = np.isin(v[first], model.hot)
    count = np.zeros(len(pair), np.int64)
    count[~hot] = _counts_of(model, "pair", v[first][~hot], pair[~hot])
    count[hot] = _counts_of(model, "hot", pair[hot], pair[hot])
    p2 = _interpolated(count, stats[back[first]], model.pairs, p1[at[first]])
    # trigrams
    uv = mix(u, v)
    context, begin, back = _places(uv)
    stats = _pair_stats(model, _owner(v[begin], context, model.hot), context)
    tri, first, which = _places(mix(uv, w))
    count = _counts_of(model, "tri", _owner(v[first], uv[first], model.hot), tri)
    p3 = _interpolated(count, stats[back[first]], model.triples, p2[of[first]])
    base = np.log10((seen + 1) / (model.tokens + model.words + 1))
    starts = np.cumsum(n) - n
    return n, np.add.reduceat((seen > 0)[at].astype(np.int64), starts), np.add.reduceat(base[at], starts), np.add.reduceat(np.log10(p3)[which], starts)


def _interpolated(count: np.ndarray, stats: np.ndarray, d: tuple[float, float, float], lower: np.ndarray) -> np.ndarray:
    """Discounted counts of a context, and what the discounts leave by the lower order; a context never seen leaves all."""
    total = np.maximum(stats[:, 0], 1)
    spare = np.where(stats[:, 0] > 0, (stats[:, 1:] @ np.array(d)) / total, 1.0)
    return np.where(stats[:, 0] > 0, _less(count, d) / total, 0.0) + spare * lower


def _pair_stats(model: Model, owner: np.ndarray, contexts: np.ndarray) -> np.ndarray:
    """Total, ones, twos, more of contexts of two words."""
    out = np.zeros((len(contexts), 4), np.int64)
    for shard, own in _by_shard(model, owner):
        at = _find(model, "contexts", shard, contexts[own])
        hit = at >= 0
        if hit.any():
            out[own[hit]] = _mapped(f"{model.folder}/{shard}.kinds.npy")[_mapped(f"{model.folder}/{shard}.code.npy")[at[hit]]]
        rest = own[~hit]
        out[rest[_find(model, "context1", shard, contexts[rest]) >= 0]] = (1, 1, 0, 0)
    return out


def held_out(doc_id: str = "doc_id"):
    """Whether CRC-32 of the id as text leaves 2 by 7; a null id counts as the empty text, so it is trained on."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 7 == 2


def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document; nulls, long and empty texts, repeated rows and empty tables as in train and score."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs.where(~held_out()).select("text"), order=2)
    out = score(docs.withColumn("held_out", held_out()), model)
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")
