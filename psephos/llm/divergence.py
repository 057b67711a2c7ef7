"""Source divergence audit: how far the sources of a language are from each other in their words, and which words make a source stand out."""

from __future__ import annotations

import heapq
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from psephos.llm.common import FEW, few_or_join, give_back_memory, spread_join, table, written

#: A term is a run of ASCII letters and of characters from U+0080 on, in UTF-8: of bytes that are letters or have the high bit.  A-Z become a-z, all else a space.
TERMS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Bytes of a text that are split at a time, and counts held before they are passed on.
STEP, HELD = 1 << 20, 200_000
#: Probabilities are whole numbers of this many parts.
PARTS = 1_000_000_000
#: Cells (a pair of groups and a term) that are computed at a time.
CELLS = 1 << 18


def terms(text: bytes):
    """Lists of the terms of a text, in turn; only a stretch of it is split at a time."""
    t, at = text.translate(TERMS), 0
    while at < len(t):
        end = t.find(b" ", at + STEP)
        end = len(t) if end < 0 else end
        yield t[at:end].split()
        at = end


def _counted(batches):
    """Batches (lang, source, text) -> (lang, source, term, n, docs), summed over a run of texts."""
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def flush():
        for (lang, source), (n, docs) in held.items():
            k = len(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * k, pa.string()), pa.array([source] * k, pa.string()), pa.array(n, pa.binary()), pa.array(n.values(), pa.int64()), pa.array([docs[t] for t in n], pa.int64())], names=["lang", "source", "term", "n", "docs"])
        held.clear()

    size = 0
    for batch in batches:
        for lang, source, text in zip(*(batch.column(c) for c in ("lang", "source", "text"))):
            n, docs = held.setdefault((lang.as_py(), source.as_py()), (Counter(), Counter()))
            before, seen = len(n), set()
            for some in terms(text.as_py()):
                n.update(some)
                seen.update(some)
            docs.update(seen)
            size += len(n) - before
            if size > HELD:
                yield from flush()
                size = 0
    yield from flush()
    give_back_memory()


def shares(count: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """1 + floor(PARTS * (count + 2) / whole), by long division in thousands: exact for wholes below 9e15; count + 2 is at most the whole."""
    a = count + 2
    out, rest = a // whole, a % whole
    for _ in range(3):
        rest = rest * 1000
        out, rest = out * 1000 + rest // whole, rest % whole
    return out + 1


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def pair_matrix(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Sums of divergence over the terms of all pairs of rows of two dense matrices, broadcast a block of rows at a time."""
    out = np.empty((len(p), len(q)), np.int64)
    step = max(1, CELLS // max(1, q.size))
    for i in range(0, len(p), step):
        out[i : i + step] = divergence(p[i : i + step, None], q[None]).sum(axis=2)
    return out


class _Sums:
    """Pair matrices of the tiles of two blocks of groups, added up, and the heaps of their groups."""

    def __init__(self, of: tuple[str, int, int], rows: list[str], columns: list[str], top: int):
        self.of, self.lang, self.rows, self.columns, self.same, self.top = of, of[0], rows, columns, of[1] == of[2], top
        self.matrix = np.zeros((len(rows), len(columns)), np.int64)
        self.heaps: list[list] = [[] for _ in rows] if self.same else []

    def add(self, p: np.ndarray, q: np.ndarray, p0: np.ndarray, q0: np.ndarray, absent: int) -> None:
        """Dense tiles of the terms that occur, and the shares of a term that does not, which counts `absent` times."""
        self.matrix += pair_matrix(p, q) + absent * divergence(p0[:, None], q0[None])

    def offer(self, row: int, value: np.ndarray, names: list[str]) -> None:
        """The best of a tile's terms of a group join its heap: larger values first, then smaller terms."""
        heap = self.heaps[row]
        heap[:] = heapq.nsmallest(self.top, heap + list(zip((-value).tolist(), (n.encode() for n in names))))

    def out(self):
        a, b = np.nonzero(np.triu(np.ones(self.matrix.shape, bool), 1) if self.same else np.ones(self.matrix.shape, bool))
        found = [(self.rows[i], self.columns[j], v) for i, j, v in zip(a.tolist(), b.tolist(), self.matrix[a, b].tolist())]
        yield _record("pair", self.lang, found)
        yield _record("term", self.lang, [(self.rows[i], t.decode(), -v) for i, h in enumerate(self.heaps) for v, t in h])


def _record(part: str, lang: str, found: list[tuple[str, str, int]]) -> pa.RecordBatch:
    source, item, value = zip(*found) if found else ((), (), ())
    k = len(found)
    return pa.RecordBatch.from_arrays([pa.array([part] * k, pa.string()), pa.array([lang] * k, pa.string()), pa.array(source, pa.string()), pa.array(item, pa.string()), pa.array(value, pa.int64())], names=["part", "lang", "source", "item", "value"])


def _tiles(top: int):
    """Rows sorted by lang, lo, hi, tb -> pair sums and each group's best terms.  A tile is all rows of one lang, lo, hi and tb: a row without a term for each group of both blocks, and counts."""

    def whole(batches):
        """Tables of one tile each."""
        held = None
        for batch in batches:
            t = pa.Table.from_batches([batch] if held is None else [held, batch]).combine_chunks()
            if not t.num_rows:
                continue
            keys = [t.column("lang").combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False), *(t.column(c).to_numpy() for c in ("lo", "hi", "tb"))]
            cuts = np.nonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0))[0] + 1
            for f, e in zip([0, *cuts[:-1].tolist()], cuts.tolist()):
                yield t.slice(f, e - f)
            rest = t.slice(int(cuts[-1]) if len(cuts) else 0).combine_chunks()
            held = rest.to_batches()[0]
        if held is not None:
            yield pa.Table.from_batches([held])

    def run(batches):
        sums = None
        for t in whole(batches):
            c = {n: t.column(n).combine_chunks() for n in t.column_names}
            lang, lo, hi = c["lang"][0].as_py(), c["lo"][0].as_py(), c["hi"][0].as_py()
            head = c["term"].is_null().to_numpy(zero_copy_only=False)
            source = np.array(c["source"].to_pylist(), object)
            n, m, block = (c[x].to_numpy(zero_copy_only=False) for x in ("n", "m", "gb"))
            # groups by source: those of lo are rows, those of hi columns
            order = np.argsort(source[head], kind="stable")
            groups, of, at = source[head][order], m[head][order], block[head][order]
            place = {s: i for i, s in enumerate(groups.tolist())}
            rows, columns = np.nonzero(at == lo)[0], np.nonzero(at == hi)[0]
            if sums is None or sums.of != (lang, lo, hi):
                if sums is not None:
                    yield from sums.out()
                sums = _Sums((lang, lo, hi), groups[rows].tolist(), groups[columns].tolist(), top)
            coded = c["term"].filter(pa.array(~head)).dictionary_encode()
            names, term = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            own = np.array([place[s] for s in source[~head].tolist()], np.int64)
            count = np.zeros((len(groups), len(names)), np.int64)
            count[own, term] = n[~head]
            p, p0 = shares(count, of[:, None]), shares(np.zeros(len(groups), np.int64), of)
            sums.add(p[rows], p[columns], p0[rows], p0[columns], int(c["kept"][0].as_py()) - len(names))
            if lo == hi and names:
                in_lang = np.zeros(len(names), np.int64)
                in_lang[term] = c["in_lang"].to_numpy(zero_copy_only=False)[~head]
                q = shares(in_lang, np.int64(c["lm"][0].as_py()))
                for k, i in enumerate(rows.tolist()):
                    ok = np.nonzero((count[i] > 0) & (p[i] > q))[0]
                    if len(ok):
                        sums.offer(k, divergence(p[i, ok], q[ok]), [names[x] for x in ok])
        if sums is not None:
            yield from sums.out()
        give_back_memory()

    return run


def audit(docs: DataFrame, least: int = 10, top: int = 10, group_block: int = 256, term_block: int = 256, lang: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """lang, source, part, item, value, rank: for each pair of a language and a source its divergence from every other source of the language (part `pair`), and its `top` terms that are
    more frequent in it than in the language (part `term`).

    Terms in at least `least` documents of a language are kept.  Tasks count the terms of their texts; counts are summed by group and term, so no key's shuffle grows faster than the number of
    tasks.  Kept counts are dealt out as tiles, of `term_block` terms and two blocks of `group_block` groups on average, by hash: in a tile they are dense matrices of whole numbers, all pairs of
    groups are computed by broadcasting, and a task adds up the matrices of its tiles and merges the heaps of its groups.  Any number of groups and terms is compared whole.

    A null text, lang or source counts as ''; a text without terms, or with none kept, still names its group, whose pairs have the value 0 where nothing is kept in the language; a language with
    one source has no pairs.  Equal values are ranked by the item's UTF-8 bytes.  Texts are read whole, a stretch at a time; repeated rows count each; other columns are ignored; an empty table
    gives no rows.
    """
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    read = docs.select(empty(lang).alias("lang"), empty(source).alias("source"), empty(text).cast("binary").alias("text"))
    found = read.mapInArrow(_counted, "lang string, source string, term binary, n long, docs long")
    summed = found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    of_term = Window.partitionBy("lang", "term")
    kept = summed.select("lang", "source", "term", "n", F.sum("docs").over(of_term).alias("docs"), F.sum("n").over(of_term).alias("in_lang"), F.row_number().over(of_term.orderBy("source")).alias("k"))
    counts = written(kept.where(F.col("docs") >= least).select("lang", "source", F.col("term").cast("string").alias("term"), "n", "in_lang", (F.col("k") == 1).cast("long").alias("first")), "divergence")
    # a group is what a text names, with terms or without
    groups = read.select("lang", "source").distinct()
    own = counts.groupBy("lang", "source").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("terms"))
    groups = written(groups.join(own, ["lang", "source"], "left").na.fill(0, ["n", "terms"]), "divergence_groups")
    langs = groups.groupBy("lang").agg(F.sum("n").alias("lang_n"), F.count(F.lit(1)).alias("groups"))
    langs = langs.join(counts.groupBy("lang").agg(F.sum("first").alias("v")), "lang", "left").na.fill(0, ["v"])
    langs = written(langs, "divergence_langs")
    blocks = lambda n, size: F.greatest(F.lit(1), F.ceil(F.col(n) / size)).cast("int")
    n_langs, n_groups = langs.count(), groups.count()
    known = groups.join(few_or_join(langs, n_langs), "lang").select(
        "lang", "source", "terms", F.greatest(F.lit(1), F.col("n") + 2 * F.col("v")).alias("m"), F.greatest(F.lit(1), F.col("lang_n") + 2 * F.col("v")).alias("lm"),
        blocks("groups", group_block).alias("gbs"), blocks("v", term_block).alias("tbs"),
    ).withColumn("gb", F.pmod(F.xxhash64("source"), "gbs").cast("int"))
    rows = counts.join(F.broadcast(known.drop("terms")), ["lang", "source"]) if n_groups <= FEW else spread_join(counts, written(known, "divergence_known"), ["lang", "source"], "terms", 65_536)
    tile = F.pmod(F.xxhash64("term"), "tbs").cast("int")
    in_tile = counts.join(few_or_join(langs.select("lang", blocks("v", term_block).alias("tbs")), n_langs), "lang").groupBy("lang", tile.alias("tb")).agg(F.sum("first").alias("kept"))
    heads = known.withColumn("tb", F.explode(F.sequence(F.lit(0), F.col("tbs") - 1))).join(few_or_join(in_tile, in_tile.count()), ["lang", "tb"], "left").na.fill(0, ["kept"])
    columns = ["lang", "source", "gb", "gbs", "tb", "term", "n", "in_lang", "m", "lm", "kept"]
    none = lambda kind: F.lit(None).cast(kind)
    heads = heads.select("lang", "source", "gb", "gbs", "tb", none("string").alias("term"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("in_lang"), "m", "lm", "kept")
    rows = rows.withColumn("tb", tile).withColumn("kept", F.lit(0).cast("long")).select(*columns)
    partner = F.explode(F.sequence(F.lit(0), F.col("gbs") - 1)).alias("other")
    dealt = heads.unionByName(rows).select("*", partner).select("lang", "source", "gb", "tb", "term", "n", "in_lang", "m", "lm", "kept", F.least("gb", "other").alias("lo"), F.greatest("gb", "other").alias("hi"))
    # rows without a term come first, so the first row of a tile knows how many terms it has
    tiles = dealt.repartition("lang", "lo", "hi", "tb").sortWithinPartitions("lang", "lo", "hi", "tb", F.col("term").asc_nulls_first())
    parts = written(tiles.mapInArrow(_tiles(top), "part string, lang string, source string, item string, value long"), "divergence_parts")
    one = parts.where("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    both = one.unionByName(one.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value"))
    ranked = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = both.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(ranked).alias("rank"))
    best = parts.where("part = 'term'").select("lang", "source", "part", "item", "value", F.row_number().over(ranked).alias("rank")).where(F.col("rank") <= top)
    return pairs.unionByName(best)


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lang, source, part, item, value, rank over all `documents`; nulls, long and empty texts, ties, repeated rows and empty tables as in audit."""
    return audit(table(spark, sf_dir, "documents").select("lang", "source", "text"))


OP12_SQL = r"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
w AS (SELECT id, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS raw FROM d),
t AS MATERIALIZED (SELECT lang, source, id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term, COUNT(*) AS n FROM w GROUP BY ALL),
k AS MATERIALIZED (SELECT lang, term, SUM(n) AS n FROM t GROUP BY ALL HAVING COUNT(DISTINCT id) >= 10),
v AS (SELECT lang, COUNT(*) AS v, SUM(n) AS n FROM k GROUP BY ALL),
g AS MATERIALIZED (SELECT DISTINCT lang, source FROM d),
c AS MATERIALIZED (SELECT lang, source, term, SUM(n) AS n FROM t SEMI JOIN k USING (lang, term) GROUP BY ALL),
s AS (SELECT lang, source, SUM(n) AS n FROM c GROUP BY ALL),
p AS MATERIALIZED (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS c,
  CAST(1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 2)::HUGEINT) // (coalesce(s.n, 0) + 2 * v.v)::HUGEINT AS BIGINT) AS p,
  CAST(1 + (1000000000::HUGEINT * (k.n + 2)::HUGEINT) // (v.n + 2 * v.v)::HUGEINT AS BIGINT) AS q
  FROM g JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN s USING (lang, source) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
f AS (SELECT a.lang, a.source, b.source AS item, SUM(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
o AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(f.value, 0) AS BIGINT) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
  UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q)) // (p + q) FROM p WHERE c > 0 AND p > q)
SELECT lang, source, part, item, value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM o QUALIFY part = 'pair' OR rank <= 10
"""
