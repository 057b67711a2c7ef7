"""Recognising the same contest across styles by its texts."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from psephos.operators.ranking import global_rank, running_sum, sent_if_few

#: The factor of distances by language (English, Spanish, French, German, others).
LANGUAGE_CODES = {"english": "eng", "spanish": "spa", "french": "fra", "german": "deu", "chinese": "chi_sim", "vietnamese": "vie", "korean": "kor"}


def rotations(a: Column) -> Column:
    """All rotations of an array: a[i:] + a[:i]."""
    return F.transform(F.sequence(F.lit(0), F.size(a) - 1), lambda i: F.concat(F.slice(a, i + 1, F.size(a)), F.slice(a, F.lit(1), i)))


def rotation_distance(title1: Column, title2: Column, a: Column, b: Column) -> Column:
    """Edit distance of the titles and of the choices under the best rotation of b, divided by the size of all texts; for as many choices on either side."""
    def total(r):
        return F.aggregate(F.zip_with(a, r, lambda x, y: F.levenshtein(x, y)), F.lit(0), lambda s, x: s + x)

    def size(x):
        return F.aggregate(x, F.lit(0), lambda s, t: s + F.length(t))

    best = F.array_min(F.transform(rotations(b), total))
    return (F.levenshtein(title1, title2) + best) / F.greatest(F.lit(1), F.length(title1) + F.length(title2) + size(a) + size(b))


def rotate(a: Column, by: Column, fixed: int = 0) -> Column:
    """a from place `by` on, then its start; the last `fixed` (write-ins) stay at the end."""
    n = F.size(a) - fixed
    body = F.slice(a, F.lit(1), n)
    return F.concat(F.slice(body, by + 1, n), F.slice(body, F.lit(1), by), F.slice(a, n + 1, F.lit(fixed)) if fixed else F.array().cast("array<string>"))


def pairs_in_blocks(texts: DataFrame, block: list[str], most: float) -> DataFrame:
    """Distances of the pairs within a block that can be at most `most`: lengths alone must not rule it out.  texts: id, title, choices."""
    a, b = texts.alias("a"), texts.alias("b")
    cond = F.col("a.id") < F.col("b.id")
    for k in block:
        cond = cond & (F.col(f"a.{k}") == F.col(f"b.{k}"))
    la, lb = F.length("a.title"), F.length("b.title")
    cond = cond & (F.abs(la - lb) <= most * (la + lb + F.col("a.size") + F.col("b.size")))
    d = rotation_distance(F.col("a.title"), F.col("b.title"), F.col("a.choices"), F.col("b.choices"))
    return a.join(b, cond).select(F.col("a.id").alias("a_id"), F.col("b.id").alias("b_id"), d.alias("distance")).where(F.col("distance") <= most)


def _grams(texts: Column, q: int) -> Column:
    """All runs of q characters of an array of texts."""
    own = F.transform(texts, lambda t: F.when(F.length(t) >= q, F.transform(F.sequence(F.lit(1), F.length(t) - (q - 1)), lambda i: t.substr(i, F.lit(q)))).otherwise(F.array().cast("array<string>")))
    return F.flatten(own)


def text_classes(texts: DataFrame, block: list[str]) -> tuple[DataFrame, DataFrame]:
    """(one row for each distinct text of a block, with the least id of those that share it; every id and that least id as `rep`).  Choices that are rotations of each other are the same text."""
    first = F.array_min(rotations(F.col("choices")))
    keyed = texts.withColumn("_first", F.when(F.size("choices") > 0, first).otherwise(F.col("choices")))
    reps = keyed.groupBy(*block, "title", "_first").agg(F.min("id").alias("rep"))
    same = F.lit(True)
    for c in (*block, "title", "_first"):
        same = same & F.col(f"k.{c}").eqNullSafe(F.col(f"r.{c}"))
    members = keyed.alias("k").join(reps.alias("r"), same).select(F.col("k.id").alias("id"), F.col("r.rep").alias("rep"))
    return texts.join(reps.select(F.col("rep").alias("id")), "id", "left_semi"), members


#: Texts of a piece of a block; two pieces are compared at a time.
PIECE = 2048


def _all_near(rows: DataFrame, block: list[str], most: float) -> DataFrame:
    """a_id, b_id, distance of the pairs of a block (rows: id, block, title, choices, size, long) that are at most `most` apart: each block is cut in pieces of some 2048 texts, and a task has two
    of them at a time, so only texts are moved (each as often as its block has pieces) and no pairs are.  Within, equal titles and equal choices are compared once (_near_of_two)."""
    known = F.col("title").isNotNull() & ~F.exists("choices", lambda c: c.isNull())
    for c in block:
        known = known & F.col(c).isNotNull()
    rows = rows.where(known).withColumn("_n", F.size("choices"))
    own = [*block, "_n"]
    sizes = sent_if_few(rows.groupBy(*own).agg(F.ceil(F.count(F.lit(1)) / PIECE).cast("int").alias("_pieces")), "pieces")
    meetings = sizes.agg(F.sum(F.col("_pieces").cast("long") * (F.col("_pieces") + 1) / 2)).first()[0] or 0
    n = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), int(min(10_000, meetings)))
    piece = F.pmod(F.xxhash64("id"), "_pieces").cast("int")
    dealt = rows.join(sizes, own).withColumn("_piece", piece).withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_pieces") - 1)))
    dealt = dealt.select("id", *own, "title", "choices", "long", "_piece", F.least("_piece", "_other").alias("_low"), F.greatest("_piece", "_other").alias("_high")).repartition(n, *own, "_low", "_high")
    kind = dict(rows.dtypes)["id"]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        low, high = int(pdf["_low"].iloc[0]), int(pdf["_high"].iloc[0])
        a, b = (pdf[pdf["_piece"] == k] for k in (low, high))
        i, j, d = _near_of_two(a, b, most, low == high)
        x, y = a["id"].to_numpy()[i], b["id"].to_numpy()[j]
        return pd.DataFrame({"a_id": np.minimum(x, y), "b_id": np.maximum(x, y), "distance": d})

    return dealt.groupBy(*own, "_low", "_high").applyInPandas(run, f"a_id {kind}, b_id {kind}, distance double")


#: Pairs that are looked at together within a task (some 30 bytes for each).
TOGETHER = 1 << 19


def _near_of_two(a: pd.DataFrame, b: pd.DataFrame, most: float, same: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of a, rows of b and distance (as rotation_distance has it) of the pairs that are at most `most` apart; of one piece with itself (same), each pair once.  Lengths and titles rule pairs
    out first; the distances of titles, and of choices under the best rotation, are worked out once for equal ones."""
    (ta, titles_a), (tb, titles_b), (ca, choices_a), (cb, choices_b) = (pd.factorize(x[c].map(tuple) if c == "choices" else x[c]) for c in ("title", "choices") for x in (a, b))
    la, lb = (x["long"].to_numpy(np.int64) for x in (a, b))
    titles, choices = _Distances(titles_a, titles_b, _edits), _Distances(choices_a, choices_b, _turned_edits)
    out: list = []
    for f in range(0, len(a), max(1, TOGETHER // max(1, len(b)))):
        rows = slice(f, f + max(1, TOGETHER // max(1, len(b))))
        long_ = la[rows, None] + lb
        may = np.abs(la[rows, None] - lb) <= most * long_
        if same:
            may &= np.arange(f, f + len(long_))[:, None] < np.arange(len(b))
        i, j = np.nonzero(may)
        n = long_[i, j]
        i += f
        t = titles.of(ta[i], tb[j])
        own = np.flatnonzero(t <= most * n + 1e-9)
        i, j, n, t = i[own], j[own], n[own], t[own]
        d = (t + choices.of(ca[i], cb[j])) / np.maximum(1, n)
        own = np.flatnonzero(d <= most)
        out.append((i[own], j[own], d[own]))
    return tuple(np.concatenate(c) for c in zip(*out)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))


class _Distances:
    """Distances between the distinct values of two pieces, by their numbers: each is worked out when it is first asked for."""

    def __init__(self, a, b, between):
        self.a, self.b, self.between, self.known = list(a), list(b), between, np.full((len(a), len(b)), -1, np.int32)

    def of(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        d = self.known[i, j]
        if len(new := np.flatnonzero(d < 0)):
            new = np.unique(i[new].astype(np.int64) * len(self.b) + j[new])
            self.known.ravel()[new] = self.between([self.a[k] for k in new // len(self.b)], [self.b[k] for k in new % len(self.b)])
            d = self.known[i, j]
        return d


def _turned_edits(x: list[tuple], y: list[tuple]) -> np.ndarray:
    """The sum of edits of choices (as many on either side) under the best rotation."""
    n, out = len(x[0]), np.zeros(len(x), np.int32)
    if not n:
        return out
    number: dict[str, int] = {}
    at, some = (np.array([[number.setdefault(t, len(number)) for t in c] for c in side]) for side in (x, y)), max(1, TOGETHER // (n * n))
    at_x, at_y = at
    texts = list(number)
    for f in range(0, len(x), some):
        pairs = at_x[f : f + some, :, None].astype(np.int64) * len(texts) + at_y[f : f + some, None]
        once, back = np.unique(pairs, return_inverse=True)
        d = _edits([texts[k] for k in once // len(texts)], [texts[k] for k in once % len(texts)])[back.reshape(pairs.shape)]
        places = np.arange(n)
        out[f : f + some] = np.min([d[:, places, (places + r) % n].sum(axis=1) for r in range(n)], axis=0)
    return out


def _edits(x: list[str], y: list[str]) -> np.ndarray:
    """Edit distances of pairs of texts, a row of the table for many pairs at a time; pairs of like lengths go together."""
    out, sizes = np.zeros(len(x), np.int32), np.array([(len(s), len(t)) for s, t in zip(x, y)]).reshape(-1, 2)
    order, f = np.lexsort((sizes[:, 1], sizes[:, 0])), 0
    while f < len(order):
        # as many pairs as TOGETHER allows for, by the sizes of the next ones
        own = order[f : f + max(1, (TOGETHER >> 1) // (1 + int(sizes[order[f : f + 2048]].max())))][:2048]
        f += len(own)
        m, n = sizes[own].max(axis=0)
        a, b = (_letters([side[k] for k in own], size) for side, size in ((x, m), (y, n)))
        kind = np.int16 if m + n < 1 << 14 else np.int32
        place = np.arange(n + 1, dtype=kind)[:, None]
        # a row is kept less its places, so that along it the least so far is the best
        row, new, unlike = (np.zeros((n + 1, len(own)), kind) for _ in range(3))
        done = sizes[own, 0] == 0
        out[own[done]] = sizes[own[done], 1]
        for k in range(m):
            np.add(row, 1, out=new)
            np.not_equal(b, a[k], out=unlike[1:], casting="unsafe")
            unlike[1:] += row[:-1]
            unlike[1:] -= 1
            np.minimum(new[1:], unlike[1:], out=new[1:])
            if len(own) < 256:
                np.minimum.accumulate(new, axis=0, out=new)
            else:
                for before, after in zip(new, new[1:]):
                    np.minimum(before, after, out=after)
            row, new = new, row
            done = np.flatnonzero(sizes[own, 0] == k + 1)
            if len(done):
                out[own[done]] = (row + place)[sizes[own[done], 1], done]
    return out


def _letters(texts: list[str], size: int) -> np.ndarray:
    """Code points, a column for each text, filled up below."""
    return np.array(texts, f"U{max(1, size)}").view(np.uint32).reshape(len(texts), -1).T[:size].copy()


def similar_pairs(texts: DataFrame, block: list[str], most: float, q: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(a_id, b_id, distance of the pairs of distinct texts of a block that are at most `most` apart; id and rep of all texts): a join by an index of rare runs of characters.

    The distance of rotation_distance counts edits over all characters of both texts.  An edit changes at most q of a text's runs of q characters (counted over title and choices, so a rotation
    changes none), and texts so near cannot differ much in length; so a text shares with each near one all but a bounded number of its runs, and at least one among as many of its rarest
    ones.  Only these are joined, by block, run and how often it came before in the text; pairs that share too few runs in all are dropped before distances are computed.  Texts that may
    share none (short ones, or all where `most` is a third or more) are compared with the block by length, as in pairs_in_blocks.  So no pair is lost.  q is from 4 to 1, the smaller the larger
    `most` is.  Runs of single characters rule little out, and nearly all pairs would meet by several of them: with q = 1 (`most` from 0.11 on) the texts of a block are compared in pieces, which
    moves texts only; that is as much work as there are pairs of distinct texts.  texts: id, block, title, choices, size (characters of the choices); they have no nulls.
    """
    from psephos.sources.io import written

    q = q or (max(1, min(4, int((1 - most) / (4 * most)))) if most > 0 else 4)  # so that half of the runs stand as long as possible
    distinct, members = text_classes(texts, block)
    if q == 1:
        rows = written(distinct.select("id", *block, "title", "choices", "size", (F.length("title") + F.col("size")).alias("long")), "texts")
        return _all_near(rows, block, most), members
    rows = distinct.select("id", *block, "title", "choices", "size", (F.length("title") + F.col("size")).alias("long"), _grams(F.concat(F.array("title"), "choices"), q).alias("runs"))
    rows = written(rows.withColumn("differ", (q * F.floor(F.lit(2 * most / (1 - most)) * F.col("long") + 1e-9)).cast("int")), "texts")
    indexed = F.size("runs") > F.col("differ")
    elements = rows.where(indexed).select("id", *block, "differ", "long", F.explode("runs").alias("run")).groupBy("id", *block, "differ", "long", "run").agg(F.count(F.lit(1)).alias("_n"))
    elements = elements.select("id", *block, "differ", "long", "run", F.explode(F.sequence(F.lit(1), F.col("_n").cast("int"))).alias("k"))
    rare = elements.groupBy(*block, "run", "k").agg(F.count(F.lit(1)).alias("often"))
    placed = elements.join(rare, [*block, "run", "k"]).withColumn("place", F.row_number().over(Window.partitionBy("id").orderBy("often", "run", "k")))
    keys = written(placed.where((F.col("place") <= F.col("differ") + 1) & (F.col("often") > 1)).select("id", *block, "run", "k", "long"), "rare_runs")
    near = F.abs(F.col("a.long") - F.col("b.long")) <= most * (F.col("a.long") + F.col("b.long"))
    cond = (F.col("a.id") < F.col("b.id")) & near
    for c in (*block, "run", "k"):
        cond = cond & (F.col(f"a.{c}") == F.col(f"b.{c}"))
    met = keys.alias("a").join(keys.alias("b"), cond).select(F.col("a.id").alias("a_id"), F.col("b.id").alias("b_id")).distinct()
    numbered = F.transform("runs", lambda r, i: F.concat(r, F.lit("#"), F.size(F.filter(F.slice(F.col("runs"), F.lit(1), i), lambda z: z == r)).cast("string")))
    full = rows.select("id", "title", "choices", "size", "long", numbered.alias("own"))
    a, b = full.alias("a"), full.alias("b")
    both = met.join(a, F.col("a_id") == F.col("a.id")).join(b, F.col("b_id") == F.col("b.id"))
    need = F.greatest(F.size("a.own"), F.size("b.own")) - q * F.floor(F.lit(most) * (F.col("a.long") + F.col("b.long")) + 1e-9)
    d = rotation_distance(F.col("a.title"), F.col("b.title"), F.col("a.choices"), F.col("b.choices"))
    alike = F.size("a.choices") == F.size("b.choices")
    found = both.where(alike & (F.size(F.array_intersect("a.own", "b.own")) >= need)).select("a_id", "b_id", d.alias("distance")).where(F.col("distance") <= most)
    open_ = rows.where(~indexed).select("id", *block, "title", "choices", "size", "long")
    x, y = open_.alias("a"), rows.select("id", *block, "title", "choices", "size", "long", indexed.alias("indexed")).alias("b")
    cond = (F.col("a.id") != F.col("b.id")) & (F.col("b.indexed") | (F.col("a.id") < F.col("b.id"))) & near & alike
    for c in block:
        cond = cond & (F.col(f"a.{c}") == F.col(f"b.{c}"))
    rest = x.join(y, cond).select(F.least("a.id", "b.id").alias("a_id"), F.greatest("a.id", "b.id").alias("b_id"), d.alias("distance")).where(F.col("distance") <= most)
    return found.unionByName(rest), members


def _next_longer(texts: DataFrame, by: str) -> DataFrame:
    """id, text, place and the next longer text of the same `by` (next_id, next_text; null for the last): rows are placed by counts, so a key of any size has many tasks."""
    placed = global_rank(texts.select(by, "id", "text"), [F.col(by), F.length("text")], ["id"], "place")
    after = placed.select(F.col(by).alias("_by"), (F.col("place") - 1).alias("_place"), F.col("id").alias("next_id"), F.col("text").alias("next_text"))
    return placed.join(after, (F.col("place") == F.col("_place")) & F.col(by).eqNullSafe(F.col("_by")), "left").drop("_by", "_place")


def neighbours(texts: DataFrame, by: str) -> DataFrame:
    """Sorted neighbourhood of one: each text with the next longer one (equally long ones by id), and their distance.  texts: by, id, text."""
    n = _next_longer(texts, by).where("next_id is not null")
    return n.select(by, "id", "next_id", F.levenshtein("text", "next_text").alias("distance"), F.greatest(F.length("text"), F.length("next_text")).alias("longest"))


def chains(texts: DataFrame, by: str, c: float) -> DataFrame:
    """by, id, chain: texts joined along the sorted neighbourhood where distance is under c / 2 of the longer text; a path, so running numbers from 0 within `by` are enough."""
    near = _next_longer(texts, by).where("next_id is not null")
    far = (F.levenshtein("text", "next_text") >= c / 2 * F.greatest(F.length("text"), F.length("next_text"))).cast("long")
    begins = near.select(by, F.col("next_id").alias("_id"), far.alias("_far"))
    own = texts.select(by, "id", F.length("text").alias("_length"))
    joined = own.join(begins.withColumnRenamed(by, "_by"), (F.col("id") == F.col("_id")) & F.col(by).eqNullSafe(F.col("_by")), "left").select(by, "id", "_length", F.coalesce("_far", F.lit(0)).alias("_far"))
    return running_sum(joined, by, [F.col("_length")], ["id"], "_far", "chain").drop("_length", "_far")


def same_labels(labels: DataFrame) -> DataFrame:
    """Contests whose labels (title and choices) agree but for case share the smallest id."""
    key = F.array_join(F.transform(F.col("labels"), lambda x: F.lower(x)), "|")
    return labels.withColumn("global_id", F.min("id").over(Window.partitionBy(key)))


def is_writein(c: Column) -> Column:
    return F.lower(c).startswith("write")


#: Phrases whose misread forms are mended.
PHRASES = ("Party Preference: Republican", "Party Preference: Democratic", "MEMBER OF THE STATE ASSEMBLY")


def fix_phrases(text: Column, phrases: tuple[str, ...] = PHRASES) -> Column:
    """Runs of words close to a known phrase of as many words become the phrase: the length differs by less than a tenth of the phrase's, the edit distance is less
    than a fifth of it (both divided down to whole numbers).  Phrases in order, places from the left; a place is judged after the places before it are mended.
    Words are joined by single spaces; null stays null.
    """
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    for p in phrases:
        n = len(p.split())
        places = F.when(F.size(words) >= n, F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(words) - (n - 1)))).otherwise(F.array().cast("array<int>"))
        words = F.aggregate(places, words, _mended(p, n))
    return F.array_join(words, " ")


def _mended(phrase: str, n: int):
    known, size = F.array(*[F.lit(w) for w in phrase.split()]), len(phrase)

    def step(own: Column, i: Column) -> Column:
        run = F.array_join(F.slice(own, i, n), " ")
        close = (F.abs(F.length(run) - size) < size // 10) & (F.levenshtein(run, F.lit(phrase)) < size // 5)
        return F.when(close, F.concat(F.slice(own, F.lit(1), i - 1), known, F.slice(own, i + n, F.size(own)))).otherwise(own)

    return step


def language_code(language: Column) -> Column:
    out = F.lit("eng")
    for name, code in LANGUAGE_CODES.items():
        out = F.when(F.lower(language) == name, code).otherwise(out)
    return out


def agglomerate(pairs: DataFrame, ids: DataFrame, block: str, linkage: float) -> DataFrame:
    """Average-linkage groups within blocks: pairs from near to far, clusters join while their average distance is under `linkage`.

    pairs: block, a_id, b_id, distance for all pairs of the block (those not given count 1.0); ids: block, id.  Sums of distances between clusters are kept and added up when two join.
    """
    def run(key: tuple, members: pd.DataFrame, dist: pd.DataFrame) -> pd.DataFrame:
        at = {i: i for i in sorted(members["id"])}
        own = {i: [i] for i in at}
        # for clusters x, y: the sum of given distances and how many are given
        between: dict[int, dict[int, tuple[float, int]]] = {i: {} for i in at}
        rows = list(zip(*[dist.sort_values(["distance", "a_id", "b_id"])[c].tolist() for c in ("a_id", "b_id", "distance")]))
        for a, b, d in rows:
            between[a][b] = between[b][a] = (d, 1)
        for a, b, _ in rows:
            x, y = at[a], at[b]
            if x == y:
                continue
            total, n = between[x][y]
            if (total + len(own[x]) * len(own[y]) - n) / (len(own[x]) * len(own[y])) < linkage:
                low, high = min(x, y), max(x, y)
                for i in own[high]:
                    at[i] = low
                own[low] += own.pop(high)
                for z, (s, k) in between.pop(high).items():
                    del between[z][high]
                    if z != low:
                        t, m = between[low].get(z, (0.0, 0))
                        between[low][z] = between[z][low] = (s + t, k + m)
        return pd.DataFrame({block: key[0], "id": list(at), "cluster": [at[i] for i in at]})

    kind = dict(ids.dtypes)[block]
    return ids.groupBy(block).cogroup(pairs.groupBy(block)).applyInPandas(run, f"{block} {kind}, id long, cluster long")


#: How alike texts must be, by language.
LINKAGE = {"eng": 0.2, "spa": 0.2, "chi_sim": 0.25, "vie": 0.3, "kor": 0.3}


def equivalence_classes(texts: DataFrame, most_in_block: int | None = None) -> DataFrame:
    """Contests (id, language code, title, choices) -> id, class: the smallest id of the texts found to be one contest.

    Blocks are language and number of choices.  Clusters join while their average distance is under the language's constant, so a join needs a pair that is nearer than that: such pairs
    make components, and each component is clustered by itself, whatever the size of its block.  most_in_block, an option, cuts blocks along the order of length as a faster approximation.
    """
    from psephos.operators.grouping import components

    sized = texts.withColumns({"n": F.size("choices"), "size": F.aggregate("choices", F.lit(0), lambda s, t: s + F.length(t))})
    known = F.lit(0.2)
    for code, c in LINKAGE.items():
        known = F.when(F.col("language") == code, c).otherwise(known)
    cut = F.lit(0)
    if most_in_block:
        w = Window.partitionBy("language", "n").orderBy(F.length("title") + F.col("size"), "title", "id")
        cut = F.floor((F.row_number().over(w) - 1) / most_in_block)
    blocked = sized.withColumn("linkage", known).withColumn("block", F.concat_ws("/", "language", F.col("n").cast("string"), cut.cast("string")))
    # distances in units of the language's constant, so that one linkage serves all blocks
    found, members = similar_pairs(blocked, ["block"], max(LINKAGE.values()))
    near = found.join(blocked.select(F.col("id").alias("a_id"), "linkage"), "a_id").where("distance < linkage")
    links = near.select(F.col("a_id").alias("a"), F.col("b_id").alias("b")).unionByName(members.where("id <> rep").select(F.col("id").alias("a"), F.col("rep").alias("b")))
    group = components(links)
    grouped = blocked.drop("block").join(group.select(F.col("node").alias("id"), F.col("root").alias("_root")), "id", "left").withColumn("block", F.coalesce("_root", "id"))
    pairs = pairs_in_blocks(grouped, ["block"], 1.0).join(grouped.select(F.col("id").alias("a_id"), "block", "linkage"), "a_id")
    return agglomerate(pairs.select("block", "a_id", "b_id", (F.col("distance") / F.col("linkage")).alias("distance")), grouped.select("block", "id"), "block", 1.0).select("id", F.col("cluster").alias("class"))


def with_texts(stripes: DataFrame, known: DataFrame, on: list[str], recognise=None, image: str = "image") -> tuple[DataFrame, DataFrame]:
    """(stripes with text, the texts to keep): what was read before (on, text) is joined; the rest is read by `recognise`, a function of the image, or stays null without one."""
    joined = stripes.join(known.select(*on, "text"), on, "left")
    if recognise is None:
        return joined, known.select(*on, "text")
    new = stripes.join(known.select(*on), on, "left_anti")
    kinds = dict(stripes.dtypes)

    def run(it):
        for pdf in it:
            yield pdf[[*on]].assign(text=[recognise(x) for x in pdf[image]])

    read = new.select(*on, image).mapInPandas(run, ", ".join([*[f"`{c}` {kinds[c]}" for c in on], "text string"]))
    every = known.select(*on, "text").unionByName(read)
    return stripes.join(every, on, "left"), every


def in_order(files: Column, order: Column) -> Column:
    """An array rearranged: place i has the element that `order` names there, from 0."""
    return F.transform(order, lambda i: F.get(files, i))


def multibox(contests: DataFrame, boxes: DataFrame, on: str) -> DataFrame:
    """on, n, multibox: how many boxes a contest has, and whether it goes on in another."""
    n = boxes.groupBy(on).agg(F.count(F.lit(1)).alias("n"))
    return contests.select(on).join(n, on, "left").select(on, F.coalesce("n", F.lit(0)).alias("n"), (F.coalesce("n", F.lit(0)) > 1).alias("multibox"))


def multibox_pairs(boxes: DataFrame, order: DataFrame, known: DataFrame, most: float = 0.2) -> DataFrame:
    """Pairs of boxes that are, on their ballot, what a known pair is on its own: one contest that goes on in a second box.

    boxes: ballot, box, texts (the title, then the choices); order: ballot, a, b, the pairs of boxes that may follow each other; known: ballot, a, b.  The texts of both boxes on end are compared
    with a known pair's, under the best rotation, if they are as many; a pair nearer than `most` is returned once for each known pair it matches: ballot, a, b, known_ballot, known_a, known_b,
    distance, turn (from which place the pair's choices are to be read to follow the known one's).  Texts that are the same on many ballots are compared once; the number of texts is the index.
    """
    from psephos.sources.io import written

    def with_texts_of(pairs):
        own = pairs.select("ballot", "a", "b").distinct()
        for side in ("a", "b"):
            own = own.join(boxes.select("ballot", F.col("box").alias(side), F.col("texts").alias(f"_{side}")), ["ballot", side])
        return own.select("ballot", "a", "b", F.concat("_a", "_b").alias("texts")).withColumn("key", F.xxhash64("texts"))

    pairs, models = written(with_texts_of(order), "pairs"), written(with_texts_of(known), "known_pairs")
    unlike = pairs.select("key", "texts", F.size("texts").alias("n")).distinct()
    wanted = models.select(F.col("key").alias("known_key"), F.col("texts").alias("known_texts"), F.size("texts").alias("n")).distinct()
    wanted = F.broadcast(wanted) if wanted.count() <= 10_000 else wanted  # decisions of people: few; else by a shuffle
    title, choices = (lambda c: F.get(c, F.lit(0))), (lambda c: F.slice(c, 2, F.size(c)))
    d = rotation_distance(title(F.col("known_texts")), title(F.col("texts")), choices(F.col("known_texts")), choices(F.col("texts")))
    total = F.transform(rotations(choices(F.col("texts"))), lambda r: F.aggregate(F.zip_with(choices(F.col("known_texts")), r, lambda x, y: F.levenshtein(x, y)), F.lit(0), lambda s, x: s + x))
    turn = (F.array_position(total, F.array_min(total)) - 1).cast("int")
    near = unlike.join(wanted, "n").where(F.col("n") > 1).select("key", "texts", "known_key", "known_texts", d.alias("distance"), turn.alias("turn")).where(F.col("distance") < most)
    named = models.select(F.col("ballot").alias("known_ballot"), F.col("a").alias("known_a"), F.col("b").alias("known_b"), F.col("key").alias("known_key"), F.col("texts").alias("known_texts"))
    found = pairs.join(near, ["key", "texts"]).join(named, ["known_key", "known_texts"])
    return found.select("ballot", "a", "b", "known_ballot", "known_a", "known_b", "distance", "turn")


def merged_boxes(boxes: DataFrame, found: DataFrame) -> DataFrame:
    """boxes with the box each one belongs to (`into`): the second box of a pair goes into the first; a box that is in no pair stays."""
    second = found.groupBy("ballot", F.col("b").alias("box")).agg(F.min("a").alias("into"))
    return boxes.join(second, ["ballot", "box"], "left").withColumn("into", F.coalesce("into", "box"))
