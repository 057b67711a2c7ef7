"""URL filters: prefix rules, and a cascade of Bloom filters for lists of hosts."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from psephos.llm.common import ascii_lower, table, written


@dataclass(frozen=True)
class Rule:
    action: str  # block or allow
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


RULES = (Rule("block", "com", "/en/"), Rule("allow", "example.com", "/en/7"), Rule("allow", "net", "/de/"), Rule("block", "example.net", "/de/8"), Rule("block", "org", "/es/"))


def host_of(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def fitting(host: str, path: str, paths: dict[str, list[Rule]]) -> Rule | None:
    """The longest rule that fits; of equally long ones that with the longer host.  paths: the rules of each host, longest first."""
    best, at = None, 0
    while True:
        for r in paths.get(host[at:], ()):
            if path.startswith(r.path):
                if best is None or (len(r.text), len(r.host)) > (len(best.text), len(best.host)):
                    best = r
                break
        dot = host.find(".", at)
        if dot < 0:
            return best
        at = dot + 1


def with_rules(urls: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """urls (with string columns host and path) with the text and the action of the rule that fits, null if none does.  Any number of rules: a table by host that each worker holds."""
    paths: dict[str, list[Rule]] = {}
    for r in sorted(rules, key=lambda r: -len(r.path)):
        paths.setdefault(r.host, []).append(r)
    shared = urls.sparkSession.sparkContext.broadcast(paths)

    def run(batches):
        for b in batches:
            found = [fitting(h, p, shared.value) for h, p in zip(b.column("host").to_pylist(), b.column("path").to_pylist())]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([r and r.text for r in found], pa.string()), pa.array([r and r.action for r in found], pa.string())], names=[*b.schema.names, "rule", "action"])

    kinds = ", ".join(f"`{c}` {k}" for c, k in urls.dtypes)
    return urls.mapInArrow(run, f"{kinds}, rule string, action string")


# --- the cascade --------------------------------------------------------------------------------


def _places(h1: np.ndarray, h2: np.ndarray, level: int, hashes: int, bits: int):
    """The bits of each key (two int64 hashes) in the filter of a level; every level mixes the hashes anew."""
    a, b = (x.view(np.uint64) ^ np.uint64((level + 1) * 0x9E3779B97F4A7C15 % 2**64) for x in (h1, h2))
    a, b = ((x ^ (x >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93) for x in (a, b))
    a, b = (x ^ (x >> np.uint64(32)) for x in (a, b))
    for i in range(hashes):
        yield (a + np.uint64(i) * (b | np.uint64(1))) % np.uint64(bits)


@dataclass(frozen=True)
class Level:
    number: int
    bits: int
    hashes: int
    words: np.ndarray  # uint64

    def holds(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        found = np.ones(len(h1), bool)
        for at in _places(h1, h2, self.number, self.hashes, self.bits):
            found &= (self.words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)
        return found


def cascade_holds(levels: list[Level], h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    """Exact membership for keys of the universe: the first level without the key decides, and the levels say no and yes in turn."""
    listed, open_ = np.full(len(h1), len(levels) % 2 == 1), np.arange(len(h1))
    for k, level in enumerate(levels):
        passed = level.holds(h1[open_], h2[open_])
        listed[open_[~passed]] = k % 2 == 1
        open_ = open_[passed]
    return listed


def _filter(keys: DataFrame, level: int, n: int, rate: float, most_bytes: int) -> Level:
    """A Bloom filter of the n keys (columns h1, h2).  Tasks set bits in words, words meet in a grouped aggregation; only the filter itself comes to the driver, and its size is checked."""
    bits = max(64, math.ceil(n * -math.log(rate) / math.log(2) ** 2))
    hashes = max(1, round(bits / n * math.log(2))) if n * 64 > bits else 8
    if bits > 8 * most_bytes:
        raise MemoryError(f"a level of {bits // 8} bytes is over the bound of {most_bytes}: more parts are needed")

    def run(batches):
        for b in batches:
            at = np.concatenate([*_places(b.column("h1").to_numpy(), b.column("h2").to_numpy(), level, hashes, bits)])
            words, own = np.unique(at >> np.uint64(6), return_inverse=True)
            masks = np.zeros(len(words), np.uint64)
            np.bitwise_or.at(masks, own, np.uint64(1) << (at & np.uint64(63)))
            yield pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(masks.view(np.int64))], names=["word", "mask"])

    words = keys.mapInArrow(run, "word long, mask long").groupBy("word").agg(F.bit_or("mask").alias("mask")).toArrow()
    out = np.zeros(bits // 64 + 1, np.uint64)
    out[words.column("word").to_numpy()] = words.column("mask").to_numpy().view(np.uint64)
    return Level(level, bits, hashes, out)


def _tested(level):
    def run(batches):
        for b in batches:
            ok = level.value.holds(b.column("h1").to_numpy(), b.column("h2").to_numpy())
            yield b.filter(pa.array(ok))

    return run


def parts_needed(n: int, rate: float, most_bytes: int) -> int:
    """Into how many parts by hash the keys are split, so that the first level for n keys takes at most half of most_bytes in each (later levels are smaller, and parts vary little)."""
    return max(1, math.ceil(2 * n * -math.log(rate) / math.log(2) ** 2 / (8 * most_bytes)))


def build_cascade(universe: DataFrame, key: str, listed: str, rate: float = 0.02, most_bytes: int = 64 << 20, most_levels: int = 40) -> list[list[Level]]:
    """A cascade for each part of the keys, by hash; the boolean column listed says which are listed, and universe has every key of the corpus once.

    Level 1 encodes the listed keys, level 2 the other keys of the universe that level 1 lets pass, level 3
    the listed keys that level 2 lets pass, and so on until none is left over.  Keys are known by 128 hash
    bits.  There are as many parts as keep every level under most_bytes, so no list is too long.
    """
    keys = written(universe.select(F.xxhash64(key).alias("h1"), F.xxhash64(F.lit("second"), key).alias("h2"), F.col(listed).alias("listed")), "cascade")
    parts = parts_needed(keys.where("listed").count(), rate, most_bytes)
    while True:
        try:
            return [_cascade(keys.where(part_of(F.col("h2"), parts) == part), rate, most_bytes, most_levels) for part in range(parts)]
        except MemoryError:  # a part has more than its share
            parts *= 2


def _cascade(keys: DataFrame, rate: float, most_bytes: int, most_levels: int) -> list[Level]:
    inside, outside = keys.where("listed").select("h1", "h2"), keys.where("not listed").select("h1", "h2")
    levels: list[Level] = []
    while n := inside.count():
        if len(levels) == most_levels:
            raise RuntimeError("the cascade does not end: two keys agree in 128 hash bits")
        levels.append(_filter(inside, len(levels), n, rate, most_bytes))
        level = keys.sparkSession.sparkContext.broadcast(levels[-1])
        inside, outside = written(outside.mapInArrow(_tested(level), "h1 long, h2 long"), "cascade"), inside
    return levels


def part_of(h2: Column, parts: int) -> Column:
    return F.pmod(F.shiftrightunsigned(h2, 20), F.lit(parts).cast("long"))


def listed_by_cascade(df: DataFrame, key: str, cascades: list[list[Level]], to: str) -> DataFrame:
    """df with a boolean column `to`: whether the key is listed.  No join and no shuffle; the rows of a part are tested by its cascade, whose levels are bounded, so a worker holds one at a time."""
    hashed = df.select("*", F.xxhash64(key).alias("_h1"), F.xxhash64(F.lit("second"), key).alias("_h2"))
    kinds, out = ", ".join(f"`{c}` {k}" for c, k in df.dtypes), None
    for part, levels in enumerate(cascades):
        own = hashed.where(part_of(F.col("_h2"), len(cascades)) == part) if len(cascades) > 1 else hashed
        one = own.mapInArrow(_holding(df.sparkSession.sparkContext.broadcast(levels), to), f"{kinds}, `{to}` boolean")
        out = one if out is None else out.unionByName(one)
    return out


def _holding(shared, to: str):
    def run(batches):
        for b in batches:
            ok = cascade_holds(shared.value, b.column("_h1").to_numpy(), b.column("_h2").to_numpy())
            yield pa.RecordBatch.from_arrays([*b.columns[:-2], pa.array(ok)], names=[*b.schema.names[:-2], to])

    return run


# --- the operator -------------------------------------------------------------------------------


def judge_urls(pages: DataFrame, rules: tuple[Rule, ...] = RULES, page_id: str = "page_id", url: str = "url", listed_share: float = 0.5, most_bytes: int = 64 << 20) -> DataFrame:
    """page_id, host, path, rule, verdict, listed for every page.

    The longest rule that fits decides.  Where none fits, a page is blocked if its host is listed: if the
    rules block at least listed_share of those of its pages that a rule fits.  All hosts of the corpus are the universe of a
    Bloom cascade that holds the listed ones, so each url is tested where it is read.  No level takes over
    most_bytes: a longer list is split by hash, and each part has a cascade of its own.

    A null url, or one without "://", has an empty host and path, fits no rule and is allowed; urls of any length are
    taken whole.  Repeated rows are judged each; other columns are ignored, whatever their names; an empty table gives no rows.
    """
    split = pages.select(F.col(page_id).alias("page_id"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    ruled = with_rules(split, rules)
    votes = ruled.groupBy("host").agg(F.count("action").alias("n"), F.count(F.when(F.col("action") == "block", 1)).alias("blocked"))
    hosts = votes.select("host", ((F.col("n") > 0) & (F.col("blocked") >= F.lit(listed_share) * F.col("n"))).alias("is_listed"))
    judged = listed_by_cascade(ruled, "host", build_cascade(hosts, "host", "is_listed", most_bytes=most_bytes), "listed")
    verdict = F.coalesce("action", F.when(F.col("listed"), "block").otherwise("allow"))
    return judged.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "listed")


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, host, path, rule, verdict, listed of every page; nulls, repeated rows and empty tables as in judge_urls."""
    return judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"))


OP2_SQL = r"""
WITH u AS (SELECT page_id, COALESCE(translate(regexp_extract(url, '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host, COALESCE(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
r AS (SELECT *, CASE
  WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/de/8') THEN 'example.net/de/8'
  WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/en/7') THEN 'example.com/en/7'
  WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/en/') THEN 'com/en/'
  WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/de/') THEN 'net/de/'
  WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/es/') THEN 'org/es/' END AS rule FROM u),
a AS (SELECT *, CASE WHEN rule IN ('com/en/', 'example.net/de/8', 'org/es/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow' END AS action FROM r),
h AS (SELECT host, COUNT(action) > 0 AND COUNT(*) FILTER (WHERE action = 'block') >= 0.5 * COUNT(action) AS listed FROM a GROUP BY host)
SELECT a.page_id, a.host, a.path, a.rule, COALESCE(a.action, CASE WHEN h.listed THEN 'block' ELSE 'allow' END) AS verdict, h.listed FROM a JOIN h USING (host)
"""
