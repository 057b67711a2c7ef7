"""Language identification of pages by Bayesian fusion of text, markup, address and host."""

from __future__ import annotations

import html
import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from psephos.llm.common import spread_join, table, utf8, written
from psephos.llm.tokens import text_runs
from psephos.llm.url_filter import host_of, path_of

#: Pages of one host that are joined with its prior in one task; the priors of larger hosts are sent to where their pages are.
CROWD = 4096
_BUCKETS = 1 << 14  # trigram hashes: the model has this many numbers per language, whatever the corpus
_SCRIPT = re.compile(r"(?is)<(script|style|template)\b")
_SCRIPT_END = {n: re.compile(rf"(?is)</{n}\s*>") for n in ("script", "style", "template")}
_HTML = re.compile(r"(?is)<html\b")
_LANG = re.compile(r"""(?is)\slang\s*=\s*["']?([a-z]{2,8})""")
_LONG_NUMBER = re.compile(r"&#([0-9]{8,});?")


def unescaped(text: str) -> str:
    """Character references resolved; a number with any digits, beyond the last character, is the replacement character."""
    short = _LONG_NUMBER.sub(lambda m: "\ufffd" if len(n := m[1].lstrip("0")) > 7 else f"&#{n or 0};", text)
    return html.unescape(short)


def visible(page: str | None) -> str:
    """The text of a page without scripts, styles, templates, comments and tags, each a space.

    One pass: a script, style or template goes to its end, a comment to its own, any other tag to the next `>`; what has no end is looked for once and remembered, and then counts as a tag.
    After the last `>` all is text.
    """
    t, out, at = page or "", [], 0
    endless, comments = set(), True
    while (i := t.find("<", at)) >= 0:
        end = -1
        if m := _SCRIPT.match(t, i):
            name = m[1].lower().replace("\u017f", "s")  # a long s is an s to the pattern
            closing = None if name in endless else _SCRIPT_END[name].search(t, m.end())
            if closing:
                end = closing.end()
            else:
                endless.add(name)
        if end < 0 and comments and t.startswith("<!--", i):
            end = t.find("-->", i + 4) + 3
            comments = end > 2
            end = end if comments else -1
        if end < 0:
            end = t.find(">", i) + 1
            if not end:
                break
        out.append(t[at:i])
        at = end
    out.append(t[at:])
    return unescaped(" ".join(out))


def declared(page: str | None) -> str | None:
    """The language that a page's html tag names.  A tag goes to the next `>`, or to the end; it is searched once, whatever begins within it."""
    t, at = page or "", 0
    while m := _HTML.search(t, at):
        end = t.find(">", m.end())
        end = len(t) if end < 0 else end
        if found := _LANG.search(t, m.end(), end):
            return found[1].lower()
        at = end
    return None


def trigrams(text: bytes) -> np.ndarray:
    """Buckets of the text's byte trigrams, lower-cased, digits and white space as spaces; runs of spaces give none."""
    b = np.frombuffer(text.lower(), np.uint8)
    b = np.where((b < 65) & (b != 39), 32, b).astype(np.uint64)
    b = np.concatenate([[np.uint64(32)], b, [np.uint64(32)]])
    plain = (b[:-2] != 32) | (b[1:-1] != 32)
    h = (b[:-2] * np.uint64(65536) + b[1:-1] * np.uint64(256) + b[2:])[plain] * np.uint64(0x9E3779B97F4A7C15)
    return (h >> np.uint64(50)).astype(np.int64)


def _counts(batches):
    for b in batches:
        by: dict[str, np.ndarray] = {}
        langs = b.column("lang").to_pylist()
        for first, texts in text_runs(b.column("text")):
            for lang, t in zip(langs[first:], texts):
                by.setdefault(lang, np.zeros(_BUCKETS, np.int64))
                by[lang] += np.bincount(trigrams(t), minlength=_BUCKETS)
        for lang, n in by.items():
            at = np.nonzero(n)[0]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(n[at])], names=["lang", "bucket", "n"])


def learn_text(docs: DataFrame, lang: str = "lang", text: str = "text") -> tuple[list[str], np.ndarray]:
    """(languages, log P(bucket | language)) from all documents with a language; one number per language and bucket, 128 KB a language, comes to the driver and to each worker."""
    rows = docs.where(F.col(lang).isNotNull()).select(F.lower(F.col(lang)).alias("lang"), F.col(text).alias("text"))
    found = rows.mapInArrow(_counts, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    langs = [r.lang for r in rows.select("lang").distinct().orderBy("lang").collect()]
    counts = np.full((len(langs), _BUCKETS), 0.5)
    cells = found.toArrow()
    at = {x: i for i, x in enumerate(langs)}
    counts[[at[x] for x in cells.column("lang").to_pylist()], cells.column("bucket").to_numpy()] += cells.column("n").to_numpy()
    return langs, np.log(counts / counts.sum(axis=1, keepdims=True))


def _scored(shared):
    def run(batches):
        langs, logs = shared.value
        for b in batches:
            out, said = [], []
            for page in b.column("html").to_pylist():
                said.append(declared(page))
                g = trigrams(utf8(visible(page)))
                out.append(logs[:, g].sum(axis=1) if len(g) else np.zeros(len(langs)))
            flat = np.concatenate([*out, np.zeros(0)])
            lists = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * len(langs)), pa.array(flat))
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("host"), b.column("mark"), pa.array(said, pa.string()), lists], names=["page_id", "host", "mark", "declared", "loglik"])

    return run


def identify(pages: DataFrame, docs: DataFrame, tempering: float = 0.3, weight: float = 4.0, alpha: float = 1.0, page_id: str = "page_id", url: str = "url", page_html: str = "html") -> DataFrame:
    """page_id, host, declared, mark, text_lang, lang, probability for every page.

    The text gives log-likelihoods from byte trigrams (tempered, as overlapping trigrams are not independent).  Its best language, by
    grouped counts over all pages, teaches how far to believe the language declared in the markup and the one the address is marked with (its
    last host label or first path segment), and what each host holds.  A host's prior is its own counts without the page itself,
    smoothed by `weight` pages of its domain's, which is smoothed by its suffix's, and that by all pages'.  The language with the largest posterior wins, the
    first by code of several.

    A page without text, null or empty, rests on the other evidence; with none at all it gets the commonest language.  Null urls are one host, the empty one.
    Texts and pages of any length are read whole, in time in proportion to it whatever their markup.  Repeated rows are judged each; other columns are ignored, whatever their names; no pages, no rows; without labelled documents lang is null.
    page_id is cast to long.
    """
    spark = pages.sparkSession
    langs, logs = learn_text(docs)
    host = host_of(F.col(url))
    if not langs:
        null = F.lit(None).cast("string")
        return pages.select(F.col(page_id).cast("long").alias("page_id"), host.alias("host"), null.alias("declared"), null.alias("mark"), null.alias("text_lang"), null.alias("lang"), F.lit(None).cast("double").alias("probability"))
    last, segment = F.element_at(F.split(host, r"\."), -1), ascii_segment(path_of(F.col(url)))
    mark = F.when(segment.isin(langs), segment).when(last.isin(langs), last)
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), host.alias("host"), mark.alias("mark"), F.col(page_html).alias("html"))
    scored = rows.mapInArrow(_scored(spark.sparkContext.broadcast((langs, logs))), "page_id long, host string, mark string, declared string, loglik array<double>")
    names = F.array(*[F.lit(x) for x in langs])
    best = F.when(F.array_max("loglik") < 0, F.element_at(names, F.array_position("loglik", F.array_max("loglik")).cast("int")))
    said = F.when(F.col("declared").isin(langs), F.col("declared"))
    scored = written(scored.withColumn("text_lang", best).withColumn("said", said), "pages")

    def believed(column: str) -> DataFrame:
        """For each value of column, none among them, log P(value | language) as an array over languages: a row per language and one more."""
        n = {(r.text_lang, r[column]): r.n for r in scored.where("text_lang is not null").groupBy("text_lang", column).agg(F.count(F.lit(1)).alias("n")).collect()}
        values = [*langs, None]
        totals = [sum(n.get((x, v), 0) for v in values) + alpha * len(values) for x in langs]
        rows = [(v, [math.log((n.get((x, v), 0) + alpha) / t) for x, t in zip(langs, totals)]) for v in values]
        return F.broadcast(spark.createDataFrame(rows, f"_{column} string, {column}_ll array<double>"))

    of = [f"n{i}" for i in range(len(langs))]
    counts = [F.count(F.when(F.col("text_lang") == x, 1)).alias(c) for x, c in zip(langs, of)]
    every = scored.agg(*counts).first()
    everywhere = F.array(*[F.lit((every[c] + alpha) / (sum(every) + alpha * len(langs))) for c in of])
    hosts = scored.groupBy("host").agg(F.count(F.lit(1)).alias("pages"), *counts).withColumn("labels", F.split("host", r"\."))
    hosts = hosts.withColumn("suffix", F.element_at("labels", -1)).withColumn("domain", F.array_join(F.slice("labels", F.greatest(F.lit(1), F.size("labels") - 1), 2), ".")).drop("labels")
    hosts = written(hosts, "hosts")

    def smoothed(level: DataFrame, prior, to: str) -> DataFrame:
        own = level.withColumn("_n", F.array(*of)).withColumn("_all", sum((F.col(c) for c in of), F.lit(0))).withColumn("_prior", prior)
        return own.withColumn(to, F.zip_with("_n", "_prior", lambda c, p: (c + weight * p) / (F.col("_all") + weight))).drop("_n", "_all", "_prior", *of)

    suffixes = smoothed(hosts.groupBy("suffix").agg(*[F.sum(c).alias(c) for c in of]), everywhere, "suffix_p")
    domains = hosts.groupBy("domain").agg(F.first("suffix").alias("suffix"), *[F.sum(c).alias(c) for c in of]).join(suffixes, "suffix")
    domains = smoothed(domains, F.col("suffix_p"), "domain_p").select("domain", "domain_p")
    priors = hosts.join(domains, "domain").select("host", "pages", F.array(*of).alias("host_n"), sum((F.col(c) for c in of), F.lit(0)).alias("host_all"), "domain_p")
    joined = spread_join(scored, priors, ["host"], "pages", CROWD)
    for column in ("said", "mark"):
        joined = joined.join(believed(column), F.col(column).eqNullSafe(F.col(f"_{column}"))).drop(f"_{column}")
    joined = joined.withColumn("own", F.coalesce(F.array_position(names, F.col("text_lang")) - 1, F.lit(-1))).withColumn("total", F.col("host_all") - F.when(F.col("own") >= 0, 1).otherwise(0) + weight)
    prior = lambda i: F.log((F.get("host_n", i) - F.when(i == F.col("own"), 1).otherwise(0) + weight * F.get("domain_p", i)) / F.col("total"))
    posterior = F.transform(F.sequence(F.lit(0), F.lit(len(langs) - 1)), lambda i: tempering * F.get("loglik", i) + prior(i) + F.get("said_ll", i) + F.get("mark_ll", i))
    out = joined.withColumn("posterior", posterior).withColumn("top", F.array_max("posterior"))
    lang = F.element_at(names, F.array_position("posterior", F.col("top")).cast("int"))
    probability = 1 / F.aggregate(F.transform("posterior", lambda x: F.exp(x - F.col("top"))), F.lit(0.0), lambda a, x: a + x)
    return out.select("page_id", "host", "declared", "mark", "text_lang", lang.alias("lang"), probability.alias("probability"))


def ascii_segment(path):
    return F.lower(F.regexp_extract(path, r"^/([A-Za-z]{2,8})(?:[-_/]|$)", 1))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, host, declared, mark, text_lang, lang, probability of every page; nulls, long and empty pages, ties, repeated rows and empty tables as in identify."""
    return identify(table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents").select("lang", "text"))
