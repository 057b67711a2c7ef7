"""Quality rules: statistics of whole texts, and a decision list learned from labels."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from psephos.llm.common import free_name, give_back_memory, table, utf8

_SYMBOLS, _UPPER, _DIGIT, _SPACE = (np.isin(np.arange(256), list(x)) for x in (b"#*$%&|<>", bytes(range(65, 91)), b"0123456789", b" \t\n\v\f\r"))
_WINDOW = 8
_ODD = np.array([pow(0x9E3779B97F4A7C15, k + 1, 2**64) for k in range(_WINDOW)], np.uint64)

#: What is counted in a text; all long.
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_digits")


def repeated_words(ids: np.ndarray, window: int = _WINDOW) -> int:
    """Words in windows that are found twice or more.  Windows whose hashes meet are compared word by word."""
    n = len(ids) - window + 1
    if n < 2:
        return 0
    h = np.zeros(n, np.uint64)
    for k in range(window):
        h += ids[k : k + n].astype(np.uint64) * _ODD[k]
    order = np.argsort(h, kind="stable")
    same = h[order][1:] == h[order][:-1]
    if not same.any():
        return 0
    maybe = np.sort(order[np.concatenate([same, [False]]) | np.concatenate([[False], same])])
    windows = [tuple(ids[i : i + window].tolist()) for i in maybe.tolist()]
    times = Counter(windows)
    edge = np.zeros(len(ids) + 1, np.int64)
    for i, w in zip(maybe.tolist(), windows):
        if times[w] > 1:
            edge[i] += 1
            edge[i + window] -= 1
    return int((np.cumsum(edge)[:-1] > 0).sum())


def count(text: str | bytes | None) -> tuple[int, ...]:
    """COUNTS of a text; all zero for null and empty, but for n_lines of an empty text, 1."""
    if text is None:
        return (0,) * len(COUNTS)
    b = text if isinstance(text, bytes) else utf8(text)
    words, buffer = b.split(), np.frombuffer(b, np.uint8)
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
    lines, seen, dup = b.split(b"\n"), set(), 0
    for line in lines:
        if line in seen:
            dup += bool(line.strip())
        else:
            seen.add(line)
    points = int(np.count_nonzero(buffer & 0xC0 != 0x80)) - int(np.count_nonzero(_SPACE[buffer]))
    return (len(words), points, *(int(np.count_nonzero(t[buffer])) for t in (_SYMBOLS,)), dup, repeated_words(ids), len(lines), *(int(np.count_nonzero(t[buffer])) for t in (_UPPER, _DIGIT)))


def with_counts(docs: DataFrame, text: str, to: str) -> DataFrame:
    """docs with a struct column `to` of COUNTS, streamed through workers."""

    def run(batches):
        for b in batches:
            at = b.schema.get_field_index(text)
            rows = np.array([count(t.as_py()) for t in b.column(at).cast(pa.large_binary())], np.int64).reshape(-1, len(COUNTS))
            counts = pa.StructArray.from_arrays([pa.array(rows[:, i]) for i in range(len(COUNTS))], names=list(COUNTS))
            yield pa.RecordBatch.from_arrays([*b.columns, counts], names=[*b.schema.names, to])
        give_back_memory()

    kinds = ", ".join(f"`{c}` {k}" for c, k in docs.dtypes)
    return docs.mapInArrow(run, f"{kinds}, `{to}` struct<{', '.join(f'{c}: bigint' for c in COUNTS)}>")


# --- the decision list --------------------------------------------------------------------------


def _ratio(a: str, b: str):
    return lambda c: F.when(c(b) > 0, c(a) / c(b)).otherwise(F.lit(0.0))


#: What rules speak about: ratios of counts.
FEATURES = {
    "symbols_per_word": _ratio("n_symbols", "n_words"),
    "chars_per_word": _ratio("word_chars", "n_words"),
    "dup_lines_per_line": _ratio("n_dup_lines", "n_lines"),
    "repeat_words_per_word": _ratio("n_repeat_words", "n_words"),
    "words_per_line": _ratio("n_words", "n_lines"),
    "upper_per_char": _ratio("n_upper", "word_chars"),
    "digits_per_char": _ratio("n_digits", "word_chars"),
    "words": lambda c: c("n_words").cast("double"),
}


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def holds(self, x: np.ndarray) -> np.ndarray:
        v = x[:, list(FEATURES).index(self.feature)]
        return v > self.threshold if self.above else v <= self.threshold

    def column(self, of) -> Column:
        v = FEATURES[self.feature](of)
        return v > F.lit(self.threshold) if self.above else v <= F.lit(self.threshold)

    def __str__(self):
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:.6g}"


Rule = tuple[Condition, ...]


def _covers(rule: Rule, x: np.ndarray) -> np.ndarray:
    ok = np.ones(len(x), bool)
    for c in rule:
        ok &= c.holds(x)
    return ok


def _grow(x: np.ndarray, bad: np.ndarray, cuts: int, most: int) -> Rule:
    """Adds the condition of the greatest FOIL gain until no good text is covered."""
    rule: Rule = ()
    ok = np.ones(len(x), bool)
    while len(rule) < most and (ok & ~bad).any():
        p, n = (ok & bad).sum(), (ok & ~bad).sum()
        if not p:
            break
        best, gain, xs, ys = None, 1e-9, x[ok], bad[ok]
        for i, f in enumerate(FEATURES):
            v = xs[:, i]
            levels = np.unique(v)
            if len(levels) < 2:
                continue
            marks = np.unique((levels[1:] + levels[:-1])[np.linspace(0, len(levels) - 2, min(cuts, len(levels) - 1)).astype(int)] / 2)
            order = np.argsort(v)
            bads = np.concatenate([[0], np.cumsum(ys[order])])
            below = np.searchsorted(v[order], marks, "right")
            for above, pos, size in ((False, bads[below], below), (True, bads[-1] - bads[below], len(v) - below)):
                g = np.where(pos > 0, pos * (np.log2(np.maximum(pos, 1) / np.maximum(size, 1)) - np.log2(p / (p + n))), 0)
                k = int(np.argmax(g))
                if g[k] > gain:
                    best, gain = Condition(f, above, float(marks[k])), g[k]
        if best is None:
            break
        rule += (best,)
        ok &= best.holds(x)
    return rule


def _prune(rule: Rule, x: np.ndarray, bad: np.ndarray) -> Rule:
    """Drops last conditions as long as (bad - good) / (bad + good) among the covered does not fall."""
    def worth(r):
        ok = _covers(r, x)
        return ((ok & bad).sum() - (ok & ~bad).sum()) / max(1, ok.sum())

    best = rule
    for k in range(len(rule) - 1, 0, -1):
        if worth(rule[:k]) >= worth(best):
            best = rule[:k]
    return best


def learn(x: np.ndarray, bad: np.ndarray, precision: float = 0.9, cuts: int = 256, most: int = 5, rules: int = 20) -> list[Rule]:
    """Sequential covering (RIPPER's grow and prune): ordered conjunctions that reject.

    x: rows of FEATURES; bad: labels.  Two rows in three grow a rule, the third prunes it; a rule stays if, on all rows
    left, Laplace's estimate (bad + 1) / (covered + 2) is `precision` at least; what it covers is set aside.  No labels, no rules.
    """
    found: list[Rule] = []
    fold = np.arange(len(x)) % 3 == 2
    while bad.any() and len(found) < rules:
        rule = _grow(x[~fold], bad[~fold], cuts, most)
        if not rule:
            break
        if fold.any():
            rule = _prune(rule, x[fold], bad[fold])
        ok = _covers(rule, x)
        if (ok & bad).sum() + 1 < precision * (ok.sum() + 2):
            break
        found.append(rule)
        x, bad, fold = x[~ok], bad[~ok], fold[~ok]
    return found


def rejects(rules: list[Rule], of) -> Column:
    """The list as an ordered conditional expression: 1, 2, ... for the first rule that fits, else 0.  `of` gives the column of a count."""
    out = None
    for k, rule in enumerate(rules):
        fits = rule[0].column(of)
        for c in rule[1:]:
            fits = fits & c.column(of)
        out = F.when(fits, k + 1) if out is None else out.when(fits, k + 1)
    return F.lit(0) if out is None else out.otherwise(0)


def base_failed(of) -> Column:
    return (of("n_words") < 20) | (of("n_repeat_words") * 100 > of("n_words") * 30)


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", sample: int = 20_000) -> list[Rule]:
    """The decision list from labelled documents: at most `sample` labels, the first in hash order; of several labels of a document, the least.

    Rules are for what the base lets pass.  Only the chosen documents' texts are counted, and as many rows of ratios at most come to the driver.  Labels without a document, or null, are not used.
    """
    chosen = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("_id")).agg(F.min(label).alias("_quality"))
    chosen = chosen.orderBy(F.xxhash64("_id"), "_id").limit(sample)
    own = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text")).join(F.broadcast(chosen), "_id")  # bounded by sample
    counted = with_counts(own, "_text", "_counts")
    of = lambda c: F.col("_counts")[c]
    ratios = counted.where(~base_failed(of)).select("_id", "_quality", *[f(of).alias(n) for n, f in FEATURES.items()]).orderBy(F.xxhash64("_id"), "_id", *FEATURES).limit(sample)
    rows = ratios.toArrow()
    x = np.stack([rows.column(n).to_numpy() for n in FEATURES], axis=1) if rows.num_rows else np.zeros((0, len(FEATURES)))
    return learn(x, rows.column("_quality").to_numpy() == 0)


def judged(docs: DataFrame, rules: list[Rule], text: str = "text") -> tuple[DataFrame, str]:
    """docs with one more column, a struct of COUNTS, rule, base_failed and kept; and that column's name.

    A null text has no words and fails the base.  Rows are judged each, whatever else they hold.
    """
    name, raw = free_name(docs, "quality"), free_name(docs, "quality_counts")
    counted = with_counts(docs, text, raw)
    of = lambda c: F.col(raw)[c]
    rule, failed = rejects(rules, of), base_failed(of)
    out = counted.withColumn(name, F.struct(*[of(c).alias(c) for c in COUNTS], rule.alias("rule"), failed.alias("base_failed"), (~failed & (rule == 0)).alias("kept")))
    return out.drop(raw), name


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, the counts, base_failed and kept of every document; nulls, long and empty texts, repeated rows and empty tables as in judged."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out, name = judged(docs, fit(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", *[F.col(name)[c].alias(c) for c in (*COUNTS[:5], "base_failed", "kept", "rule")])
