import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from psephos.llm import divergence

SCHEMA = "lang string, source string, text string, term int, tb string"


def plain(rows, least=10, top=10):
    """All pairs of groups, term by term, in whole numbers of any size."""
    rows = [(a or "", b or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))) for a, b, t in rows]
    out = []
    for lang in {r[0] for r in rows}:
        docs, n, own = Counter(), Counter(), {}
        for a, source, words in rows:
            if a == lang:
                docs.update(set(words))
                n.update(words)
                own.setdefault(source, Counter()).update(words)
        kept = [t for t, c in docs.items() if c >= least]

        def share(c):
            total = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 2) // (total + 2 * len(kept)) for t in kept}

        p, q = {s: share(c) for s, c in own.items()}, share(n)
        f = lambda x, y: (x - y) ** 2 // (x + y)
        for s in own:
            pairs = [(-sum(f(p[s][t], p[o][t]) for t in kept), o.encode()) for o in own if o != s]
            terms = [(-f(p[s][t], q[t]), t.encode()) for t in kept if own[s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                out += [(lang, s, part, item.decode(), -v, k) for k, (v, item) in enumerate(sorted(found)[:most], 1)]
    return sorted(out)


def result(spark, rows, **options):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA).repartition(3)
    return sorted(map(tuple, divergence.audit(df, **options).collect()))


def corpus(n=160):
    rnd = random.Random(3)
    words = ["the", "The", "naïve", "x1y", "Ünder", "don't", "日本", "a_b", "Q"] + [f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(40)]
    rows = []
    for _ in range(n):
        lang, source = rnd.choice(["en", "fr", None, ""]), rnd.choice(["s0", "s0", "s0", "s1", "s2", "S2", "é", None, ""])
        rows.append((lang, source, " ".join(rnd.choice(words[: 9 + 5 * len(source or "")]) for _ in range(rnd.randint(0, 30)))))
    return rows + [("en", "none", None), ("en", "blank", " 12 3 "), ("few", "a", "one two"), ("few", "b", None), ("alone", "a", "x " * 50)] + [("en", "copy", "the same text")] * 30


def test_against_plain_loops(spark):
    rows = corpus()
    assert result(spark, rows) == plain(rows)
    assert result(spark, rows, least=1, top=3) == plain(rows, 1, 3)


def test_many_blocks(spark):
    """Blocks of two groups and three terms: pairs of blocks, tiles without a term of theirs, sums over tiles."""
    rows = corpus()
    assert result(spark, rows, group_block=2, term_block=3) == plain(rows)


def test_empty_and_long(spark):
    assert result(spark, []) == []
    long = "ab " * 400_000 + "c" * 1_500_000 + " ab"
    rows = [("en", "a", long), ("en", "b", "ab ab"), ("en", "b", "AB")] * 5
    assert result(spark, rows) == plain(rows)


def test_terms_are_cut_between_terms(monkeypatch):
    rnd = random.Random(1)
    monkeypatch.setattr(divergence, "STEP", 5)
    for _ in range(200):
        t = "".join(rnd.choice("aB1 é日-_`{@[") for _ in range(rnd.randint(0, 60)))
        want = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t)
        assert [w.decode() for some in divergence.terms(t.encode()) for w in some] == [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in want]


def test_shares_are_exact():
    rnd = random.Random(2)
    whole = [rnd.randint(4, 9 * 10**15) for _ in range(2000)]
    count = [rnd.randint(0, w - 2) for w in whole]
    got = divergence.shares(np.array(count), np.array(whole))
    assert got.tolist() == [1 + 10**9 * (c + 2) // w for c, w in zip(count, whole)]


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001"])
def test_query_against_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = con.execute(divergence.OP12_SQL)
    names = [c[0] for c in want.description]
    got = divergence.op12_source_divergence(spark, sf)
    assert sorted(map(tuple, got.select(names).collect())) == sorted(want.fetchall())
