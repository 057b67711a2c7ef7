import random

import duckdb
import pandas as pd
from pyspark.sql import functions as F

from psephos.llm import mixing, url_filter
from psephos.llm.common import n_words


def docs():
    rnd = random.Random(1)
    rows = [(i, " ".join("w" * rnd.randint(1, 3) for _ in range(rnd.choice([0, 1, 30, 400]))), rnd.choice(["a", "b", "é", None, "hot", "hot", "hot"])) for i in range(400)]
    return rows + [(5, "one two", "a"), (5, "one two", "a"), (None, "x y z", "z"), (900, None, "none")]


def test_mix_against_sql(spark):
    frame = pd.DataFrame(docs(), columns=["doc_id", "text", "source"]).astype({"doc_id": "Int64"})
    df = spark.createDataFrame(docs(), "doc_id long, text string, source string").withColumn("size", F.lit(3)).repartition(4)
    got = mixing.mix(df.drop("size"), n_words("text")).collect()
    con = duckdb.connect()
    con.register("documents", frame)
    want = con.execute(mixing.OP1_SQL).fetchall()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    by = {}
    for r in got:
        assert 0 <= r.taken <= 2 * r.size
        by.setdefault((r.source_size, r.target), [0])[0] += r.taken
    assert all(t - 1 < n <= t + 1e-6 for (_, t), (n,) in by.items() if t)
    assert abs(sum(t for _, t in by) - 1.5 * sum(r.size for r in got)) < 1e-6
    assert mixing.mix(df.where("false"), n_words("text")).count() == 0


def test_mixed_keeps_rows_and_columns(spark):
    df = spark.createDataFrame(docs(), "doc_id long, text string, source string").withColumn("mix_size", F.lit(3)).withColumn("taken", F.lit("q"))
    out = mixing.mixed(df)
    assert out.columns == df.columns
    known = {(r.doc_id, r.text, r.source) for r in df.collect()}
    rows = out.collect()
    assert rows and all((r.doc_id, r.text, r.source) in known for r in rows)
    assert abs(sum(len((r.text or "").split()) for r in rows) / (1.5 * sum(len((t or "").split()) for _, t, _ in docs())) - 1) < 0.1


URLS = [(1, "http://a.com/en/1"), (2, "http://A.EXAMPLE.com/en/77?x"), (3, "https://example.net/de/8#x"), (4, "x://example.net/de/"), (5, "http://xexample.net/de/8"), (6, None), (7, "no scheme"), (8, "http://a.com"), (9, "http://b.org/es/"), (10, "http://b.org/"), (1, "http://a.com/en/1"), (11, "://://c.com/en/"), (12, "http://a.com/zz\n/q"), (13, "http://" + "long." * 5000 + "com/en/" + "x" * 50_000)]


def brute_rule(host, path):
    fits = [r for r in url_filter.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fits, key=lambda r: len(r.text), default=None)


def test_urls_against_sql_and_rules(spark, monkeypatch):
    df = spark.createDataFrame([(*u, "q") for u in URLS], "page_id long, url string, host string")
    con = duckdb.connect()
    con.register("pages", pd.DataFrame(URLS, columns=["page_id", "url"]))
    want = sorted(map(str, con.execute(url_filter.OP2_SQL).fetchall()))
    got = url_filter.judge_urls(df).collect()
    assert sorted(map(str, map(tuple, got))) == want
    for r in got:
        rule = brute_rule(r.host, r.path)
        assert r.rule == (rule and rule.text) and (rule is None or r.verdict == rule.action)
    assert sorted(map(str, map(tuple, url_filter.judge_urls(df, most_bytes=8).collect()))) == want  # a cascade for each part
    assert url_filter.judge_urls(df.where("false")).count() == 0


def test_cascade_is_exact(spark):
    rnd = random.Random(2)
    keys = [(f"host{i}.example", rnd.random() < 0.2) for i in range(20_000)]
    df = spark.createDataFrame(keys, "key string, is_listed boolean")
    for rate in (0.02, 0.5):
        levels = url_filter.build_cascade(df, "key", "is_listed", rate=rate)
        assert len(levels) == 1 and len(levels[0]) > 1
        assert url_filter.listed_by_cascade(df, "key", levels, "found").where("found <> is_listed").count() == 0
    assert url_filter.build_cascade(df.withColumn("is_listed", F.lit(False)), "key", "is_listed") == [[]]
    parts = url_filter.build_cascade(df, "key", "is_listed", most_bytes=1500)
    assert len(parts) > 2 and all(level.bits <= 8 * 1500 for levels in parts for level in levels)
    assert url_filter.listed_by_cascade(df, "key", parts, "found").where("found <> is_listed").count() == 0


def test_many_rules():
    rnd = random.Random(5)
    label = lambda: rnd.choice(["a", "b", "cc", "d", "com", "org"])
    rules = tuple({(h, p): url_filter.Rule(rnd.choice(["block", "allow"]), h, p) for h, p in ((".".join(label() for _ in range(rnd.randint(1, 3))), "/" * rnd.randint(0, 1) + rnd.choice(["", "x", "xy", "y/"])) for _ in range(30_000))}.values())
    paths = {}
    for r in sorted(rules, key=lambda r: -len(r.path)):
        paths.setdefault(r.host, []).append(r)
    for _ in range(500):
        host, path = ".".join(label() for _ in range(rnd.randint(0, 4))), "/" + rnd.choice(["", "x", "xyz", "y/1", "z"])
        fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        assert url_filter.fitting(host, path, paths) == max(fits, key=lambda r: (len(r.text), len(r.host)), default=None)


def test_repeated_rows_share_what_is_taken(spark):
    """Copies under one id do not multiply the mix, and columns of any name stay."""
    df = spark.createDataFrame([(1, "a b c d", "s", 1)] * 10 + [(None, "x y", "s", 2)] * 5 + [(2, "long " * 40, "t", 3)], "doc_id long, text string, source string, mix_times int")
    out = mixing.mixed(df).collect()
    words = sum(len(r.text.split()) for r in out)
    assert words <= 1.5 * 90 + 40 and all(r.mix_times in (1, 2, 3) for r in out)
    plain = {(r.doc_id, r.size): 0 for r in mixing.mix(df, n_words("text"), whole=True).collect()}
    for r in mixing.mix(df, n_words("text"), whole=True).collect():
        plain[r.doc_id, r.size] += r.taken // max(1, r.size)
    for (i, size), n in plain.items():
        assert sum(r.doc_id == i and len(r.text.split()) == size for r in out) == n
