import random
import re

import numpy as np
from pyspark.sql import functions as F

from psephos.llm import quality


def brute(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines, dup = t.split("\n"), 0
    for i, line in enumerate(lines):
        dup += bool(re.search(r"[^\x20\x09-\x0D]", line)) and line in lines[:i]
    windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    hit = {k for i, x in enumerate(windows) if windows.count(x) > 1 for k in range(i, i + 8)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(hit)


def test_counts_against_brute_force():
    rnd = random.Random(1)
    texts = [None, "", " \n\t", "a", "é# x\n\né# x\n \n ", "a b " * 30]
    for _ in range(200):
        line = " ".join(rnd.choice(["a", "b", "é", "#x", "<|"]) for _ in range(rnd.randint(0, 12)))
        texts.append("\n".join(rnd.choice([line, line, " ", "c d", line + "x\v"]) for _ in range(rnd.randint(1, 8))))
    for t in texts:
        assert quality.count(t)[:5] == brute(t), t


def test_learns_conjunctions():
    rng = np.random.default_rng(1)
    x = rng.random((3000, len(quality.FEATURES)))
    bad = ((x[:, 0] > 0.7) & (x[:, 3] <= 0.4)) | (x[:, 5] > 0.95)
    rules = quality.learn(x, bad)
    out = np.zeros(len(x), bool)
    for r in rules:
        out |= quality._covers(r, x)
    assert (out == bad).mean() > 0.98
    assert quality.learn(x[:0], bad[:0]) == [] and quality.learn(x, np.zeros(len(x), bool)) == []


def test_column_says_what_the_rules_say(spark):
    rules = [(quality.Condition("symbols_per_word", True, 0.5), quality.Condition("words", False, 10.0)), (quality.Condition("upper_per_char", True, 0.3),)]
    texts = ["# # # a", "A B C D e", "plain words here", "", None, "# # # " * 9]
    df = spark.createDataFrame([(i, t, 5, "q") for i, t in enumerate(texts)], "doc_id long, text string, n_words int, quality string")
    out, name = quality.judged(df, rules)
    got = [r[name]["rule"] for r in out.orderBy("doc_id").collect()]
    counted = quality.with_counts(df.select("doc_id", "text"), "text", "c").orderBy("doc_id")
    x = np.array([list(r) for r in counted.select(*[f(lambda n: F.col("c")[n]).cast("double") for f in quality.FEATURES.values()]).collect()])
    want = [next((k + 1 for k, r in enumerate(rules) if quality._covers(r, x[i : i + 1])[0]), 0) for i in range(len(texts))]
    assert got == want
    assert set(got) == {0, 1, 2}, got
    assert out.columns == [*df.columns, name]
    assert quality.judged(df.where("false"), [])[0].count() == 0


def test_held_out_accuracy(spark, sf):
    sf = sf.replace("0.001", "0.01")
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rules = quality.fit(docs, labels.where("doc_id % 3 <> 0"))
    passed = lambda q: ~q["base_failed"]
    out, name = quality.judged(docs.join(labels.where("doc_id % 3 = 0"), "doc_id").withColumnRenamed("quality", "truth"), rules)
    rows = out.where(passed(F.col(name))).select("truth", F.col(name)["rule"].alias("rule")).collect()
    good = [r for r in rows if r.truth == 1]
    assert sum(r.rule == 0 for r in good) >= 0.98 * len(good)
    bad = [r for r in rows if r.truth == 0]
    assert bad and sum(r.rule > 0 for r in bad) >= 0.8 * len(bad)


def test_no_labels(spark):
    docs = spark.createDataFrame([(1, "a b"), (None, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, None), (None, 0), (9, 0)], "doc_id long, quality int")
    assert quality.fit(docs, labels) == []
