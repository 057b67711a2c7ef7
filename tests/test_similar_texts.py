import random

import pytest
from pyspark.sql import functions as F

from psephos.operators import contests


def corpus(spark, n=120, seed=3, long=60, made=False):
    rnd = random.Random(seed)
    words = "measure council member judge county town school board proposition bond transit water district mayor yes no for against party harbor library".split()
    if made:
        words = ["".join(rnd.choice("abcdefghijklmnoprstuvw") for _ in range(rnd.randint(3, 9))) for _ in range(2000)]
    base = [(" ".join(rnd.choice(words) for _ in range(long // 8)), [" ".join(rnd.choice(words) for _ in range(long // 20)) for _ in range(3)]) for _ in range(n // 5)]
    rows = []
    for i in range(n):
        title, choices = rnd.choice(base)
        noise = rnd.choice([0, 0, 0.02, 0.05, 0.1])
        misread = lambda t: "".join(rnd.choice("xyz") if rnd.random() < noise else c for c in t)  # noqa: E731, B023
        k = rnd.randrange(3)
        own = [misread(c) for c in choices[k:] + choices[:k]]
        rows.append((i, rnd.choice([0, 0, 1]), misread(title), own if i % 17 else own[:2]))
    rows += [(n, 0, "", ["", ""]), (n + 1, 0, "", ["", ""]), (n + 2, 0, "a", ["b", "c"]), (n + 3, 0, "a", ["c", "b"]), (n + 4, 1, "title alone", []), (n + 5, 1, "title alone", [])]
    df = spark.createDataFrame(rows, "id long, block int, title string, choices array<string>").withColumn("n", F.size("choices"))
    return df.withColumn("size", F.aggregate("choices", F.lit(0), lambda s, t: s + F.length(t))), {i: (b, t, c) for i, b, t, c in rows}


def expanded(pairs, members):
    """Pairs of all texts, from pairs of distinct ones."""
    own = {}
    for r in members.collect():
        own.setdefault(r.rep, []).append(r.id)
    out = {(a, b, 0.0) for ids in own.values() for a in ids for b in ids if a < b}
    for r in pairs.collect():
        out |= {(min(a, b), max(a, b), round(r.distance, 9)) for a in own[r.a_id] for b in own[r.b_id]}
    return out


@pytest.mark.parametrize("most,q", [(0.02, None), (0.08, None), (0.08, 3), (0.2, None), (0.4, 1)])
def test_same_pairs_as_all_pairs(spark, most, q):
    df, _ = corpus(spark)
    own = df.where("n > 0")
    want = {(r.a_id, r.b_id, round(r.distance, 9)) for r in contests.pairs_in_blocks(own, ["block", "n"], most).collect()}
    pairs, members = contests.similar_pairs(own, ["block", "n"], most, q)
    assert expanded(pairs, members) == want and len(want) > 30
    assert members.count() == own.count()


def test_texts_are_classes(spark):
    df, rows = corpus(spark)
    kept, members = contests.text_classes(df, ["block", "n"])
    rep = {r.id: r.rep for r in members.collect()}
    turned = lambda c: min(tuple(c[k:] + c[:k]) for k in range(max(1, len(c))))
    same = {}
    for i, (b, t, c) in sorted(rows.items()):
        same.setdefault((b, t, turned(c)), i)
    assert rep == {i: same[b, t, turned(c)] for i, (b, t, c) in rows.items()}
    assert {r.id for r in kept.collect()} == set(rep.values())


def test_candidates_are_few(spark, monkeypatch):
    """Of long texts with few misread characters, the index joins a small part of all pairs."""
    from psephos.sources import io

    df, _ = corpus(spark, 300, long=160, made=True)
    counts, kept = {}, io.written

    def counted(t, name):
        counts[name] = kept(t, name)
        return counts[name]

    monkeypatch.setattr(io, "written", counted)
    contests.similar_pairs(df.where("n > 0"), ["block", "n"], 0.03)
    keys = counts["rare_runs"]
    n = counts["texts"].groupBy("block", "n").count().agg(F.sum(F.col("count") * (F.col("count") - 1) / 2)).first()[0]
    a, b = keys.alias("a"), keys.alias("b")
    on = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in ("block", "n", "run", "k")] + [F.col("a.id") < F.col("b.id")]
    met = a.join(b, on).select("a.id", "b.id").distinct().count()
    assert met < n / 4, (met, n)


def test_pairs_are_not_moved_where_the_index_rules_little_out(spark, monkeypatch):
    """Only texts are shuffled: pairs go neither through a distinct nor through joins by id."""
    monkeypatch.setattr(contests, "PIECE", 7)
    rows = [(k, k % 2, f"name {k % 13}", [f"one {k % 5}", f"two {k % 3}", f"three {k % 4}"]) for k in range(60)]
    df = spark.createDataFrame(rows, "id long, block int, title string, choices array<string>")
    df = df.withColumn("size", F.aggregate("choices", F.lit(0), lambda s, t: s + F.length(t)))
    pairs, members = contests.similar_pairs(df, ["block"], 0.18)
    text = pairs._jdf.queryExecution().executedPlan().toString()
    assert "Generate explode(runs" not in text and text.count("Join") <= 3
    reps = df.join(members.where("id = rep").select("id"), "id", "left_semi")
    want = contests.pairs_in_blocks(reps, ["block"], 0.18)
    key = lambda x: sorted((r.a_id, r.b_id, round(r.distance, 9)) for r in x.collect())
    assert key(pairs) == key(want) and len(key(pairs)) > 100


def plain_edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_edits_are_as_by_plain_loops():
    rnd = random.Random(1)
    word = lambda m: "".join(rnd.choice("abcé😀\0 ") for _ in range(rnd.randint(0, m)))
    x, y = [word(12) for _ in range(1500)] + ["", "", "a" * 300, "ab"], [word(9) for _ in range(1500)] + ["", "xyz", "b" * 200, ""]
    assert contests._edits(x, y).tolist() == [plain_edits(a, b) for a, b in zip(x, y)]
    a, b = ([tuple(word(5) for _ in range(4)) for _ in range(200)] for _ in range(2))
    assert contests._turned_edits(a, b).tolist() == [min(sum(plain_edits(p[i], q[(i + r) % 4]) for i in range(4)) for r in range(4)) for p, q in zip(a, b)]


def test_equal_titles_and_choices_are_compared_once(spark, monkeypatch):
    """Of 400 texts with 20 titles and 20 lists of choices there are 79,800 pairs, and at most 400 pairs of titles and 400 of lists to work out; no pair of texts meets an edit distance in the plan."""
    import pandas as pd

    own = pd.DataFrame([(20 * i + j, f"title no {i * i}", [f"one {j * j}", f"two {j}"]) for i in range(20) for j in range(20)], columns=["id", "title", "choices"])
    own["long"] = own["title"].str.len() + own["choices"].map(lambda c: sum(map(len, c)))
    n, plain = [], contests._edits
    monkeypatch.setattr(contests, "_edits", lambda x, y: n.append(len(x)) or plain(x, y))
    i, j, d = contests._near_of_two(own, own, 0.25, True)
    assert sum(n) <= 400 + 4 * 400 and (i < j).all()
    df = spark.createDataFrame(own[["id", "title", "choices"]]).selectExpr("cast(id as long) id", "title", "choices", "1 as block").withColumn("size", F.aggregate("choices", F.lit(0), lambda s, t: s + F.length(t)))
    monkeypatch.setattr(contests, "PIECE", 64)
    pairs, _ = contests.similar_pairs(df, ["block"], 0.25)
    assert "levenshtein" not in pairs._jdf.queryExecution().executedPlan().toString()
    got = {(r.a_id, r.b_id, round(r.distance, 9)) for r in pairs.collect()}
    assert got == {(r.a_id, r.b_id, round(r.distance, 9)) for r in contests.pairs_in_blocks(df, ["block"], 0.25).collect()}
    assert got == {(a, b, round(x, 9)) for a, b, x in zip(own["id"].to_numpy()[i], own["id"].to_numpy()[j], d)} and len(got) > 1000
