import hashlib
import random
from collections import Counter

import corpus_pipeline as cp
from psephos.llm import simhash
from psephos.llm.common import written

KEY = hashlib.sha1(b"k").hexdigest()


def rows():
    rnd = random.Random(1)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 7)))
    texts = [" ".join(word() for _ in range(rnd.randint(40, 400))) for _ in range(60)]
    near = texts[0].split()
    near[20] = "changed"
    out = [(i, t, "en", f"src{i % 4}" if i % 5 else None, len(t), "x") for i, t in enumerate(texts)]
    out += [(100, texts[0], "en", "src0", 1, "x"), (101, " ".join(near), "en", "src1", 1, "x"), (102, "too short", "en", "src1", 9, "x"), (103, None, None, "src1", None, None), (104, f'{texts[1][:300]} {" ".join(word() for _ in range(90))} token = "{KEY}" end', "en", "src2", 9, "x")]
    return out


def test_stages(spark, sf):
    df = spark.createDataFrame(rows(), "doc_id long, text string, lang string, source string, n_chars long, quality string")
    given = df
    for k, (name, stage) in enumerate(cp.STAGES, 1):
        docs = written(stage(spark, df, sf), "t")
        ids = Counter(r.doc_id for r in docs.select("doc_id").collect())
        if k < len(cp.STAGES):
            assert docs.columns == given.columns
        if k == 1:
            assert set(ids) == {r[0] for r in rows()} - {102, 103}
        if k == 2:
            assert set(ids) == {r[0] for r in rows()} - {100, 101, 102, 103} and max(ids.values()) == 1
        if k == 3:
            text = {r.doc_id: r.text for r in docs.collect()}
            assert KEY not in text[104] and text[104].endswith('token = "[SECRET]" end')
            assert all(text[r[0]] == r[1] for r in rows() if r[0] in text and r[0] != 104)
        if k == 4:
            assert max(ids.values()) <= 2 and set(ids) <= {r[0] for r in rows()}
        if k == 5:
            whole = docs.groupBy("sequence_id").sum("length").collect()
            assert max(r[1] for r in whole) <= 4096
        df = docs
    assert stage(spark, given.where("false"), sf).count() == 0


def test_empty(spark, sf):
    df = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in cp.STAGES:
        out = stage(spark, df, sf)
        assert out.count() == 0


def test_near_duplicates_against_jaccard(spark, sf):
    rnd = random.Random(3)
    word = lambda: "".join(rnd.choice("abcdefghijklmnop") for _ in range(6))
    texts = []
    for k in range(60):  # one run replaced, on both sides of 0.8
        w = [word() for _ in range(400)]
        own, n = list(w), (34, 36, 38, 40, 41, 42, 44, 48, 60, 70)[k % 10]
        own[100 : 100 + n] = [word() for _ in range(n)]
        texts += [" ".join(w), " ".join(own)]
    line = " ".join(word() for _ in range(12))
    for _ in range(2):  # alike only by a line that is repeated
        texts.append(" ".join([line] * 60 + [word() for _ in range(60)]))
    more = [word() for _ in range(120)]  # alike but for how often a line is repeated
    texts += [" ".join([*more, *[line] * 2]), " ".join([*more, *[line] * 50])]
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (t.split() for t in texts)]
    root = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                root = [root[b] if r == root[a] else r for r in root]
    want = {min(i for i, r in enumerate(root) if r == own) for own in set(root)}
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    assert {r.doc_id for r in cp.near_duplicates(spark, df, sf).collect()} == want


def true_links(sets, least=0.8):
    """All pairs of sets with a Jaccard similarity of `least` or more, by an inverted list of all elements."""
    holders, out = {}, []
    for i, x in enumerate(sets):
        both = Counter(j for e in x for j in holders.get(e, ()))
        out += [(j, i) for j, n in both.items() if n >= least * (len(x) + len(sets[j]) - n) - 1e-9]
        for e in x:
            holders.setdefault(e, []).append(i)
    return out


def test_recall_on_a_whole_table(spark):
    """All documents of the table: links of 0.8 or more that the stage's groups hold, and documents that it drops without such a link; both are printed."""
    sf = "/root/testdata/sf0.01"
    df = spark.read.parquet(f"{sf}/documents.parquet")
    docs = [(r.doc_id, (r.text or "").encode().lower().split()) for r in df.select("doc_id", "text").collect()]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for _, w in docs]
    links = true_links(sets)
    group = {r.doc_id: r.component_id for r in simhash.near_duplicates(df, shingle=5, radius=7, segments=2, words=4, most=60, jaccard=0.8).collect()}
    held = sum(group[docs[a][0]] == group[docs[b][0]] for a, b in links)
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        root[find(a)] = find(b)
    least = {}
    for i, (d, _) in enumerate(docs):
        least[find(i)] = min(least.get(find(i), d), d)
    wrong = sum(group[d] != least[find(i)] for i, (d, _) in enumerate(docs))
    kept = {r.doc_id for r in cp.near_duplicates(spark, df, sf).collect()}
    dropped = sum(d not in kept and least[find(i)] == d for i, (d, _) in enumerate(docs))
    print("links", len(links), "held", held, "documents in another group than by all pairs", wrong, "dropped without a link", dropped)
    assert len(links) > 100 and held >= 0.98 * len(links) and dropped == 0 and wrong <= 0.01 * len(docs)
