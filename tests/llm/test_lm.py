import math
import re
import zlib
from collections import Counter, defaultdict
from functools import partial

import numpy as np
import pytest

from psephos.llm import lm

two, three = partial(lm.train, order=2), partial(lm.train, order=3)


def tokens(t):
    return [*re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in t or "")), None]


class Brute:
    def __init__(self, texts):
        self.one, self.two = Counter(), Counter()
        for t in texts:
            w = tokens(t)
            self.one.update(w)
            self.two.update(zip([0, *w], w))
        self.n, self.v = sum(self.one.values()), len(self.one)
        self.after, self.before = defaultdict(Counter), Counter(b for _, b in self.two)
        for (a, b), c in self.two.items():
            self.after[a][b] = c
        levels = lambda c: [sum(x == k for x in c.values()) for k in (1, 2, 3, 4)]
        self.d2, self.d1 = lm.discounts(*levels(self.two)), lm.discounts(*levels(self.before))

    def spread(self, counts, d):
        return sum(d[min(c, 3) - 1] for c in counts) / max(1, sum(counts))

    def p1(self, w):
        if not self.before:
            return 1 / (self.v + 1)
        c, total = self.before[w], sum(self.before.values())
        return (max(c - self.d1[min(c, 3) - 1], 0) if c else 0) / total + self.spread(self.before.values(), self.d1) / (self.v + 1)

    def p2(self, a, w):
        own = self.after.get(a)
        if not own:
            return self.p1(w)
        c = own[w]
        return (max(c - self.d2[min(c, 3) - 1], 0) if c else 0) / sum(own.values()) + self.spread(own.values(), self.d2) * self.p1(w)

    def score(self, t):
        w = tokens(t)
        return len(w), sum(self.one[x] > 0 for x in w), sum(math.log10((self.one[x] + 1) / (self.n + self.v + 1)) for x in w), sum(math.log10(self.p2(a, x)) for a, x in zip([0, *w], w))


class Brute3(Brute):
    def __init__(self, texts):
        super().__init__(texts)
        self.three = Counter()
        for t in texts:
            w = tokens(t)
            self.three.update(zip([0, 0, *w], [0, *w], w))
        self.adjusted = Counter((b, c) for _, b, c in self.three if b != 0)
        self.adjusted.update({(0, c): n for (_, b, c), n in self.three.items() if b == 0})
        self.middle, self.pair = defaultdict(Counter), defaultdict(Counter)
        for (a, b), n in self.adjusted.items():
            self.middle[a][b] = n
        for (a, b, c), n in self.three.items():
            self.pair[a, b][c] = n
        levels = lambda c: [sum(x == k for x in c.values()) for k in (1, 2, 3, 4)]
        self.d3, self.d2 = lm.discounts(*levels(self.three)), lm.discounts(*levels(self.adjusted))

    def part(self, own, w, d, lower):
        if not own:
            return lower
        c = own[w]
        return (max(c - d[min(c, 3) - 1], 0) if c else 0) / sum(own.values()) + self.spread(own.values(), d) * lower

    def p3(self, a, b, w):
        return self.part(self.pair.get((a, b)), w, self.d3, self.part(self.middle.get(b), w, self.d2, self.p1(w)))

    def score(self, t):
        w = tokens(t)
        return *super().score(t)[:3], sum(math.log10(self.p3(a, b, x)) for a, b, x in zip([0, 0, *w], [0, *w], w))


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(1)
    words = ["the", "The", "a", "é", "É", "x#", "of", "cat", "sat", " ", "mat"]
    out = [(i, " ".join(words[int(k)] for k in np.minimum(rng.geometric(0.3, rng.integers(0, 30)), 10))) for i in range(300)]
    return out + [(None, "the cat"), (7, None), (7, ""), (8, " \n"), (9, "a " * 3000)]


@pytest.mark.parametrize("plain,train", [(Brute, two), (Brute3, three)])
def test_against_brute_force(spark, rows, plain, train):
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, score string").repartition(3)
    brute = plain([t for i, t in rows if zlib.crc32(("" if i is None else str(i)).encode()) % 7 != 2])
    docs = df.select("doc_id", "text")
    model = train(docs.where(~lm.held_out()).select("text"))
    assert (model.tokens, model.words) == (brute.n, brute.v)
    got = sorted((str(r.doc_id), r.n_tokens, r.n_known, round(r.base_score, 6), round(r.score, 6)) for r in lm.score(docs, model).collect())
    want = sorted((str(i), *s[:2], round(s[2], 6), round(s[3], 6)) for i, t in rows for s in [brute.score(t)])
    assert got == want


def test_probabilities_sum_to_one(rows):
    brute = Brute([t for _, t in rows])
    for a in (0, "the", "mat", "never"):
        assert abs(sum(brute.p2(a, w) for w in [*brute.one, "never"]) - 1) < 1e-9
    brute = Brute3([t for _, t in rows])
    for a, b in ((0, 0), (0, "the"), ("the", "a"), ("never", "the"), ("the", "never")):
        assert abs(sum(brute.p3(a, b, w) for w in [*brute.one, "never"]) - 1) < 1e-9


@pytest.mark.parametrize("train", [two, three])
def test_nothing_to_learn_from(spark, train):
    df = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    model = train(df.where("false").select("text"))
    assert [(r.n_tokens, r.n_known, r.score) for r in lm.score(df, model).orderBy("doc_id").collect()] == [(3, 0, 0.0), (1, 0, 0.0)]
    assert lm.score(df.where("false"), model).count() == 0


def test_many_different_words(spark):
    """Buckets of many hashes, counts from 255 on, contexts of several kinds, in both orders."""
    rng = np.random.default_rng(2)
    texts = [" ".join(f"w{k}" for k in np.minimum(rng.zipf(1.3, 300), 4000)) for _ in range(120)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    for plain, train in ((Brute, two), (Brute3, three)):
        brute, model = plain(texts), train(df.select("text"))
        for r in lm.score(df, model).collect():
            assert abs(r.score - brute.score(texts[r.doc_id])[3]) < 1e-6
