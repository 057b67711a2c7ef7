import random

import numpy as np
import xxhash

from pyspark.sql import functions as F

from psephos.llm import simhash
from psephos.llm.common import components, forest


def brute_print(text, k=4):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + k]), 42) for i in range(max(1, len(w) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints, most=4):
    """prints: [(doc_id, fingerprint)]"""
    root = {i: i for i in range(len(prints))}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i][1] ^ prints[j][1]).bit_count() <= most:
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(prints):
        ids = [x for x in (least.get(find(i)), d) if x is not None]
        least[find(i)] = min(ids) if ids else None
    return [least[find(i)] for i in range(len(prints))]


def test_masks_cover_every_pair_within_the_radius():
    rnd = random.Random(1)
    for radius, segments in ((4, 1), (12, 3)):
        masks = simhash.all_masks(radius, segments)
        for _ in range(3000):
            d = sum(1 << b for b in rnd.sample(range(64), rnd.randint(0, radius)))
            assert any(d & m == 0 for m in masks)


def test_sketch():
    for t in ("", " \n", "a", "A b", "The quick brown fox jumps over the lazy dog " * 9, "É é ß x y z Q"):
        assert simhash.sketch(t, 4) == brute_print(t)
        assert simhash.sketch(t, 4, at_once=3) == brute_print(t)


def test_set_sketch():
    """Equal sets of shingles have equal hashes, however the text is cut; bits are majorities over the set."""
    rnd = random.Random(8)
    for _ in range(40):
        w = [rnd.choice(["a", "bb", "ccc", "d", "É", "e" * 30]) for _ in range(rnd.choice([0, 1, 4, 5, 6, 400]))]
        text = " ".join(w)
        shingles = {tuple(x.encode().lower() for x in w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
        h = simhash.shingle_set(text, 5)
        assert len(h) == len(shingles) and (np.diff(h.astype(object)) > 0).all()
        assert h.tolist() == simhash.shingle_set(f"  {text.upper() if text.isascii() else text}\n", 5, at_once=3).tolist()
        assert all(x in h for x in simhash.shingle_set(" ".join(w[:7]), 5)) or len(w) < 5
        wide = simhash.set_sketch(h, 4)
        mixed = []
        for x in h.tolist():
            row = []
            for k in range(4):
                y = x * int(simhash._WORDS[k]) % 2**64
                y = (y ^ y >> 29) * 0xBF58476D1CE4E5B9 % 2**64
                row.append(y ^ y >> 32)
            mixed.append(row)
        assert wide[:4].tolist() == [sum(1 << b for b in range(64) if 2 * sum(r[k] >> b & 1 for r in mixed) > len(mixed)) for k in range(4)]
        assert wide.tolist()[4] == simhash.set_sketch(np.unique(h), 0)[0]


def docs(spark):
    rnd = random.Random(2)
    word = lambda: "".join(rnd.choice("abcdef") for _ in range(5))
    rows = []
    for base in range(25):
        w = [word() for _ in range(rnd.choice([3, 40, 300]))]
        for _ in range(rnd.randint(1, 6)):
            own = list(w)
            for _ in range(rnd.randint(0, 3)):
                own[rnd.randrange(len(own))] = word()
            rows.append((1000 - len(rows), " ".join(own)))
    rows += [(5, None), (4, ""), (3, " \t"), (None, rows[0][1]), (None, "alone here with no id at all"), (7, rows[3][1]), (7, rows[3][1])]
    return rows, spark.createDataFrame([(i, t, "x", 1, 2) for i, t in rows], "doc_id long, text string, node string, root int, n int")


def test_against_brute_force(spark, monkeypatch):
    rows, df = docs(spark)
    prints = [(i, brute_print(t)) for i, t in rows]
    want = sorted((str(i), f"{p:016x}", str(c)) for (i, p), c in zip(prints, brute_components(prints)))
    got = simhash.near_duplicates(df).collect()
    assert sorted((str(r.doc_id), f"{r.w0 & (1 << 64) - 1:016x}", str(r.component_id)) for r in got) == want
    assert simhash.near_duplicates(df.where("false")).count() == 0


def roots(nodes, comps):
    """Least node of each node's component; comps: (node, root) of the nodes that are not their own root."""
    at = {r.node: r.root for r in comps}
    groups = {}
    for x in nodes:
        groups.setdefault(at.get(x, x), []).append(x)
    least = {k: min(own) for k, own in groups.items()}
    return [least[at.get(x, x)] for x in nodes]


def test_heavy_keys_are_dealt_out_whole(spark, monkeypatch):
    """One dense group, chained, and a second group that meets the first under the same keys; the limits force blocks and the comparison of what lies outside."""
    rnd = random.Random(4)
    base, rows = rnd.getrandbits(64), []
    for _ in range(700):
        x = base
        for b in rnd.sample(range(64), rnd.randint(0, 3)):
            x ^= 1 << b
        rows.append(x)
    other = base ^ 0b1111111100000000
    rows += [other ^ 1 << b for b in range(60)]
    rows = sorted(set(rows + [rnd.getrandbits(64) for _ in range(300)]))
    nodes = [simhash.signed(x) for x in rows]
    df = spark.createDataFrame([(x,) for x in nodes], "node long").repartition(5)
    ids = brute_components([(simhash.signed(x), x) for x in rows])
    for block in (4096, 60, 7):
        monkeypatch.setattr(simhash, "BLOCK", block)
        assert roots(nodes, simhash.proposed(df, ["node"], 4, 4).collect()) == ids


def test_heavy_groups_of_sets(spark, monkeypatch):
    """Jaccard links within one group of proposals, dealt out in blocks or not, against all pairs."""
    rnd = random.Random(5)
    base = [rnd.getrandbits(62) for _ in range(40)]
    sets = [sorted({*rnd.sample(base, rnd.choice([30, 34, 36, 38])), *[rnd.getrandbits(62) for _ in range(rnd.randint(0, 4))]}) for _ in range(90)]
    want = list(range(len(sets)))
    for a in range(len(sets)):
        for b in range(a):
            x, y = set(sets[a]), set(sets[b])
            if 5 * len(x & y) >= 4 * len(x | y):
                want = [min(want[a], want[b]) if r in (want[a], want[b]) else r for r in want]
    assert 2 < len(set(want)) < len(want)
    df = spark.createDataFrame([(7, i, bytearray(np.array(x, np.uint64).tobytes())) for i, x in enumerate(sets)], "key long, node long, hashes binary").repartition(3)
    for limit in (1 << 21, 1000, 300):
        found = simhash.linked(df, ["hashes"], simhash.Similar(0.8), limit, "t", F.octet_length("hashes") / 8)
        assert roots(list(range(len(sets))), found.collect()) == want


def test_components(spark):
    rnd = random.Random(6)
    chain = [(i, i + 1) for i in range(200)]
    hub = [(1000, 1000 + i) for i in range(1, 300)]
    more = [(rnd.randint(2000, 2400), rnd.randint(2000, 2400)) for _ in range(250)]
    edges = chain + hub + more + [(5, 5)]
    rnd.shuffle(edges)
    out = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long").repartition(6)).collect()}
    nodes = sorted({x for e in edges for x in e})
    at = {x: i for i, x in enumerate(nodes)}
    root = forest(len(nodes), np.array([at[a] for a, _ in edges]), np.array([at[b] for _, b in edges]))
    assert all(out.get(x, x) == nodes[root[i]] for i, x in enumerate(nodes))


def test_one_of_each(spark):
    rows, df = docs(spark)
    rows = rows + [(1000, "another text under an id that is taken " * 5), (1000, "another text under an id that is taken " * 5)]
    df = spark.createDataFrame([(i, t, "x", 1, 2) for i, t in rows], "doc_id long, text string, node string, kept_id int, w0 int")
    prints = [(i, brute_print(t)) for i, t in rows]
    parts = {}
    for (i, t), (_, p) in zip(rows, prints):
        parts.setdefault(p, []).append((i, t))
    roots = sorted(parts)
    root = list(range(len(roots)))
    for x in range(len(roots)):
        for y in range(x):
            if (roots[x] ^ roots[y]).bit_count() <= 4:
                a, b = root[x], root[y]
                root = [b if r == a else r for r in root]
    groups = {}
    for r, p in zip(root, roots):
        groups.setdefault(r, []).extend(parts[p])
    want = []
    for own in groups.values():
        ids = [i for i, _ in own if i is not None]
        least = min(ids) if ids else None
        want.append((least, min((t for i, t in own if i == least), key=lambda t: (t is not None, t or ""))))
    for most in (2_000_000, 0):
        out = simhash.one_of_each(df, shingle=4, radius=4, most_gone=most)
        assert out.columns == df.columns
        assert sorted(map(str, ((r.doc_id, r.text) for r in out.collect()))) == sorted(map(str, want))
    wide = simhash.one_of_each(df, shingle=5, radius=12, words=4, most=39, segments=3).collect()
    assert 0 < len(wide) < len(rows)
