import numpy as np
import pytest

from psephos.operators import lloyd, ranking

SCHEMA = "g int, id long, x array<double>"


def plain_kmeans(x, k, rounds=200):
    if len(x) <= k:
        return list(range(len(x)))
    centres = x[[i * (len(x) - 1) // max(1, k - 1) for i in range(k)]]
    for _ in range(rounds):
        d = np.nansum((x[:, None] - centres[None]) ** 2, axis=2)
        c = d.argmin(axis=1)
        far = np.argsort(-d.min(axis=1), kind="stable")
        for n, e in enumerate(e for e in range(k) if not (c == e).any()):
            c[far[n]] = e
        new = np.array([np.round(np.nanmean(x[c == e], axis=0), 9) for e in range(k)])
        if np.array_equal(new, centres, equal_nan=True):
            break
        centres = new
    return c.tolist()


def plain_kmedoids(x, k, rounds=200):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    m = [i for i in range(len(x))] if len(x) <= k else [i * (len(x) - 1) // max(1, k - 1) for i in range(k)]
    for _ in range(rounds):
        c = d[:, m].argmin(axis=1)
        new = [min(np.flatnonzero(c == e), key=lambda i: (round(d[i, c == e].sum(), 9), i)) if (c == e).any() else m[e] for e in range(len(m))]
        if new == m:
            break
        m = new
    return c.tolist(), [int(m[e]) for e in c]


def groups(seed, nan=False):
    rng = np.random.default_rng(seed)
    out = {}
    for g, n in enumerate((1, 2, 3, 40, 300)):
        x = np.round(rng.standard_normal((n, 3)) + 5 * rng.integers(0, 3, (n, 1)), 6)
        if nan:
            x[rng.random(x.shape) < 0.05] = np.nan
        out[g] = x
    return out


@pytest.mark.parametrize("k", [1, 2, 3])
def test_kmeans_against_a_plain_one(spark, k):
    own = groups(k, nan=True)
    df = spark.createDataFrame([(g, i, r.tolist()) for g, x in own.items() for i, r in enumerate(x)], SCHEMA).repartition(5)
    got = {(r.g, r.id): r.cluster for r in lloyd.kmeans_in_groups(df, "g", k, "id", "x").collect()}
    assert got == {(g, i): c for g, x in own.items() for i, c in enumerate(plain_kmeans(x, k))}


def test_an_empty_cluster_gets_the_farthest(spark):
    x = np.array([[0.0, 0, 0]] * 4 + [[1.0, 0, 0], [9.0, 0, 0]])[[4, 0, 1, 2, 3, 5]]
    x = np.vstack([x, x[1:2]])  # seeds: the first, a middle one and a copy of it
    got = {r.id: r.cluster for r in lloyd.kmeans_in_groups(spark.createDataFrame([(1, i, r.tolist()) for i, r in enumerate(x)], SCHEMA), "g", 3, "id", "x").collect()}
    assert [got[i] for i in range(7)] == plain_kmeans(x, 3) and len(set(got.values())) == 3


def test_kmedoids_against_a_plain_one(spark, monkeypatch):
    monkeypatch.setattr(lloyd, "BLOCK", 32)  # pairs of blocks within a cluster
    own = groups(7)
    df = spark.createDataFrame([(g, i, r.tolist()) for g, x in own.items() for i, r in enumerate(x)], SCHEMA).repartition(5)
    got = {(r.g, r.id): (r.cluster, r.medoid) for r in lloyd.kmedoids_in_groups(df, "g", 2, "id", "x").collect()}
    assert got == {(g, i): z for g, x in own.items() for i, z in enumerate(zip(*plain_kmedoids(x, 2)))}


def test_empty_tables_and_rows_left_out(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert lloyd.kmeans_in_groups(empty, "g", 2, "id", "x").count() == 0 == lloyd.kmedoids_in_groups(empty, "g", 2, "id", "x").count()
    df = spark.createDataFrame([(None, 1, [1.0]), (1, 2, None), (1, 3, [1.0])], SCHEMA)
    assert [(r.id, r.cluster) for r in lloyd.kmeans_in_groups(df, "g", 2, "id", "x").collect()] == [(3, 0)]


def test_places_within_groups(spark):
    rng = np.random.default_rng(1)
    rows = [(int(g), int(i), [0.0]) for i, g in enumerate(rng.choice([0, 1, 1, 1, 2], 500))]
    got = {r.id: r.place for r in ranking.placed_within(spark.createDataFrame(rows, SCHEMA).repartition(7), ["g"], ["id"]).collect()}
    seen = {}
    for g, i, _ in rows:
        assert got[i] == seen.get(g, 0)
        seen[g] = seen.get(g, 0) + 1


@pytest.mark.parametrize("name", ["i2_kmeans_in_groups", "i3_kmedoids_in_groups"])
def test_queries_against_plain_ones(spark, sf, name):
    from psephos.plans.queries import QUERIES

    e = spark.read.parquet(f"{sf}/embeddings.parquet").orderBy("vec_id").collect()
    want = {}
    for label in {r.label for r in e}:
        own = [r for r in e if r.label == label]
        x = np.array([r.embedding for r in own], float)
        want |= {r.vec_id: c for r, c in zip(own, plain_kmeans(x, 2) if "means" in name else plain_kmedoids(x, 2)[0])}
    assert {r.vec_id: r.cluster for r in QUERIES[name](spark, sf).collect()} == want


def tables(monkeypatch):
    """(name, rows) of the tables that are written from now on."""
    found, own = [], lloyd.written

    def counted(df, name):
        out = own(df, name)
        found.append((name, out.count()))
        return out

    monkeypatch.setattr(lloyd, "written", counted)
    return found


def test_kmeans_rounds_are_a_pass_each(spark, monkeypatch):
    """A round of few centres writes nothing; centres of any number give the same."""
    x = np.round(np.random.default_rng(3).random((300, 4)), 6)
    df = spark.createDataFrame([(1, i, r.tolist()) for i, r in enumerate(x)], SCHEMA).repartition(5)
    found = tables(monkeypatch)
    got = {r.id: r.cluster for r in lloyd.kmeans_in_groups(df, "g", 2, "id", "x").collect()}
    assert [got[i] for i in range(300)] == plain_kmeans(x, 2) and len(found) <= 5
    monkeypatch.setattr(lloyd, "FEW", 0)
    assert got == {r.id: r.cluster for r in lloyd.kmeans_in_groups(df, "g", 2, "id", "x", rounds=60).collect()}


def test_kmedoids_leaves_settled_groups(spark, monkeypatch):
    own = groups(7)
    df = spark.createDataFrame([(g, i, r.tolist()) for g, x in own.items() for i, r in enumerate(x)], SCHEMA).repartition(5)
    found = tables(monkeypatch)
    lloyd.kmedoids_in_groups(df, "g", 2, "id", "x").count()
    rounds = [n for name, n in found if name == "assigned"]
    assert rounds[0] == sum(map(len, own.values())) > rounds[-1]


def test_distances_from_products():
    """Also of vectors that are far out, close to each other or equal."""
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.random((50, 8)), 100 + rng.random((50, 8)), 100 + 1e-6 * rng.random((50, 8))])
    x = np.concatenate([x, x[:20]])
    assert np.allclose(lloyd._apart(x, x), np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2)), rtol=1e-10, atol=0)
