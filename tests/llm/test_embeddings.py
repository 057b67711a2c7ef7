import numpy as np

from psephos.llm import embeddings


def brute(rows, cosine=0.93):
    def sound(v, lab):
        return lab is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)

    ok = [sound(v, lab) for _, v, lab in rows]
    x = [np.array(v, np.float64) / np.linalg.norm(np.array(v, np.float64)) if o else None for (_, v, _), o in zip(rows, ok)]
    n, root = [0] * len(rows), list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if ok[i] and ok[j] and rows[i][2] == rows[j][2] and x[i] @ x[j] >= cosine:
                n[i] += 1
                n[j] += 1
                root[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        least[find(i)] = min(least.get(find(i), r[0]), r[0])
    return [(r[0], n[i], least[find(i)], r[0] == least[find(i)]) for i, r in enumerate(rows)]


def data():
    rng = np.random.default_rng(1)
    rows = []
    for _ in range(120):
        base = rng.standard_normal(64)
        for _ in range(rng.integers(1, 5)):
            rows.append((500 - len(rows), (base + 0.12 * rng.standard_normal(64)).astype(np.float32).tolist(), int(rng.integers(0, 2))))
    v = rows[0][1]
    rows += [(1000, v, rows[0][2]), (1001, v, None), (1002, None, 1), (1003, [0.0] * 64, 1), (1004, [None] + v[1:], 1), (1005, [float("nan")] + v[1:], 1), (1006, [float("inf")] + v[1:], 1), (1007, v, rows[0][2]), (1007, v, rows[0][2])]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(i, v, lab, 0) for i, v, lab in rows], "vec_id long, embedding array<float>, label int, node int").repartition(3)


def test_against_brute_force(spark):
    rows = data()
    got = sorted(map(tuple, embeddings.near_duplicates(frame(spark, rows)).collect()))
    assert got == sorted(brute(rows))
    assert embeddings.near_duplicates(frame(spark, rows[:1]).where("false")).count() == 0
    assert [tuple(r) for r in embeddings.near_duplicates(frame(spark, [(4, None, 1)])).collect()] == [(4, 0, 4, True)]


def test_long_runs_are_dealt_out(spark, monkeypatch):
    rows = data()
    rng = np.random.default_rng(3)
    base = rng.standard_normal(64)
    rows += [(2000 + i, (base + 0.05 * rng.standard_normal(64)).astype(np.float32).tolist(), 1) for i in range(150)]
    monkeypatch.setattr(embeddings, "BLOCK", 40)
    got = sorted(map(tuple, embeddings.near_duplicates(frame(spark, rows)).collect()))
    assert got == sorted(brute(rows))


def test_masks_cover_the_radius():
    rng = np.random.default_rng(2)
    for agree in (1, 2, 3):
        masks = embeddings.table_masks(64, 7, agree)
        for _ in range(300):
            d = sum(1 << int(b) for b in rng.choice(64, 7, replace=False))
            assert any(d & m == 0 for m in masks)


def test_recall_where_there_are_links(spark):
    """Pairs at cosines from 0.93 to 0.99, single ones and groups, among vectors without links; the recall is printed."""
    rng = np.random.default_rng(5)
    rows = []
    for k in range(1500):
        a, b = rng.standard_normal(64), rng.standard_normal(64)
        a /= np.linalg.norm(a)
        b -= (a @ b) * a
        b /= np.linalg.norm(b)
        c = rng.uniform(0.93, 0.99)
        rows += [(3 * k, (5 * a).tolist(), k % 3), (3 * k + 1, (c * a + np.sqrt(1 - c * c) * b).tolist(), k % 3), (3 * k + 2, rng.standard_normal(64).tolist(), k % 3)]
    base = rng.standard_normal(64)
    rows += [(9000 + i, (base + 0.2 * rng.standard_normal(64)).tolist(), 1) for i in range(200)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(4)
    x = np.array([v for _, v, _ in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    label = np.array([lab for *_, lab in rows])
    true = ((x @ x.T >= 0.93) & (label[:, None] == label)).sum(axis=1) - 1
    got = {r.vec_id: r.n_links for r in embeddings.near_duplicates(df).collect()}
    n = np.array([got[i] for i, *_ in rows])
    print("links", int(true.sum()), "found", int(n.sum()), "recall", n.sum() / true.sum())
    assert true.sum() > 3000 and (n <= true).all() and n.sum() >= 0.9 * true.sum()


def test_components_of_any_size_and_labels_of_any_type(spark):
    v = [1.0, 2.0, -3.0, 0.5]
    rows = [(1, [1e-200 * a for a in v], "x"), (2, [1e200 * a for a in v], "x"), (3, [5e-324, 0.0, 0.0, 0.0], "x"), (4, v, "y"), (5, [1e308, 1e308, -1e308, 1e308], "y")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")
    assert sorted(map(tuple, embeddings.near_duplicates(df).collect())) == [(1, 1, 1, True), (2, 1, 1, False), (3, 0, 3, True), (4, 0, 4, True), (5, 0, 5, True)]
    df = spark.createDataFrame([(1, v, 1.2), (2, v, 1.7), (3, v, 1.2)], "vec_id long, embedding array<double>, label double")
    assert sorted(map(tuple, embeddings.near_duplicates(df).collect())) == [(1, 1, 1, True), (2, 0, 2, True), (3, 1, 1, False)]
    long = spark.createDataFrame([(i, [float((i % 2 * 7 + k) % 13) for k in range(5000)], 0) for i in range(6)], "vec_id long, embedding array<double>, label int")
    assert [r.n_links for r in embeddings.near_duplicates(long).collect()] == [2] * 6


def test_links_on_the_whole_table(spark, sf):
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding, r.label) for r in df.collect()]
    assert sorted(map(tuple, embeddings.near_duplicates(df).collect())) == sorted(brute(rows))
