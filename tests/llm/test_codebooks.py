import hashlib
import math
import random

import duckdb
import numpy as np
import pytest

from psephos.llm import codebooks

SCHEMA = "vec_id long, embedding array<double>, label string, code string, q int"


def plain(rows, parts=8, entries=16, rounds=6):
    """Lists and loops: every distance of every part."""
    kept = [(i, [math.floor(4096 * x) for x in v], lab) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0], r[1]))
    width = len(kept[0][1]) // parts
    cut = [[q[p * width : (p + 1) * width] for p in range(parts)] for _, q, _ in kept]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]

    def assign():
        return [[min((sum((a - b) ** 2 for a, b in zip(c[p], e)), k) for k, e in enumerate(books[p])) for p in range(parts)] for c in cut]

    for _ in range(rounds):
        found = assign()
        for p in range(parts):
            for k in range(len(books[p])):
                own = [c[p] for c, f in zip(cut, found) if f[p][1] == k]
                if own:
                    books[p][k] = [sum(x) // len(own) for x in zip(*own)]
    found = assign()
    by = {}
    for (_, _, lab), f in zip(kept, found):
        by[lab] = by.get(lab, 0) + sum(d for d, _ in f)
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted((i, "".join(f"{k:02x}" for _, k in f), sum(d for d, _ in f), by[lab], sha) for (i, _, lab), f in zip(kept, found))


def result(spark, rows):
    df = spark.createDataFrame([(i, v, lab, "code", 3) for i, v, lab in rows], SCHEMA).repartition(3)
    coded, books = codebooks.compressed(df)
    out = codebooks.with_label_error(coded).collect()
    return sorted((r.vec_id, r.code, r.error, r.label_error, codebooks.digest(books)) for r in out)


def test_against_plain_loops(spark):
    rnd = random.Random(5)
    rows = [(i, [rnd.choice([rnd.gauss(0, 1), 0.25, -0.25]) for _ in range(16)], rnd.choice(["a", "b", None, ""])) for i in range(150)]
    rows += [(i, rows[i % 7][1], "copy") for i in range(150, 190)]  # copies, also among the first entries
    rows += [(400, None, "a"), (401, [0.1] * 15 + [None], "a"), (402, [float("nan")] * 16, "a"), (403, [float("-inf")] + [0.0] * 15, None), (404, [0.0] * 3, "a")]
    assert result(spark, rows) == plain([r for r in rows if r[0] != 404])


def test_ties_and_few_rows(spark):
    rows = [(2, [1.0] * 8, "x"), (1, [1.0] * 8, "x"), (3, [-1.0 / 8192] * 8, None)]
    assert result(spark, rows) == plain(rows)
    same = [(i, [0.5] * 8, None) for i in range(40)]
    assert result(spark, same) == plain(same)


def test_odd_lengths_large_components_and_empty_tables(spark):
    assert result(spark, []) == []
    assert result(spark, [(1, None, "a")]) == []
    assert [r[1] for r in result(spark, [(1, [], "a")])] == ["00" * 8]
    filled = result(spark, [(i, [float(i), 2.0, -3.0], "a") for i in range(20)])  # three components: five parts of zeros
    assert filled == plain([(i, [float(i), 2.0, -3.0] + [0.0] * 5, "a") for i in range(20)])
    far = result(spark, [(i, [1e300 if i % 2 else -1e300] * 8, None) for i in range(40)])
    assert len(far) == 40 and all(r[2] == 0 for r in far)
    spread = result(spark, [(i, [(i - 20) * 1e300] * 8, "far") for i in range(40)])
    assert all(0 <= r[2] <= r[3] <= codebooks.LONG_MAX for r in spread)
    assert [r[0] for r in codebooks.compressed(spark.createDataFrame([(None, [1.0] * 8, None, "", 1)], SCHEMA))[0].collect()] == [None]


def test_repeated_ids_and_rows(spark):
    rows = [(i % 9, [float((i * 7) % 5)] * 8, "ab"[i % 2]) for i in range(60)]
    got = result(spark, rows)
    assert len(got) == 60 and got == result(spark, rows[::-1])


def test_search_is_exact_and_bounded():
    rng = np.random.default_rng(2)
    middle = rng.integers(-4000, 4000, (32, 8))
    x = middle[rng.integers(0, 32, 5000)] + rng.integers(-200, 200, (5000, 8))
    apart = ((x[:, None] - middle[None]) ** 2).sum(axis=2)
    lists = codebooks.neighbours(middle)
    at, d, first = codebooks.nearest(x, middle, lists, np.zeros(5000, np.int64))
    assert (at == apart.argmin(axis=1)).all() and (d == apart.min(axis=1)).all()
    again = codebooks.nearest(x, middle, lists, at)
    assert (again[0] == at).all() and again[2] < first / 3 and again[2] < 5000 * 32 / 8  # from the right entry, few are looked at


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001"])
def test_query_against_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    want = con.execute(codebooks.OP11_SQL)
    names = [c[0] for c in want.description]
    got = codebooks.op11_vector_codes(spark, sf)
    assert sorted(map(tuple, got.select(names).collect())) == sorted(want.fetchall())
