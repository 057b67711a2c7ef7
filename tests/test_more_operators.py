"""Fixed examples, worked out by hand from the definitions, and plain versions of operators on pixels, lines and groups."""

import itertools
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from psephos.operators import boxes, cluster, contests, decoders, grouping, layout, patches, pixels, ranking
from psephos.sources import io


def test_target_must_lie_in_its_contest(spark):
    """Each side is eased by a tenth of the target's own size, rounded; the first contest wins."""
    c = spark.createDataFrame([(1, 2, 0, 0, 100, 100), (1, 3, 0, 0, 200, 200)], "g int, contest_id int, x int, y int, w int, h int")
    t = spark.createDataFrame([(1, 1, 90, 10, 11, 5), (1, 2, 91, 10, 11, 5), (1, 3, -1, 10, 15, 5), (1, 4, -3, 10, 15, 5), (1, 5, 10, 10, 4, 4), (1, 6, 98, 10, 4, 4)], "g int, target_id int, x int, y int, w int, h int")
    # 90 + 11 - 1 = 100 is inside; 91 + 11 - 1 is not, and goes to the larger one; 15 is eased by round(1.5) = 2, 4 by none
    assert {r.target_id: r.contest_id for r in layout.assign_targets(t, c, ["g"]).collect()} == {1: 2, 2: 3, 3: 2, 4: None, 5: 2, 6: 3}


def test_adjacent_contests(spark):
    rows = {1: (0, 0, 100, 50), 2: (0, 55, 100, 50), 3: (100, 105, 50, 20), 4: (300, 0, 10, 10), 5: (0, 66, 100, 50)}
    df = spark.createDataFrame([(1, k, *v) for k, v in rows.items()], "g int, contest_id int, x int, y int, w int, h int")
    # 1-2: 5 apart, under 10; 1-5: 16 apart; 2-3: 2 ends at 105 where 3 begins, and their sides touch at 100; 2-5: 2 begins first and ends at 105, 39 from 66; 5-3: side by side at 100
    assert {(r.a_id, r.b_id) for r in layout.adjacent(df, ["g"]).collect()} == {(1, 2), (2, 3), (3, 5)}


def test_phrases_inside_a_text(spark):
    given = {"x Party Preferense: Republicen y": "x Party Preference: Republican y", "Party Preference:  Democratic": "Party Preference: Democratic", "Party Pref: Republican": "Party Pref: Republican", "MEMBR OF THE STATE ASSEMBLY": "MEMBER OF THE STATE ASSEMBLY", "OF THE": "OF THE", "": ""}
    df = spark.createDataFrame([(k,) for k in given], "x string")
    assert {r.x: r.y for r in df.select("x", contests.fix_phrases(F.col("x")).alias("y")).collect()} == given


def test_levels_of_bars():
    # ten bins of 0.1 from 0 to 1: the two fullest are the first and the last
    assert pixels.two_levels(np.array([0.0] * 5 + [0.45] * 3 + [1.0] * 6)) == pytest.approx((0.05, 0.95))
    # both fullest bins may lie in one half
    assert pixels.two_levels(np.array([0.0, 0.62, 0.63, 0.64, 0.81, 0.82, 1.0])) == pytest.approx((0.65, 0.85))
    # empty bins 1 to 8 and the middle one of them is 5; narrow is a lower edge, wide an upper one
    assert pixels.narrow_wide([2, 2, 2, 7, 7]) == pytest.approx((2.0, 7.0))
    assert pixels.narrow_wide([2, 3, 3, 7, 8, 8]) == pytest.approx((2.6, 8.0))


@pytest.mark.parametrize("seed", range(3))
def test_readers_of_drawn_codes(seed):
    rnd = random.Random(seed)
    code = "".join(rnd.choice("0123456789") for _ in range(12))
    code += next(f"{k:02d}" for k in range(100) if decoders.checks(f"{code}{k:02d}"))
    image = decoders.interleaved_image(code)
    assert decoders.hart(image) == (code, False) and decoders.hart(pixels.flip(image)) == (code, True)
    torn = image.copy()
    torn[:18] = 1  # half of the strips hold no code
    assert decoders.hart(torn) == (code, False)
    assert decoders.hart(np.ones((40, 300))) == (None, False)
    wrong = decoders.interleaved_image(f"{code[:12]}{(int(code[12:]) + 1) % 100:02d}")
    assert decoders.hart(wrong) == (None, False)  # the check number is not right, whatever the strips
    bits = "".join(rnd.choice("01") for _ in range(10))
    assert decoders.timing(decoders.timing_image(bits), 10, 4, 6) == bits and decoders.timing(decoders.timing_image(bits), 11, 4, 6) is None
    assert decoders.marks_in_row(decoders.row_image(f"1{bits}1"), 12, 5, 3) == f"1{bits}1" and decoders.marks_in_row(decoders.row_image(f"1{bits}0"), 12, 5, 3) is None
    assert decoders.side_bits(decoders.side_image(bits), *decoders.tall_and_short(), 10) == bits


def test_images_of_several_kinds():
    a = np.random.default_rng(1).integers(0, 256, (5, 7))
    assert (io.decoded(io.png(a)) == a).all()
    assert (io.decoded(b"P5\n# made by hand\n7 5\n255\n" + a.astype(np.uint8).tobytes()) == a).all()
    rows = b"".join(bytes(np.repeat(r, 3).astype(np.uint8)) + b"\0" * 3 for r in a[::-1])
    head = b"BM" + (54 + len(rows)).to_bytes(4, "little") + bytes(4) + (54).to_bytes(4, "little") + (40).to_bytes(4, "little") + (7).to_bytes(4, "little") + (5).to_bytes(4, "little") + (1).to_bytes(2, "little") + (24).to_bytes(2, "little") + bytes(24)
    assert (io.decoded(head + rows) == a).all()
    for bad in (b"", b"\xff\xd8\xff", b"P5\n2 2\n65535\n"):
        with pytest.raises(ValueError):
            io.decoded(bad)


def test_png_filters():
    """Every line filter, against a plain reading of the definition."""
    rng = np.random.default_rng(2)
    a = rng.integers(0, 256, (5, 6, 3))
    raw = b""
    for y in range(5):
        line = []
        for x, c in itertools.product(range(6), range(3)):
            left, up, corner = (int(a[y, x - 1, c]) if x else 0), (int(a[y - 1, x, c]) if y else 0), (int(a[y - 1, x - 1, c]) if x and y else 0)
            guess = left + up - corner
            nearest = min((left, up, corner), key=lambda v: abs(v - guess))
            line.append((int(a[y, x, c]) - (0, left, up, (left + up) // 2, nearest)[y]) % 256)
        raw += bytes([y, *line])
    chunk = lambda kind, own: len(own).to_bytes(4, "big") + kind + own + bytes(4)
    png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", (6).to_bytes(4, "big") + (5).to_bytes(4, "big") + bytes([8, 2, 0, 0, 0])) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")
    assert (io.decoded(png) == np.round(a @ np.array([0.299, 0.587, 0.114]))).all()


def test_read_images_from_files(spark, tmp_path):
    a = np.random.default_rng(3).integers(0, 256, (4, 4))
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "one.PNG").write_bytes(io.png(a))
    (tmp_path / "bad.png").write_bytes(b"no image")
    (tmp_path / "notes.txt").write_text("x")
    rows = {r.image_path.rsplit("/", 1)[1]: r for r in io.grey_images(io.read_images(spark, str(tmp_path)), scaled=True).collect()}
    assert set(rows) == {"one.PNG", "bad.png"} and rows["bad.png"].status == "err" and rows["bad.png"].patch is None
    assert np.allclose(patches.unpack(rows["one.PNG"].patch.asDict()), a / 255)


@pytest.mark.parametrize("mode", ["mid", "kmeans", "pca", "kmeans2", "kmedoids"])
def test_splits(spark, mode):
    rng = np.random.default_rng(1)
    rows = [("g", i, (rng.random(9) * 0.1 + (i >= 6) * np.eye(9)[4] * 3).tolist()) for i in range(10)] + [("two", 1, [0.0] * 9), ("two", 2, [0.0] * 9), ("one", 1, [0.0] * 9)]
    df = spark.createDataFrame(rows, "label string, vec_id long, embedding array<double>")
    out = {}
    for r in cluster.split(df, "label", "vec_id", mode).collect():
        out.setdefault((r.label, r.cluster), []).append(r.vec_id)
    want = [0, 1, 2, 3, 4] if mode == "mid" else [0, 1, 2, 3, 4, 5]
    assert sorted(out["g", 0]) == want and len(out["g", 1]) == 10 - len(want)
    assert out["two", 0] == [1] and out["two", 1] == [2] and out["one", 0] == [1]
    parts = cluster.split(df, "label", "vec_id", mode, most=4).where("label = 'g'")
    assert {r.part: r["count"] for r in parts.groupBy("part").count().collect()} == {0: 4, 1: 4, 2: 2}


def test_ranked_lists(spark):
    rows = [("a", 1, ["x", "y", "p"]), ("a", 2, ["x", "y", "q"]), ("a", 3, ["x", "y", "q"]), ("b", 1, ["x", "y"]), ("b", 2, ["x", "y"]), ("b", 3, ["x", "y"]), ("c", 1, ["x", "y"]), ("c", 2, ["z", "w"]), ("d", 1, ["x", "y"]), ("d", 2, ["x"]), ("e", 1, ["p", "y"]), ("e", 2, ["q", "y"])]
    df = spark.createDataFrame(rows, "g string, k int, labels array<string>")
    out = {(r.g, r.k): r.part for r in grouping.split_ranked(df, "g", "k").collect()}
    assert [out["a", i] for i in (1, 2, 3)] == ["p", "q", "q"]  # after the two that all share
    assert [out["b", i] for i in (1, 2, 3)] == ["first", "first", "second"]  # all alike
    assert [out["c", i] for i in (1, 2)] == ["y", "w"]  # none shared: the second label
    assert [out["d", i] for i in (1, 2)] == [None, None]  # a list of one label
    assert [out["e", i] for i in (1, 2)] == ["first", "second"]  # one part only


def test_colouring(spark):
    k4 = [(1, a, b) for a, b in itertools.combinations(range(4), 2)]
    nodes = spark.createDataFrame([(1, i) for i in range(4)] + [(2, i) for i in range(6)] + [(3, 0)], "g int, id long")
    ring = [(2, i, (i + 1) % 6) for i in range(6)]
    edges = spark.createDataFrame(k4 + ring, "g int, a_id long, b_id long")
    out = {(r.g, r.id): r.colour for r in grouping.coloured(nodes, edges, "g").collect()}
    assert len(out) == 11 and all(out[g, a] != out[g, b] for g, a, b in k4 + ring) and out[3, 0] == 0
    assert all(r.colour is None for r in grouping.coloured(nodes, edges, "g", 3).where("g = 1").collect())


def test_components_of_pairs(spark):
    rnd = random.Random(3)
    pairs = [(i, i + 1) for i in range(40)] + [(rnd.randint(100, 200), rnd.randint(100, 200)) for _ in range(60)]
    root = {x: x for p in pairs for x in p}
    for a, b in pairs * len(pairs):
        root[a] = root[b] = min(root[a], root[b])
    assert {r.node: r.root for r in grouping.components(spark.createDataFrame(pairs, "a long, b long")).collect()} == root


def test_equivalence_classes_do_not_depend_on_blocks(spark):
    """Components of near pairs, each clustered by itself, against one clustering of all texts."""
    rnd = random.Random(4)
    base = ["MEMBER OF THE COUNCIL", "JUDGE OF THE COURT", "MAYOR", "MEMBER OF THE COUNTY"]
    rows = []
    for i in range(40):
        title = list(rnd.choice(base))
        for _ in range(rnd.randint(0, 4)):
            title[rnd.randrange(len(title))] = rnd.choice("ABCXYZ")
        rows.append((i, "eng", "".join(title), [rnd.choice(["YES", "YEZ"]), "NO"]))
    df = spark.createDataFrame(rows, "id long, language string, title string, choices array<string>")
    got = {r.id: r["class"] for r in contests.equivalence_classes(df).collect()}
    sized = df.withColumn("block", F.lit(0)).withColumn("size", F.length(F.array_join("choices", "")))
    pairs = contests.pairs_in_blocks(sized, ["block"], 1.0).select(F.lit(0).alias("block"), "a_id", "b_id", (F.col("distance") / 0.2).alias("distance"))
    want = {r.id: r.cluster for r in contests.agglomerate(pairs, sized.select("block", "id"), "block", 1.0).collect()}
    assert got == want and 1 < len(set(got.values())) < 40


def plain_agglomerate(d, n, linkage):
    at = list(range(n))
    for _, a, b in sorted((x, a, b) for (a, b), x in d.items()):
        x, y = at[a], at[b]
        if x != y:
            own = [[i for i in range(n) if at[i] == z] for z in (x, y)]
            if np.mean([d[min(p, q), max(p, q)] for p in own[0] for q in own[1]]) < linkage:
                at = [min(x, y) if z in (x, y) else z for z in at]
    return at


def test_agglomerate_by_running_sums(spark):
    rnd = random.Random(6)
    d = {p: rnd.random() for p in itertools.combinations(range(25), 2)}
    ids = spark.createDataFrame([(0, i) for i in range(25)], "block int, id long")
    pairs = spark.createDataFrame([(0, a, b, x) for (a, b), x in d.items()], "block int, a_id long, b_id long, distance double")
    for linkage in (0.3, 0.45):
        got = {r.id: r.cluster for r in contests.agglomerate(pairs, ids, "block", linkage).collect()}
        assert [got[i] for i in range(25)] == plain_agglomerate(d, 25, linkage)


def test_ordered_choices(spark):
    """Greedy acceptance by a grid against all taken before."""
    rng = np.random.default_rng(5)
    rows = [(g, i, float(rng.integers(0, 40)), float(rng.integers(0, 40)), float(rng.integers(1, 12)), float(rng.integers(1, 12)), float(rng.random())) for g in range(6) for i in range(40)]
    df = spark.createDataFrame(rows, "g int, id long, x double, y double, w double, h double, score double").repartition(3)
    got = {(r.g, r.id): r.taken for r in boxes.greedy_accept(df, "g").collect()}
    for g in range(6):
        taken = []
        for _, i, x, y, w, h, _ in sorted((r for r in rows if r[0] == g), key=lambda r: (-r[6], r[1])):
            free = all(abs(x + w / 2 - a) >= 0.5 * w or abs(y + h / 2 - b) >= 0.5 * h for a, b in taken)
            assert got[g, i] == free
            if free:
                taken.append((x + w / 2, y + h / 2))


def test_texts_read_once(spark):
    stripes = spark.createDataFrame([(1, "a"), (2, "bb"), (3, None)], "id int, image string")
    known = spark.createDataFrame([(1, "known")], "id int, text string")
    read, keep = contests.with_texts(stripes, known, ["id"], lambda image: f"{len(image or '')}")
    assert {r.id: r.text for r in read.collect()} == {1: "known", 2: "2", 3: "0"} and keep.count() == 3
    assert {r.id: r.text for r in contests.with_texts(stripes, known, ["id"])[0].collect()} == {1: "known", 2: None, 3: None}


def test_straightening_and_exemplars(spark):
    image = pixels.grid_image(60, 80, [(10, 10, 70, 50), (10, 20, 70, 40)])
    turned = np.nan_to_num(pixels.affine(image, pixels.rigid(0, 0, 2.0, image.shape), fill=1.0), nan=1.0)
    df = spark.createDataFrame([(1, patches.pack(turned))], f"k int, patch {patches.PATCH}")
    (r,) = patches.straightened(df, 0.6).collect()
    assert abs(abs(r.angle) - 2) <= 0.75
    exemplars = spark.createDataFrame([("party", "x", 1), ("party", "x", 2), ("party", "y", 1)], "attr string, label string, k int")
    both = spark.createDataFrame([(1, patches.pack(image)), (2, patches.pack(image))], f"k int, patch {patches.PATCH}")
    assert sorted((r.label, r.place) for r in patches.exemplar_map(exemplars, both, "attr", "k").collect()) == [("x", 0), ("x", 1), ("y", 0)]


def test_sort_by_keys_of_another_table(spark):
    rows, keys = spark.createDataFrame([(i,) for i in range(6)], "id long"), spark.createDataFrame([(0, 5), (1, None), (2, 1), (3, 5), (9, 0)], "id long, k int")
    assert [r.id for r in ranking.sorted_by_keys(rows, keys, ["id"], "k").orderBy("place").collect()] == [2, 0, 3]


@pytest.mark.parametrize("name", ["o33_o35_j10_hart_images", "j10_ess_images", "j10_diebold_images", "f5_j10_sequoia_images"])
def test_images_are_read_where_they_are_drawn(spark, sf, name):
    """One step in Python, so no image goes from one process to another."""
    from psephos.plans.queries import QUERIES

    assert QUERIES[name](spark, sf)._jdf.queryExecution().analyzed().toString().count("MapInPandas") == 1


def test_decode_of_patches_and_of_images_it_makes(spark):
    from psephos.operators import decoders, patches

    codes = ["010011010101", "111111111111", "000000000000"]
    read = decoders.retried(lambda a: decoders.timing(a, 12, 4, 6))
    given = spark.createDataFrame([(c, patches.pack(decoders.timing_image(c))) for c in codes], f"truth string, patch {patches.PATCH}")
    by_patch, made = decoders.decode(given, read), decoders.decode(given.select("truth"), read, image=decoders.timing_image, columns=("truth",))
    assert made.columns == by_patch.columns and sorted(made.collect()) == sorted(by_patch.collect()) and {r.raw for r in made.collect()} == set(codes)


def test_equal_exemplars_take_bounded_memory():
    """All pairs of items and equal exemplars are equally near; the least id is taken."""
    import tracemalloc

    from psephos.operators.cluster import _nearest

    x, e = np.random.default_rng(1).random((1024, 64)), np.full((3000, 64), 0.5)
    tracemalloc.start()
    _, at = _nearest(x, e, list(range(3000, 0, -1)))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (at == 2999).all() and most < 300e6


def test_exemplars_are_put_in_order_once():
    """However many parts of rows their distances take."""
    import numpy as np

    from psephos.operators.cluster import _nearest

    class Ids(list):
        n = 0

        def __getitem__(self, k):
            Ids.n += 1
            return super().__getitem__(k)

    rng = np.random.default_rng(2)
    x, e = rng.integers(0, 3, (600, 64)).astype(float), rng.integers(0, 3, (1500, 64)).astype(float)
    e[700:900] = x[0]
    ids = Ids(rng.permutation(1500).tolist())
    d, at = _nearest(x, e, ids)
    assert Ids.n == 1500
    every = np.round(np.sqrt(((x[:, None] - e[None]) ** 2).sum(axis=2)), 9)
    assert [(a, list(ids)[k]) for a, k in zip(d, at)] == [min(zip(r.tolist(), list(ids))) for r in every]
