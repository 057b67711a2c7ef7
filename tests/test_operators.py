import numpy as np
import pytest
from pyspark.sql import functions as F

from psephos.functions import codes, paths
from psephos.operators import cluster, contests, grouping, layout, pairing, pixels, threshold
from psephos.sources import io
from psephos.streaming.tally import windowed_counts


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_counter_pairing_of_nine_names(spark):
    names = ["329_1447_74_5_1", "329_1447_74_6_2", "329_1447_74_7_1", "329_1447_74_8_2", "339_128_29_2_1", "2_1_1_1", "2_1_2_1", "2_1_3_1", "2_1_4_2"]
    df = spark.createDataFrame([(n, n.rsplit("_", 2)[0], int(n.split("_")[-2]), int(n.split("_")[-1])) for n in names], "name string, stem string, n1 int, n2 int")
    groups = {}
    for r in pairing.by_counter(df, ["stem"]).collect():
        groups.setdefault((r.stem, r.ballot_no), set()).add("_".join(r.name.split("_")[-2:]))
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, [{"5_1", "6_2"}, {"7_1", "8_2"}, {"2_1"}, {"1_1"}, {"2_1"}, {"3_1", "4_2"}]))


def test_alternating_counts_by_directory(spark):
    df = spark.createDataFrame([("a", f"i{k}") for k in (10, 9, 1, 2)] + [("b", "x1")], "dir_path string, file_name string")
    out = {r.file_name: (r.ballot_key, r.img_ord, r.divides) for r in pairing.alternating(df, 2).collect()}
    assert out == {"i1": ("a#0", 0, True), "i2": ("a#0", 1, True), "i9": ("a#1", 0, True), "i10": ("a#1", 1, True), "x1": ("b#0", 0, False)}


def test_natural_order(spark):
    names = ["a10", "a9", "A1", "a9b2", "a9b10", "b", "a" + "9" * 20]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    got = [r.n for r in df.orderBy(paths.natural_key(F.col("n"))).collect()]
    assert got[:5] == ["A1", "a9", "a9b2", "a9b10", "a10"] and got[-1] == "b"


def test_hart(spark):
    assert codes.hart_weights() == [82, 47, 92, 48, 63, 16, 21, 70, 7, 88, 67, 94]
    body = "123456001020"
    total = (1 + sum(int(d) * w for d, w in zip(body, codes.hart_weights()))) % 97
    check = {1: 98, 0: 97}.get(total, total)
    for tail, ok in ((check, True), ((check + 1) % 100, False)):
        assert one(spark, codes.hart_valid(F.lit(f"{body}{tail:02d}"))) is ok
    assert one(spark, codes.hart_valid(F.lit("12x"))) is False and one(spark, codes.hart_valid(F.lit(None).cast("string"))) is False


def test_diebold(spark):
    bits = "01111011110" + "0" * 19
    bits += f"{bits.count('1') % 4:02b}"
    assert one(spark, codes.diebold_valid(F.lit(bits))) and one(spark, codes.diebold_page(F.lit(bits))) == 1
    assert not one(spark, codes.diebold_valid(F.lit(bits[:-1] + ("0" if bits[-1] == "1" else "1"))))
    assert one(spark, codes.diebold_sane(F.lit("1" + bits + "1"))) and not one(spark, codes.diebold_sane(F.lit(bits)))


def test_i2of5(spark):
    assert one(spark, codes.i2of5_digit(F.lit("NNWWN"))) == "0" and one(spark, codes.i2of5_digit(F.lit("WWWWW"))) is None
    assert one(spark, codes.i2of5_decode(F.lit("NNNN" + "WWWWWWWWWW" + "WNN"))) is None


def test_counter(spark):
    df = spark.createDataFrame([(c,) for c in "a" * 6 + "b" * 4 + "c" * 12], "k string")
    more = spark.createDataFrame([(c,) for c in "aazzz"], "k string")
    a, b = grouping.counter(df, "k"), grouping.counter(more, "k")
    assert {r.k: r.n for r in grouping.counter_op(a, b, "k", "+").collect()} == {"a": 8, "b": 4, "c": 12, "z": 3}
    assert {r.k: r.n for r in grouping.counter_op(a, b, "k", "-").collect()} == {"a": 4, "b": 4, "c": 12}
    assert [r.k for r in grouping.most_common(a, "k", 2).collect()] == ["c", "a"]


def test_common_area(spark):
    df = spark.createDataFrame([((0, 0, 4, 4), (2, 2, 6, 6)), ((0, 0, 1, 1), (5, 5, 6, 6))], "a struct<x1:int,y1:int,x2:int,y2:int>, b struct<x1:int,y1:int,x2:int,y2:int>")
    assert [r.x for r in df.select(layout.common_area("a", "b").alias("x")).collect()] == [4, 0]


def test_rotations(spark):
    a, b = F.array(*map(F.lit, ["Smith", "Jones", "Brown"])), F.array(*map(F.lit, ["Jones", "Brown", "Smith"]))
    assert one(spark, contests.rotation_distance(F.lit("Mayor"), F.lit("Mayor"), a, b)) == 0
    assert one(spark, contests.rotation_distance(F.lit("Mayor"), F.lit("Major"), a, b)) == pytest.approx(1 / 40)
    assert one(spark, contests.rotate(a, F.lit(1))) == ["Jones", "Brown", "Smith"]


def test_agglomerate(spark):
    ids = spark.createDataFrame([(0, i) for i in range(6)], "block int, id long")
    near = {(0, 1), (0, 2), (1, 2), (3, 4)}
    pairs = spark.createDataFrame([(0, a, b, 0.1 if (a, b) in near else 0.9) for a in range(6) for b in range(a + 1, 6)], "block int, a_id long, b_id long, distance double")
    assert {r.id: r.cluster for r in contests.agglomerate(pairs, ids, "block", 0.3).collect()} == {0: 0, 1: 0, 2: 0, 3: 3, 4: 3, 5: 5}


def test_outliers_go_on_while_flagged(spark):
    df = spark.createDataFrame([("g", float(x), i) for i, x in enumerate([100, 99, 10, 9, 8])], "g string, e double, id int")
    got = {r.e: r.outlier for r in threshold.outliers(df, ["g"], "e", ["id"], 2).collect()}
    assert got == {100.0: True, 99.0: True, 10.0: False, 9.0: False, 8.0: False}
    assert not any(r.outlier for r in threshold.outliers(df, ["g"], "e", ["id"], 1).collect())  # one value ahead: 99 is near 100


def test_clusters(spark):
    rng = np.random.default_rng(1)
    rows = [(i, 0, (rng.standard_normal(4) + 20 * (i % 2)).tolist()) for i in range(40)]
    rows[3][2][0] = float("nan")
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    for fn in (cluster.kmeans_in_groups,):
        out = {r.vec_id: r.cluster for r in fn(df, "label", 2, "vec_id").collect()}
        assert len(out) == 40 and len({(i % 2, c) for i, c in out.items()}) == 2
    parts = {r.vec_id: r.cluster for r in cluster.kmeans_in_groups(df, "label", 2, "vec_id", most=16).collect()}
    assert {i: c // 2 for i, c in parts.items()} == {i: i // 16 for i in range(40)} and len({(i % 2, c) for i, c in parts.items()}) == 6
    whole = df.where("vec_id <> 3")
    out = {r.vec_id: r.cluster for r in cluster.kmedoids_in_groups(whole, "label", 2, "vec_id").collect()}
    assert len({(i % 2, c) for i, c in out.items()}) == 2
    out = {r.vec_id: r.cluster for r in cluster.kmeans(whole, 2).collect()}
    assert len({(i % 2, c) for i, c in out.items()}) == 2
    items = whole.select(F.col("vec_id").alias("id"), (F.col("vec_id") % 2).alias("label"), "embedding", F.col("embedding")[1].alias("light"))
    assert {r.label for r in cluster.exemplars(items).collect()} == {0, 1}


def grown(rows, most=None):
    """rows: (id, label, light, vector).  The growth of the reference, one item at a time."""
    by = {}
    for r in sorted(rows, key=lambda r: (-r[2], r[0])):
        by.setdefault(r[1], []).append(r)
    chosen = [x.pop(0) for _, x in sorted(by.items())]
    tasks = [x[k] for k in range(max(map(len, by.values()))) for _, x in sorted(by.items()) if k < len(x)]
    count, done = dict.fromkeys(by, 0), False
    nearest = lambda r: min((round(float(np.linalg.norm(np.subtract(r[3], e[3]))), 9), e[0], e[1]) for e in chosen)[2]
    while not done:
        done = True
        for r in list(tasks):
            if nearest(r) != r[1] and (most is None or count[r[1]] < most):
                tasks.remove(r)
                chosen.append(r)
                count[r[1]] += 1
                done = False
    return chosen, [r for r in tasks if nearest(r) != r[1]]


def test_exemplars_grow_to_the_end(spark):
    rng = np.random.default_rng(5)
    rows = [(i, i % 3, float(rng.integers(0, 20)), rng.standard_normal(3).round(1).tolist()) for i in range(120)]
    rows += [(200, 0, 1.0, rows[4][3]), (201, 1, 1.0, rows[5][3])]  # equal vectors of other labels
    items = spark.createDataFrame(rows, "id long, label long, light double, embedding array<double>")
    want, wrong = grown(rows)
    assert not wrong and len(want) > 3 + 3 * 20
    for turn in (4096, 17):
        assert sorted(map(tuple, cluster.exemplars(items, turn=turn).collect())) == sorted((r[0], r[1]) for r in want)
    assert sorted(map(tuple, cluster.exemplars(items, most=2).collect())) == sorted((r[0], r[1]) for r in grown(rows, 2)[0])


def test_pixels():
    rng = np.random.default_rng(2)
    image = pixels.resize(rng.random((12, 15)), (60, 75))
    patch = image[20:30, 30:42]
    assert pixels.best_match(image, patch)[:2] == (30, 20)
    assert pixels.matches(image, patch, 0.95, 3)[0][:2] == (30, 20)
    assert np.array_equal(pixels.flip(pixels.flip(image)), image)
    assert np.allclose(pixels.affine(image, np.eye(3)), image)
    moved = np.nan_to_num(pixels.affine(image, np.array([[1, 0, 3], [0, 1, -2], [0, 0, 1.0]])), nan=image.mean())
    assert np.abs(pixels.align_shift(moved, image) - [-3, 2]).max() < 0.3
    cost = np.full((5, 6), 1e9)
    cost[2, 3] = 0
    assert np.array_equal(pixels.distance_transform(cost), (np.arange(5)[:, None] - 2) ** 2 + (np.arange(6)[None] - 3) ** 2)
    line = np.array([1, 1, 0, 0, 0, 1, 0, 1.0])
    assert pixels.runs(line, 0.5) == [(False, 2), (True, 3), (False, 1), (True, 1), (False, 1)]
    assert pixels.bar_widths([1, 3, 1]) == ["NWN"] and len(pixels.bar_widths([1, 2, 3])) == 2
    framed = np.ones((20, 30))
    framed[:3], framed[:, -2:] = 0, 0
    assert pixels.border(framed) == (3, 0, 0, 2)
    low, high = pixels.overlay(np.stack([image, 1 - image]))
    assert (low <= high).all() and 0.4 < pixels.on_off(np.array([0.1] * 9 + [0.9] * 9)) < 0.6
    digits = {str(k): pixels.resize(rng.random((4, 4)), (8, 6)) for k in range(4)}
    row = np.full((8, 60), 0.5)
    for k, d in enumerate("3102"):
        row[:, 4 + 12 * k : 10 + 12 * k] = digits[d]
    assert pixels.digit_rows(row, digits, 4, 12)[0] == "3102"
    ruled = np.ones((80, 120))
    for y in (20, 40, 60):
        for x in range(120):
            ruled[int(round(y + x * np.tan(np.radians(2)))), x] = 0
    assert abs(pixels.straight_angle(ruled, 0.5) - 2) <= 0.25


def test_io_round_trips(spark, tmp_path):
    root = tmp_path / "in" / "deep"
    root.mkdir(parents=True)
    for n in ("a.PNG", "b.txt", "c.tiff"):
        (root / n).write_bytes(b"x")
    assert sorted(r.image_path.rsplit("/", 1)[1] for r in io.list_images(spark, str(tmp_path / "in")).collect()) == ["a.PNG", "c.tiff"]
    assert {bytes(r.content) for r in io.read_images(spark, str(tmp_path / "in")).collect()} == {b"x"}
    df = spark.createDataFrame([(1, 0, 2, True), (1, 1, 1, False)], "ballot_id long, page int, target_id int, is_filled boolean")
    lines = io.target_lines(df)
    assert [r.value for r in lines.collect()] == ["1, 0, 2, 1", "1, 1, 1, 0"]
    assert sorted(map(tuple, io.parse_targets(lines).collect())) == sorted(map(tuple, df.collect()))
    io.save_table(df, str(tmp_path / "p"), "t")
    assert io.load_table(spark, str(tmp_path / "p"), "t").count() == 2
    io.write_csv(df, str(tmp_path / "c"))
    assert sorted(map(tuple, io.read_csv(spark, str(tmp_path / "c"), df.schema.simpleString()[7:-1].replace(":", " ")).collect())) == sorted(map(tuple, df.collect()))
    back = io.parse_quarantine(spark.createDataFrame([("p.png,3,TF,4,F,",), ("q.png,",)], "value string")).collect()
    assert sorted((r.image_path, r.cid, r.votes) for r in back) == [("p.png", 3, [True, False]), ("p.png", 4, [False])]
    projects = io.Catalog(str(tmp_path / "projects"))
    projects.create("one")
    assert projects.names() == ["one"] and not projects.valid("../x") and not projects.has("one", "t")
    with pytest.raises(ValueError):
        projects.create("a/b")
    projects.delete("one")
    assert projects.names() == []


def test_streaming_equals_batch(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    source = tmp_path / "events"
    events.repartition(3).write.parquet(str(source))
    stream = spark.readStream.schema(events.schema).parquet(str(source))
    q = windowed_counts(stream, "ts", "event_type", late="60 days").writeStream.format("memory").queryName("tallied").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(r.start, r.event_type): r.n for r in spark.table("tallied").collect()}
    assert got == {(r.start, r.event_type): r.n for r in windowed_counts(events, "ts", "event_type").collect()}


def test_patches(spark):
    from psephos.operators import patches

    rng = np.random.default_rng(3)
    images = [pixels.resize(rng.random((6, 6)), (24, 24)) for _ in range(3)]
    rows = [(i, i % 2, im.ravel().tolist()) for i, im in enumerate(images)]
    df = patches.from_array(spark.createDataFrame(rows, "id long, g int, a array<double>"), "a", 24).drop("a")
    got = {r.id: r for r in patches.match_exemplars(df, {str(k): im[4:14, 6:16] for k, im in enumerate(images)}).collect()}
    assert {i: (r.label, r.x, r.y, r.status) for i, r in got.items()} == {i: (str(i), 6, 4, "ok") for i in range(3)}
    bad = patches.map_patch(df, lambda a: {"v": 1 // int(a[0, 0] > 2)}, "v long").collect()
    assert {(r.v, r.status) for r in bad} == {(None, "err")}
    over = {r.g: r for r in patches.overlays(df, "g").collect()}
    assert np.allclose(over[0].low, np.minimum(images[0], images[2]).ravel()) and np.allclose(over[0].high, np.maximum(images[0], images[2]).ravel())
    means = {(r.id, r.target_id): r.intensity for r in patches.extract(df, [(0, 0, 4, 4), (2, 3, 9, 8)]).collect()}
    assert means[1, 1] == pytest.approx(images[1][3:8, 2:9].mean() * 255)
    made = patches.testset(spark, images[:1], [0, 2], [0, -1], [0.0], noise=0.0).withColumn("g", F.lit(1)).withColumn("k", F.col("dx") * 10 - F.col("dy"))
    shifts = {r.k: (r.dx, r.dy) for r in patches.aligned(made, "g", "k").collect()}
    assert max(abs(shifts[20][0] + 2), abs(shifts[20][1])) < 0.5 and max(abs(shifts[1][0]), abs(shifts[1][1] - 1)) < 0.5


def test_boxes_patches_and_texts_on_disk(spark, tmp_path):
    b = spark.createDataFrame([("contest", 1, 1, 0, 0, 5, 5, 0, 0), ("target", 2, 1, 1, 1, 2, 2, 0, 1)], "kind string, box_id int, contest_local_id int, x int, y int, w int, h int, group_id int, side int")
    io.write_boxes(b, str(tmp_path / "b"))
    assert sorted(map(tuple, io.read_boxes(spark, str(tmp_path / "b")).collect())) == sorted(map(tuple, b.collect()))
    p = spark.range(50).select(F.col("id").alias("ballot_id"), F.lit(0).alias("page"), F.lit(1).alias("target_id"), (F.col("id") * 5).cast("int").alias("intensity"))
    io.write_patches(p, str(tmp_path / "p"))
    assert sorted(r.intensity for r in io.read_patches(spark, str(tmp_path / "p"), 10, 25).collect()) == [10, 15, 20, 25]
    io.save_text(str(tmp_path / "x"), "t", "é\n")
    assert io.load_text(str(tmp_path / "x"), "t") == "é\n"


def test_equivalence_classes(spark):
    rows = [(1, "eng", "Mayor of the town", ["Ann Smith", "Bob Jones"]), (2, "eng", "Mayor of tne town", ["Bob Jones", "Ann Smith"]), (3, "eng", "School board", ["Cy Young", "Di Old"]), (4, "spa", "Mayor of the town", ["Ann Smith", "Bob Jones"]), (5, "eng", "Mayor of the town", ["Ann Smith", "Bob Jones", "Third"])]
    df = spark.createDataFrame(rows, "id long, language string, title string, choices array<string>")
    assert {r.id: r["class"] for r in contests.equivalence_classes(df).collect()} == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5}


def test_vendors(spark):
    from psephos.operators import vendors

    body = "123456001020"
    total = (1 + sum(int(d) * w for d, w in zip(body, codes.hart_weights()))) % 97
    good = f"{body}{({1: 98, 0: 97}.get(total, total)):02d}"
    rows = [("a/1", 1, 0, good), ("a/2", 1, 1, good), ("b/1", 2, 0, good), ("b/2", 2, 1, "junk"), ("c/1", 3, 0, None)]
    df = spark.createDataFrame(rows, "image_path string, ballot_id long, page int, raw string")
    parts, bad = vendors.partition(df, "hart")
    assert [r.ballot_id for r in parts.collect()] == [1] and {(r.image_path, r.status) for r in bad.collect()} == {("b/2", "err"), ("c/1", "ioerr")}
    parts, bad = vendors.partition(df, "hart", spark.createDataFrame([("b/2", good)], "image_path string, code string"))
    assert {r.ballot_id: r.partition_id for r in parts.collect()} == {1: 0, 2: 0} and bad.count() == 1
    assert {r.partition_id for r in vendors.partition(df, "single")[0].collect()} == {0}
    assert {r.ballot_id: r.partition_id for r in vendors.partition(df, "dirname")[0].collect()} == {1: 0, 2: 1, 3: 2}
    seq = spark.createDataFrame([("s/1", 1, 0, "11110000,10101010"), ("s/2", 1, 1, None)], "image_path string, ballot_id long, page int, raw string")
    assert vendors.partition(seq, "sequoia")[0].count() == 1
    for v in vendors.VENDORS:
        assert "code" in vendors.VENDORS[v]().decode(df).columns
