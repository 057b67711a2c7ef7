"""The election queries by name, each with SQL that says the same.  Names begin with the survey's operator ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from psephos.functions import codes, paths
from psephos.operators import cluster, contests, grouping, layout, pairing, tally, threshold
from psephos.operators.ranking import dense_ids, global_rank, trimmed_mean
from psephos.plans import views as v
from psephos.sources import io

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return add


def long(*names: str) -> list:
    return [F.col(n).cast("long").alias(n) for n in names]


# --- votes, records, tallies ---------------------------------------------------------------------


def results(spark: SparkSession, d: str) -> DataFrame:
    return tally.classify(v.marks(spark, d), v.THRESHOLD)


def status(spark: SparkSession, d: str) -> DataFrame:
    return tally.contest_status(results(spark, d), v.contests(spark))


STATUS = f"""{v.FILLED}, {v.CONTEST},
one AS (SELECT ballot_id, cid, choice, MAX(CAST(is_filled AS INT)) AS filled FROM result GROUP BY ALL),
votes AS (SELECT one.*, upto, SUM(filled) OVER (PARTITION BY ballot_id, cid) AS votes FROM one JOIN contest USING (cid)),
status AS (SELECT ballot_id, cid, choice, upto, CAST(votes AS BIGINT) AS votes, CASE WHEN votes > upto THEN 'OVERVOTED' WHEN votes = 0 THEN 'UNDERVOTED' ELSE 'OK' END AS status,
 CASE WHEN votes > upto OR votes = 0 THEN 0 ELSE filled END AS filled FROM votes),
bc AS (SELECT DISTINCT ballot_id, cid, votes, status FROM status)"""


@query("b10_classify", f"WITH {v.FILLED} SELECT ballot_id, page, target_id, is_filled <> (target_id = 1 AND ballot_id % 50 = 0) AS is_filled FROM result")
def _(spark, d):
    m = v.marks(spark, d)
    wrong = m.where("target_id = 1 and ballot_id % 50 = 0")
    return tally.classify(m, v.THRESHOLD, wrong).select("ballot_id", "page", "target_id", "is_filled")


@query("b11_view_filters", f"WITH {STATUS} SELECT 'even' AS which, COUNT(*) AS n FROM result WHERE rnk % 2 = 0 UNION ALL SELECT 'filled', COUNT(*) FROM result WHERE is_filled UNION ALL SELECT 'all', COUNT(*) FROM result UNION ALL SELECT 'overvotes', COUNT(*) FROM result SEMI JOIN (SELECT ballot_id, cid FROM bc WHERE status = 'OVERVOTED') o USING (ballot_id, cid)")
def _(spark, d):
    r = results(spark, d)
    over = tally.by_contest(tally.contest_status(r, v.contests(spark))).where("status = 'OVERVOTED'")
    parts = {"even": threshold.view(tally.ranked(v.marks(spark, d)), "even"), "filled": threshold.view(r, "filled"), "all": r, "overvotes": r.join(over, ["ballot_id", "cid"], "left_semi")}
    out = None
    for k, x in parts.items():
        row = x.agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("which"), "n")
        out = row if out is None else out.unionByName(row)
    return out


@query("c3_target_to_contest", f"WITH {v.MARK}, {v.CONTEST} SELECT DISTINCT page, choice, cid, title, CAST(ASCII(cid) * 10 + choice AS BIGINT) AS global_id FROM mark JOIN contest USING (cid)")
def _(spark, d):
    boxes = v.marks(spark, d).select("page", "choice", "cid").distinct()
    return boxes.join(v.contests(spark), "cid").select("page", "choice", "cid", "title", (F.ascii("cid") * 10 + F.col("choice")).cast("long").alias("global_id"))


@query("c4_unknown_targets", f"WITH {v.MARK}, {v.CONTEST}, k AS (SELECT * FROM contest WHERE cid <> 'R') SELECT cid, CAST(COUNT(*) AS BIGINT) AS n FROM mark ANTI JOIN k USING (cid) GROUP BY cid")
def _(spark, d):
    known = v.contests(spark).where("cid <> 'R'")
    return v.marks(spark, d).join(known, "cid", "left_anti").groupBy("cid").agg(F.count(F.lit(1)).alias("n"))


@query("c5_voted_flag", f"WITH {v.MARK}, f AS (SELECT DISTINCT ballot_id, page FROM mark WHERE intensity < 15) SELECT ballot_id, page, target_id, f.ballot_id IS NOT NULL AS voted FROM mark LEFT JOIN f USING (ballot_id, page)")
def _(spark, d):
    m = v.marks(spark, d)
    seen = m.where("intensity < 15").select("ballot_id", "page").distinct().withColumn("_v", F.lit(True))
    return m.join(seen, ["ballot_id", "page"], "left").select("ballot_id", "page", "target_id", F.col("_v").isNotNull().alias("voted"))


@query("d9_contest_status", f"WITH {STATUS} SELECT ballot_id, cid, votes, status FROM bc")
def _(spark, d):
    return tally.by_contest(status(spark, d)).select("ballot_id", "cid", *long("votes"), "status")


@query("d10_manual_status", f"WITH {v.MARK}, m AS (SELECT ballot_id, cid, list(intensity < 60 ORDER BY target_id) AS votes FROM mark WHERE page = 1 GROUP BY ALL), {v.CONTEST}, n AS (SELECT m.*, upto, len(list_filter(votes, lambda x: x)) AS n FROM m JOIN contest USING (cid)) SELECT ballot_id, cid, CAST(n AS BIGINT) AS n, CASE WHEN n > upto THEN 'OVERVOTED' WHEN n = 0 THEN 'UNDERVOTED' ELSE 'OK' END AS status FROM n")
def _(spark, d):
    own = F.transform(F.array_sort(F.collect_list(F.struct("target_id", (F.col("intensity") < 60).alias("t")))), lambda x: x["t"])
    manual = v.marks(spark, d).where("page = 1").groupBy("ballot_id", "cid").agg(own.alias("votes")).join(F.broadcast(v.contests(spark).select("cid", "upto")), "cid")
    return tally.manual_status(manual).select("ballot_id", "cid", *long("n"), "status")


def labelled(spark, d) -> DataFrame:
    names = F.when(F.col("choice").isin(3, 4), "writein").otherwise(F.concat(F.lit("Choice "), F.col("choice").cast("string")))
    return status(spark, d).withColumn("label", names)


@query("d11_final_tally", f"WITH {STATUS}, l AS (SELECT cid, {v.LABEL} AS label, CAST(SUM(filled) AS BIGINT) AS votes FROM status GROUP BY ALL), c AS (SELECT cid, CAST(COUNT(*) FILTER (WHERE status = 'OVERVOTED') AS BIGINT) AS over, CAST(COUNT(*) FILTER (WHERE status = 'UNDERVOTED') AS BIGINT) AS under, CAST(COUNT(*) AS BIGINT) AS ballots FROM bc GROUP BY cid) SELECT title, label, votes, over, under, ballots FROM l JOIN c USING (cid) JOIN contest USING (cid)")
def _(spark, d):
    t = tally.tally_with_counters(labelled(spark, d), [], [[]])
    return t.join(v.contests(spark), "cid").select("title", "label", "votes", *long("over", "under", "ballots"))


@query("d12_overvoted", f"WITH {v.FILLED}, {v.CONTEST} SELECT ballot_id, page, cid, CAST(SUM(CAST(is_filled AS INT)) AS BIGINT) AS votes FROM result JOIN contest USING (cid) GROUP BY ballot_id, page, cid, upto HAVING SUM(CAST(is_filled AS INT)) > upto")
def _(spark, d):
    r = results(spark, d).join(F.broadcast(v.contests(spark).select("cid", "upto")), "cid")
    n = r.groupBy("ballot_id", "page", "cid", "upto").agg(F.sum(F.col("is_filled").cast("int")).alias("votes"))
    return n.where("votes > upto").select("ballot_id", "page", "cid", *long("votes"))


SETS = [[], ["precinct"], ["precinct", "mode"]]


@query(
    "d13_tally_precinct_mode",
    f"""WITH {STATUS}, {v.ATTR},
l AS (SELECT s.ballot_id, s.cid, {v.LABEL} AS label, s.filled, a.precinct, a.mode FROM status s JOIN attr a USING (ballot_id)),
g AS (SELECT CASE WHEN GROUPING(precinct) = 1 THEN 'TOTAL' WHEN GROUPING(mode) = 1 THEN 'precinct' ELSE 'precinct/mode' END AS level, precinct, mode, cid, label, CAST(SUM(filled) AS BIGINT) AS votes
 FROM l GROUP BY GROUPING SETS ((cid, label), (precinct, cid, label), (precinct, mode, cid, label))),
w AS (SELECT *, RANK() OVER (PARTITION BY level, precinct, mode, cid ORDER BY votes DESC) AS r FROM g),
x AS (SELECT level, precinct, mode, cid, MAX(votes) AS most, COUNT(*) AS n, MIN(label) AS label FROM w WHERE r = 1 GROUP BY ALL)
SELECT w.level, w.precinct, w.mode, w.cid, w.label, w.votes, CASE WHEN x.most = 0 THEN 'N/A' WHEN x.n > 1 THEN 'Tie' ELSE x.label END AS winner
FROM w JOIN x ON w.level = x.level AND w.precinct IS NOT DISTINCT FROM x.precinct AND w.mode IS NOT DISTINCT FROM x.mode AND w.cid = x.cid""",
)
def _(spark, d):
    s = labelled(spark, d).join(v.attributes(spark, d).select("ballot_id", "precinct", "mode"), "ballot_id")
    t = tally.tally(s, ["precinct", "mode"], SETS)
    return tally.with_winner(t, ["level", "precinct", "mode", "cid"]).select("level", "precinct", "mode", "cid", "label", "votes", "winner")


@query("d13_counters", f"WITH {STATUS}, {v.ATTR} SELECT CASE WHEN GROUPING(precinct) = 1 THEN 'TOTAL' WHEN GROUPING(mode) = 1 THEN 'precinct' ELSE 'precinct/mode' END AS level, precinct, mode, cid, CAST(COUNT(*) FILTER (WHERE bc.status = 'OVERVOTED') AS BIGINT) AS over, CAST(COUNT(*) FILTER (WHERE bc.status = 'UNDERVOTED') AS BIGINT) AS under, CAST(COUNT(*) AS BIGINT) AS ballots FROM bc JOIN attr USING (ballot_id) GROUP BY GROUPING SETS ((cid), (precinct, cid), (precinct, mode, cid))")
def _(spark, d):
    s = tally.by_contest(status(spark, d)).join(v.attributes(spark, d).select("ballot_id", "precinct", "mode"), "ballot_id")
    return tally.counters(s, ["precinct", "mode"], SETS).select("level", "precinct", "mode", "cid", *long("over", "under", "ballots"))


@query("d14_tally_by_batch", f"WITH {STATUS}, {v.ATTR}, l AS (SELECT region, precinct, cid, {v.LABEL} AS label, filled FROM status JOIN attr USING (ballot_id)), b AS (SELECT unnest(['TOTAL', region, region || '/' || precinct]) AS batch, cid, label, filled FROM l) SELECT batch, cid, label, CAST(SUM(filled) AS BIGINT) AS votes FROM b GROUP BY ALL")
def _(spark, d):
    s = labelled(spark, d).join(v.attributes(spark, d).select("ballot_id", "path"), "ballot_id")
    return tally.tally_by_batch(s)


@query("c11_batch_containment", f"WITH {v.ATTR}, x AS (SELECT ballot_id, unnest([region, region || '/' || precinct]) AS batch FROM attr) SELECT batch, CAST(COUNT(*) AS BIGINT) AS ballots FROM x GROUP BY batch")
def _(spark, d):
    a = v.attributes(spark, d)
    return a.select(F.explode(tally.ancestors(F.col("path"))).alias("batch")).groupBy("batch").agg(F.count(F.lit(1)).alias("ballots"))


@query("e6_winner", f"WITH {STATUS}, t AS (SELECT cid, {v.LABEL} AS label, SUM(filled) AS votes FROM status GROUP BY ALL), r AS (SELECT *, RANK() OVER (PARTITION BY cid ORDER BY votes DESC) AS r FROM t) SELECT cid, CAST(MAX(votes) AS BIGINT) AS votes, CASE WHEN MAX(votes) = 0 THEN 'N/A' WHEN COUNT(*) > 1 THEN 'Tie' ELSE MIN(label) END AS winner FROM r WHERE r = 1 GROUP BY cid")
def _(spark, d):
    return tally.winners(tally.tally(labelled(spark, d), [], [[]]), ["cid"]).select("cid", *long("votes"), "winner")


@query("e8_last_image_wins", f"WITH {v.MARK}, i AS (SELECT ballot_id, cid, page AS img_ord, string_agg(CAST(intensity AS VARCHAR), ',' ORDER BY target_id) AS marks FROM mark GROUP BY ALL) SELECT ballot_id, cid, arg_max(marks, img_ord) AS marks, MAX(img_ord) AS img_ord, CAST(COUNT(*) AS BIGINT) AS n_images FROM i GROUP BY ballot_id, cid")
def _(spark, d):
    own = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("target_id", "intensity"))), lambda x: x["intensity"].cast("string")), ",")
    images = v.marks(spark, d).groupBy("ballot_id", "cid", F.col("page").alias("img_ord")).agg(own.alias("marks"))
    return tally.last_image_wins(images)


@query("a8_cvr_lines", f"WITH {STATUS}, c AS (SELECT ballot_id, cid, string_agg(CAST(filled AS VARCHAR), ',' ORDER BY choice) AS marks, MIN(status) AS status FROM status GROUP BY ALL) SELECT ballot_id || ',' || string_agg(cid || ',' || marks || ',' || status, ',' ORDER BY cid) AS value FROM c GROUP BY ballot_id")
def _(spark, d):
    return io.cvr_lines(tally.cvr(status(spark, d))).select("value")


@query("a9_cvr_texts", f"WITH {STATUS}, {v.ATTR}, l AS (SELECT a.path, c.title, s.status, {v.LABEL} AS label, s.filled FROM status s JOIN attr a USING (ballot_id) JOIN contest c USING (cid)), t AS (SELECT path, title, title || CASE WHEN MIN(status) = 'OK' THEN string_agg(chr(10) || chr(9) || label, '' ORDER BY label) FILTER (WHERE filled = 1) ELSE chr(10) || chr(9) || MIN(status) END AS t FROM l GROUP BY path, title) SELECT path, string_agg(t, chr(10) ORDER BY title) AS text FROM t GROUP BY path")
def _(spark, d):
    s = labelled(spark, d).join(v.attributes(spark, d).select("ballot_id", "path"), "ballot_id").join(F.broadcast(v.contests(spark).select("cid", "title")), "cid")
    return io.cvr_texts(s)


@query("a7_target_lines", f"WITH {v.FILLED} SELECT ballot_id || ', ' || page || ', ' || target_id || ', ' || CAST(is_filled AS INT) AS value FROM result")
def _(spark, d):
    return io.target_lines(results(spark, d))


@query("a6_classified_lines", f"WITH {v.MARK} SELECT ballot_id, page, target_id, intensity FROM mark")
def _(spark, d):
    return io.parse_classified(io.classified_lines(v.marks(spark, d)))


@query("a11_quarantine_lines", f"WITH {v.MARK} SELECT 'b' || ballot_id AS image_path, ASCII(cid) AS cid, string_agg(CASE WHEN intensity < 60 THEN 'T' ELSE 'F' END, '' ORDER BY target_id) AS bits FROM mark GROUP BY ALL")
def _(spark, d):
    own = F.transform(F.array_sort(F.collect_list(F.struct("target_id", (F.col("intensity") < 60).alias("t")))), lambda x: x["t"])
    manual = v.marks(spark, d).groupBy(F.concat(F.lit("b"), "ballot_id").alias("image_path"), F.ascii("cid").alias("cid")).agg(own.alias("votes"))
    back = io.parse_quarantine(io.quarantine_lines(manual))
    return back.select("image_path", "cid", F.array_join(F.transform("votes", lambda t: F.when(t, "T").otherwise("F")), "").alias("bits"))


@query("a12_lookup_last_wins", "WITH p AS (SELECT 'k' || (o_orderkey % 97) AS k, o_orderpriority AS o, o_orderkey AS line FROM orders) SELECT k AS \"in\", arg_max(o, line) AS \"out\" FROM p GROUP BY k")
def _(spark, d):
    o = v.read(spark, d, "orders")
    return io.lookup_table(o.select(F.concat(F.lit("k"), F.col("o_orderkey") % 97).alias("in"), F.col("o_orderpriority").alias("out"), F.col("o_orderkey").alias("line")))


@query("b13_b14_skip_ballots", f"WITH {v.MARK}, {v.BALLOT}, q AS (SELECT ballot_id FROM ballot WHERE status = 'quarantined'), x AS (SELECT DISTINCT ballot_id FROM mark WHERE page = 1 AND intensity > 240) SELECT CAST(COUNT(*) AS BIGINT) AS marks, CAST(COUNT(DISTINCT ballot_id) AS BIGINT) AS ballots FROM mark WHERE ballot_id NOT IN (SELECT ballot_id FROM q) AND ballot_id NOT IN (SELECT ballot_id FROM x)")
def _(spark, d):
    m, b = v.marks(spark, d), v.ballots(spark, d)
    gone = grouping.union_of(b.where("status = 'quarantined'"), m.where("page = 1 and intensity > 240"))
    return grouping.without(m, gone).agg(F.count(F.lit(1)).alias("marks"), F.count_distinct("ballot_id").alias("ballots"))


@query("b15_writein", "SELECT item_id, CASE WHEN item_id % 3 = 0 THEN 'Write-in ' || item_id WHEN item_id % 3 = 1 THEN 'WRITEIN' ELSE 'Choice' END AS choice, item_id % 3 < 2 AS is_writein FROM benchmark")
def _(spark, d):
    b = v.read(spark, d, "benchmark").select("item_id", F.when(F.col("item_id") % 3 == 0, F.concat(F.lit("Write-in "), "item_id")).when(F.col("item_id") % 3 == 1, "WRITEIN").otherwise("Choice").alias("choice"))
    return b.withColumn("is_writein", contests.is_writein(F.col("choice")))


# --- images and pairing ----------------------------------------------------------------------------


@query("a1_is_image", "SELECT page_id, lower(regexp_extract(url, '\\.([^./]*)$', 1)) AS ext, lower(regexp_extract(url || '.PNG', '\\.([^./]*)$', 1)) IN ('bmp', 'png', 'jpg', 'jpeg', 'tif', 'tiff') AS is_image FROM pages")
def _(spark, d):
    p = v.read(spark, d, "pages")
    return p.select("page_id", paths.extension(F.col("url")).alias("ext"), paths.is_image(F.concat("url", F.lit(".PNG"))).alias("is_image"))


@query("e4_single_sided", f"WITH {v.IMAGE} SELECT image_path AS ballot_key, 0 AS img_ord FROM image")
def _(spark, d):
    return pairing.pair(v.images(spark, d), "single").select("ballot_key", "img_ord")


NAT = "regexp_replace(regexp_replace(file_name, '[^0-9]*([0-9]+)_side([0-9]+).*', '\\1'), '^', '')"


@query(
    "e1_alternating",
    f"WITH {v.IMAGE}, n AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY dir_path ORDER BY ballot_id, img_ord) - 1 AS k, COUNT(*) OVER (PARTITION BY dir_path) AS c FROM image) SELECT image_path, CAST(k % 2 AS INT) AS img_ord, dir_path || '#' || (k // 2) AS ballot_key, c % 2 = 0 AS divides FROM n",
)
def _(spark, d):
    return pairing.pair(v.images(spark, d), "alternating", num_pages=2).select("image_path", "img_ord", "ballot_key", "divides")


@query("e2_b4_regex", f"WITH {v.IMAGE}, k AS (SELECT *, regexp_extract(file_name, '^(b[0-9]+)_', 1) AS s, regexp_extract(file_name, '^b[0-9]+_side([0-9])', 1) AS f FROM image WHERE regexp_matches(file_name, '^(b[0-9]+)_') AND regexp_matches(file_name, '^b[0-9]+_side([01])')) SELECT image_path, CAST(ROW_NUMBER() OVER (PARTITION BY dir_path, s ORDER BY f, file_name) - 1 AS INT) AS img_ord, dir_path || '#' || s AS ballot_key FROM k")
def _(spark, d):
    return pairing.pair(v.images(spark, d), "regex", shared="(b[0-9]+)_", different="b[0-9]+_side([01])").select("image_path", "img_ord", "ballot_key")


COUNTER = "SELECT o_custkey AS cust, o_orderkey AS id, o_orderkey // 3 AS n1, o_orderkey % 3 AS n2 FROM orders"


@query("e3_counter_islands", f"WITH c AS ({COUNTER}), f AS (SELECT *, CASE WHEN n1 = LAG(n1) OVER w + 1 AND n2 > LAG(n2) OVER w THEN 0 ELSE 1 END AS s FROM c WINDOW w AS (PARTITION BY cust ORDER BY n1, n2)) SELECT cust, id, CAST(SUM(s) OVER (PARTITION BY cust ORDER BY n1, n2 ROWS UNBOUNDED PRECEDING) - 1 AS BIGINT) AS ballot_no FROM f")
def _(spark, d):
    o = v.read(spark, d, "orders").select(F.col("o_custkey").alias("cust"), F.col("o_orderkey").alias("id"), F.floor(F.col("o_orderkey") / 3).alias("n1"), (F.col("o_orderkey") % 3).alias("n2"))
    return pairing.pair(o, "counter", partition=["cust"]).select("cust", "id", *long("ballot_no"))


@query("d1_pages_histogram", f"WITH {v.IMAGE}, p AS (SELECT ballot_id, COUNT(*) AS pages FROM image GROUP BY 1) SELECT pages, CAST(COUNT(*) AS BIGINT) AS n_ballots FROM p GROUP BY pages")
def _(spark, d):
    return pairing.page_histogram(v.images(spark, d))


@query("b2_weird_ballots", f"WITH {v.IMAGE}, p AS (SELECT ballot_id, COUNT(*) AS pages FROM image GROUP BY 1), g AS (SELECT ballot_id, ROW_NUMBER() OVER (ORDER BY ballot_id) - 1 AS dense_id FROM p WHERE pages = 2) SELECT ballot_id, pages, pages <> 2 AS weird, dense_id FROM p LEFT JOIN g USING (ballot_id)")
def _(spark, d):
    return pairing.expected_pages(v.images(spark, d), 2)


@query("b3_limit_ballots", f"WITH {v.BALLOT} SELECT ballot_id, mode FROM ballot ORDER BY ballot_id LIMIT 25")
def _(spark, d):
    return v.ballots(spark, d).orderBy("ballot_id").limit(25).select("ballot_id", "mode")


@query("d2_page_counts", f"WITH {v.IMAGE}, n AS (SELECT page, COUNT(*) AS n FROM image GROUP BY page) SELECT page, n, MIN(n) OVER () <> MAX(n) OVER () AS uneven FROM n")
def _(spark, d):
    return pairing.page_counts(v.images(spark, d))


@query("e5_dense_pages", f"WITH {v.IMAGE} SELECT image_path, CAST(DENSE_RANK() OVER (ORDER BY page) - 1 AS INT) AS norm_page FROM image")
def _(spark, d):
    return pairing.dense_pages(v.images(spark, d)).select("image_path", "norm_page")


@query("d5_repeated_pages", f"WITH {v.MARK} SELECT ballot_id, CAST(COUNT(*) AS BIGINT) AS images, CAST(COUNT(DISTINCT page) AS BIGINT) AS pages FROM mark GROUP BY ballot_id HAVING COUNT(*) <> COUNT(DISTINCT page)")
def _(spark, d):
    return pairing.distinct_pages(v.marks(spark, d))


@query("f1_natural_sort", "SELECT o_orderkey, CAST(ROW_NUMBER() OVER (ORDER BY o_custkey, o_orderkey) AS BIGINT) AS place FROM orders")
def _(spark, d):
    o = v.read(spark, d, "orders").withColumn("name", F.concat(F.lit("c"), "o_custkey", F.lit("_o"), "o_orderkey"))
    placed = global_rank(o.withColumn("key", paths.natural_key(F.col("name"))), [F.substring("key", 1, 16)], ["key"], "place")
    return placed.select("o_orderkey", (F.col("place") + 1).alias("place"))


@query("f2_f4_external_sort", f"WITH {v.MARK} SELECT ballot_id, page, target_id, CAST(ROW_NUMBER() OVER (ORDER BY intensity, ballot_id, page, target_id) - 1 AS BIGINT) AS rnk FROM mark WHERE intensity % 2 = 0")
def _(spark, d):
    kept = v.marks(spark, d).withColumn("key", F.when(F.col("intensity") % 2 == 0, F.col("intensity"))).where("key is not null")
    return global_rank(kept, [F.col("key"), F.shiftright("ballot_id", 12)], ["ballot_id", "page", "target_id"]).select("ballot_id", "page", "target_id", "rnk")


@query("e9_intensity_rank", f"WITH {v.FILLED} SELECT ballot_id, page, target_id, CAST(rnk AS BIGINT) AS rnk FROM filled")
def _(spark, d):
    return tally.ranked(v.marks(spark, d)).select("ballot_id", "page", "target_id", "rnk")


@query("f7_most_common", "SELECT o_custkey, CAST(COUNT(*) AS BIGINT) AS n FROM orders GROUP BY 1 ORDER BY n DESC, o_custkey LIMIT 15")
def _(spark, d):
    return grouping.most_common(grouping.counter(v.read(spark, d, "orders"), "o_custkey"), "o_custkey", 15)


@query("f9_sample", "WITH s AS (SELECT CAST(ROUND(COUNT(*) * 0.05) AS INT) AS n FROM orders) SELECT o_orderkey FROM (SELECT o_orderkey, ROW_NUMBER() OVER (ORDER BY md5('0:' || o_orderkey), o_orderkey) AS r FROM orders), s WHERE r <= GREATEST(10, LEAST(500, n))")
def _(spark, d):
    return pairing.sample(v.read(spark, d, "orders").select("o_orderkey"), "o_orderkey", 0.05, 10, 500)


@query("o7_stratified_sample", f"WITH {v.ATTR}, r AS (SELECT precinct, ballot_id, ROW_NUMBER() OVER (PARTITION BY precinct ORDER BY md5(CAST(ballot_id AS VARCHAR)), ballot_id) AS k, COUNT(*) OVER (PARTITION BY precinct) AS n FROM attr) SELECT precinct, ballot_id FROM r WHERE k <= GREATEST(2, LEAST(20, CAST(CEIL(n * 0.03) AS INT)))")
def _(spark, d):
    a = v.attributes(spark, d)
    n = F.count(F.lit(1)).over(Window.partitionBy("precinct"))
    ranked = a.withColumn("n", n).withColumn("k", F.row_number().over(Window.partitionBy("precinct").orderBy(F.md5(F.col("ballot_id").cast("string")), "ballot_id")))
    return ranked.where(F.col("k") <= F.greatest(F.lit(2), F.least(F.lit(20), F.ceil(F.col("n") * 0.03)))).select("precinct", "ballot_id")


# --- codes ---------------------------------------------------------------------------------------

HART = "lpad(CAST(l_orderkey % 10 AS VARCHAR), 1, '0') || lpad(CAST(l_partkey * 31 % 1000000 AS VARCHAR), 6, '0') || '0' || l_linenumber || (l_suppkey % 4) || lpad(CAST(l_suppkey % 100 AS VARCHAR), 2, '0') || lpad(CAST((l_orderkey * 7 + l_partkey) % 100 AS VARCHAR), 2, '0')"
WEIGHTS = " + ".join(f"CAST(substr(code, {i + 1}, 1) AS INT) * {w}" for i, w in enumerate(codes.hart_weights()))


def hart(spark, d) -> DataFrame:
    c = F.concat(F.lpad((F.col("l_orderkey") % 10).cast("string"), 1, "0"), F.lpad((F.col("l_partkey") * 31 % 1000000).cast("string"), 6, "0"), F.lit("0"), F.col("l_linenumber"), F.col("l_suppkey") % 4, F.lpad((F.col("l_suppkey") % 100).cast("string"), 2, "0"), F.lpad(((F.col("l_orderkey") * 7 + F.col("l_partkey")) % 100).cast("string"), 2, "0"))
    return v.read(spark, d, "lineitem").select(c.alias("code"), "l_orderkey", "l_linenumber")


@query("h1_hart_fields", f"WITH c AS (SELECT DISTINCT {HART} AS code FROM lineitem) SELECT code, substr(code, 1, 1) AS sheet, substr(code, 2, 6) AS precinct, substr(code, 9, 1) AS page, substr(code, 10, 1) AS lang, substr(code, 11, 2) AS party, substr(code, 13, 2) AS checksum FROM c")
def _(spark, d):
    return hart(spark, d).select("code").distinct().withColumns(codes.hart_fields(F.col("code")))


@query("h2_b18_hart_checksum", f"WITH c AS (SELECT DISTINCT {HART} AS code FROM lineitem), s AS (SELECT code, (1 + {WEIGHTS}) % 97 AS t FROM c), k AS (SELECT code, CASE t WHEN 1 THEN 98 WHEN 0 THEN 97 ELSE t END AS checksum FROM s) SELECT code, CAST(checksum AS BIGINT) AS checksum, checksum = CAST(substr(code, 13, 2) AS INT) AS valid FROM k")
def _(spark, d):
    c = F.col("code")
    return hart(spark, d).select("code").distinct().select("code", codes.hart_checksum(c).cast("long").alias("checksum"), codes.hart_valid(c).alias("valid"))


DIG = {i: s for i, s in enumerate(codes.I2OF5)}
SYMBOL = "CASE {x} " + " ".join(f"WHEN {i} THEN '{s}'" for i, s in DIG.items()) + " END"


@query("h3_h4_i2of5", "SELECT p_partkey, lpad(CAST(p_partkey % 10000 AS VARCHAR), 4, '0') AS digits FROM part")
def _(spark, d):
    sym = F.array(*[F.lit(s) for s in codes.I2OF5])
    digits = F.split(F.lpad((F.col("p_partkey") % 10000).cast("string"), 4, "0"), "")
    bar = lambda i: F.get(sym, F.get(digits, F.lit(i)).cast("int"))
    pair = lambda a, b: F.array_join(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: F.concat(x, y)), "")
    bars = F.concat(F.lit("NNNN"), pair(bar(0), bar(1)), pair(bar(2), bar(3)), F.lit("WNN"))
    return v.read(spark, d, "part").withColumn("bars", bars).select("p_partkey", codes.i2of5_decode(F.col("bars")).alias("digits"))


BITS = "lpad(bin(CAST((l_orderkey * 2654435761 + l_partkey * 40503) % 4294967296 AS BIGINT)), 32, '0')"


def bits32(spark, d) -> DataFrame:
    n = (F.col("l_orderkey") * 2654435761 + F.col("l_partkey") * 40503) % 4294967296
    return v.read(spark, d, "lineitem").select(F.lpad(F.bin(n), 32, "0").alias("bits"), "l_orderkey", "l_linenumber").distinct()


@query("h8_diebold_fields", f"WITH b AS (SELECT DISTINCT {BITS} AS bits FROM lineitem) SELECT bits, substr(bits, 31, 2) AS \"check\", CAST(CAST('0b' || substr(bits, 18, 13) AS BIGINT) AS VARCHAR) AS precinct, CAST(CAST('0b' || substr(bits, 5, 13) AS BIGINT) AS VARCHAR) AS card, CAST(CAST('0b' || substr(bits, 2, 3) AS BIGINT) AS VARCHAR) AS seq, substr(bits, 1, 1) AS start FROM b")
def _(spark, d):
    return bits32(spark, d).select("bits").distinct().withColumns(codes.diebold_fields(F.col("bits")))


@query("h9_diebold_checksum", f"WITH b AS (SELECT DISTINCT {BITS} AS bits FROM lineitem) SELECT bits, length(replace(substr(bits, 1, 30), '0', '')) % 4 = CAST('0b' || substr(bits, 31, 2) AS BIGINT) AS valid, CASE WHEN starts_with(bits, '01111011110') THEN 1 ELSE 0 END AS page FROM b")
def _(spark, d):
    c = F.col("bits")
    return bits32(spark, d).select("bits").distinct().select("bits", codes.diebold_valid(c).alias("valid"), codes.diebold_page(c).alias("page"))


@query("h10_o34_guard_bits", f"WITH b AS (SELECT DISTINCT {BITS} AS bits, l_linenumber AS n FROM lineitem), r AS (SELECT CASE WHEN n = 1 THEN '0' ELSE '1' END || bits || CASE WHEN n = 2 THEN '' ELSE '1' END AS raw FROM b) SELECT raw, length(raw) = 34 AND raw[1] = '1' AND raw[34] = '1' AS sane, substr(raw, 2, 32) AS bits FROM r")
def _(spark, d):
    raw = F.concat(F.when(F.col("l_linenumber") == 1, "0").otherwise("1"), "bits", F.when(F.col("l_linenumber") == 2, "").otherwise("1"))
    return bits32(spark, d).select(raw.alias("raw")).distinct().select("raw", codes.diebold_sane(F.col("raw")).alias("sane"), codes.strip_guards(F.col("raw")).alias("bits"))


SQL["h10_o34_guard_bits"] = SQL["h10_o34_guard_bits"].replace("SELECT raw, length", "SELECT DISTINCT raw, length")


@query("h11_literal_info", "SELECT p_partkey, 0 AS page, '' AS info FROM part")
def _(spark, d):
    return v.read(spark, d, "part").select("p_partkey", F.lit(0).alias("page"), F.lit("").alias("info"))


@query("d22_bitstrings", "WITH m AS (SELECT DISTINCT l_orderkey, l_linenumber, CAST(MAX(l_quantity) OVER (PARTITION BY l_orderkey, l_linenumber) > 25 AS INT) AS bit FROM lineitem) SELECT l_orderkey, string_agg(CAST(bit AS VARCHAR), '' ORDER BY l_linenumber) AS bits FROM m GROUP BY 1")
def _(spark, d):
    m = v.read(spark, d, "lineitem").groupBy("l_orderkey", F.col("l_linenumber").alias("pos")).agg((F.max("l_quantity") > 25).cast("int").alias("digit"))
    return grouping.joined_digits(m, ["l_orderkey"]).select("l_orderkey", F.col("digits").alias("bits"))


@query("d17_majority_code", "WITH n AS (SELECT l_orderkey, l_returnflag AS code, COUNT(*) AS n FROM lineitem GROUP BY ALL), r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY l_orderkey ORDER BY n DESC, code) AS r FROM n) SELECT l_orderkey, code, n FROM r WHERE r = 1")
def _(spark, d):
    c = v.read(spark, d, "lineitem").select("l_orderkey", F.col("l_returnflag").alias("code"))
    return grouping.majority(c, ["l_orderkey"]).select("l_orderkey", "code", "n")


@query("d18_median_box", "SELECT l_returnflag, l_linestatus, median(l_quantity) AS x1, median(l_quantity + l_linenumber) AS x2 FROM lineitem GROUP BY ALL")
def _(spark, d):
    return v.read(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.median("l_quantity").alias("x1"), F.median(F.col("l_quantity") + F.col("l_linenumber")).alias("x2"))


@query("c21_first_image_inherits", f"WITH {v.MARK} SELECT DISTINCT ballot_id, page, first_value(choice) OVER (PARTITION BY ballot_id ORDER BY page, target_id) AS inherited FROM mark")
def _(spark, d):
    w = Window.partitionBy("ballot_id").orderBy("page", "target_id")
    return v.marks(spark, d).select("ballot_id", "page", F.first("choice").over(w).alias("inherited")).distinct()


@query("o39_decode_diff", f"WITH {v.MARK}, t AS (SELECT ballot_id, page, MIN(choice) AS true_code FROM mark GROUP BY ALL), g AS (SELECT ballot_id, page, CASE WHEN ballot_id % 10 = 0 THEN NULL WHEN ballot_id % 10 = 1 THEN true_code + 1 ELSE true_code END AS code FROM t) SELECT t.ballot_id, t.page, code, true_code FROM g JOIN t USING (ballot_id, page) WHERE code IS DISTINCT FROM true_code")
def _(spark, d):
    t = v.marks(spark, d).groupBy("ballot_id", "page").agg(F.min("choice").alias("true_code"))
    g = t.withColumn("code", F.when(F.col("ballot_id") % 10 == 1, F.col("true_code") + 1).when(F.col("ballot_id") % 10 != 0, F.col("true_code")))
    return g.where(~F.col("code").eqNullSafe(F.col("true_code"))).select("ballot_id", "page", "code", "true_code")


# --- partitions, attributes, groups -----------------------------------------------------------------


def codes_of(spark, d) -> DataFrame:
    return v.marks(spark, d).groupBy("ballot_id", "page").agg(F.max("cid").alias("code"))


CODES = f"{v.MARK}, codes AS (SELECT ballot_id, page, MAX(cid) AS code FROM mark GROUP BY ALL), tag AS (SELECT ballot_id, string_agg(code, '_' ORDER BY page, code) AS tag FROM codes GROUP BY 1), part_ AS (SELECT ballot_id, tag, CAST(DENSE_RANK() OVER (ORDER BY tag) - 1 AS BIGINT) AS partition_id FROM tag)"


@query("d8_partition_by_code", f"WITH {CODES} SELECT ballot_id, tag, partition_id FROM part_")
def _(spark, d):
    return grouping.partition_by_code(codes_of(spark, d)).select("ballot_id", "tag", "partition_id")


@query("d3_partition_stats", f"WITH {CODES}, n AS (SELECT partition_id, COUNT(*) AS n FROM part_ GROUP BY 1) SELECT CAST(COUNT(*) AS BIGINT) AS partitions, MAX(n) AS largest, MIN(n) AS smallest FROM n")
def _(spark, d):
    return grouping.partition_stats(grouping.partition_by_code(codes_of(spark, d)))


@query("d4_page_deviants", f"WITH {CODES}, p AS (SELECT CAST(partition_id // 5 AS BIGINT) AS partition_id, ballot_id, length(tag) AS pages FROM part_), k AS (SELECT *, MAX(pages) OVER (PARTITION BY partition_id) AS most FROM p), key AS (SELECT ballot_id, CASE WHEN pages < most THEN 'own:' || ballot_id ELSE 'part:' || partition_id END AS key FROM k) SELECT ballot_id, CAST(DENSE_RANK() OVER (ORDER BY key) - 1 AS BIGINT) AS new_partition FROM key")
def _(spark, d):
    p = grouping.partition_by_code(codes_of(spark, d)).select(F.floor(F.col("partition_id") / 5).alias("partition_id"), "ballot_id", F.length("tag").alias("pages"))
    return dense_ids(grouping.page_deviants(p), ["key"], "new_partition").select("ballot_id", "new_partition")


@query("e7_exemplars", f"WITH {CODES}, r AS (SELECT partition_id, ballot_id, ROW_NUMBER() OVER (PARTITION BY partition_id ORDER BY ballot_id) AS place FROM part_) SELECT partition_id, ballot_id, CAST(place AS INT) AS place FROM r WHERE place <= 5")
def _(spark, d):
    return pairing.first_n(grouping.partition_by_code(codes_of(spark, d)), ["partition_id"], ["ballot_id"], 5).select("partition_id", "ballot_id", "place")


@query("g3_b7_without_status", f"WITH {CODES}, {v.BALLOT} SELECT partition_id, CAST(COUNT(*) AS BIGINT) AS n FROM part_ WHERE ballot_id NOT IN (SELECT ballot_id FROM ballot WHERE status = 'quarantined') GROUP BY 1")
def _(spark, d):
    gone = v.ballots(spark, d).where("status = 'quarantined'")
    return grouping.without(grouping.partition_by_code(codes_of(spark, d)), gone).groupBy("partition_id").agg(F.count(F.lit(1)).alias("n"))


PROPS = "props AS (SELECT ballot_id, unnest([struct_pack(t := 'mode', v := mode), struct_pack(t := 'precinct', v := precinct), struct_pack(t := 'party', v := CAST(ballot_id % 3 AS VARCHAR))], recursive := true) FROM attr)"


def props(spark, d) -> DataFrame:
    a = v.attributes(spark, d)
    pairs = F.array(*[F.struct(F.lit(n).alias("attr_type"), c.alias("attr_val")) for n, c in (("mode", F.col("mode")), ("precinct", F.col("precinct")), ("party", (F.col("ballot_id") % 3).cast("string")))])
    return a.select("ballot_id", F.explode(pairs).alias("x")).select("ballot_id", "x.*")


@query("d6_b9_group_by_properties", f"WITH {v.ATTR}, {PROPS}, k AS (SELECT ballot_id, string_agg(t || '=' || v, ';' ORDER BY t, v) AS props FROM props WHERE t NOT IN ('mode') GROUP BY 1) SELECT ballot_id, props, CAST(DENSE_RANK() OVER (ORDER BY props) - 1 AS BIGINT) AS group_id FROM k")
def _(spark, d):
    return grouping.group_by_properties(props(spark, d), ["mode"]).select("ballot_id", "props", "group_id")


@query("d7_partitions_as_groups", f"WITH {CODES} SELECT ballot_id, partition_id AS group_id, 'pid=' || partition_id AS props FROM part_")
def _(spark, d):
    p = grouping.partition_by_code(codes_of(spark, d))
    return p.select("ballot_id", F.col("partition_id").alias("group_id"), F.concat(F.lit("pid="), "partition_id").alias("props"))


@query("c8_spread_attributes", f"WITH {CODES}, a AS (SELECT partition_id, MIN(tag) || '!' AS attr_val FROM part_ GROUP BY 1) SELECT ballot_id, attr_val FROM part_ JOIN a USING (partition_id)")
def _(spark, d):
    p = grouping.partition_by_code(codes_of(spark, d))
    values = p.groupBy("partition_id").agg(F.concat(F.min("tag"), F.lit("!")).alias("attr_val"))
    return grouping.spread(values, p.select("ballot_id", "partition_id"), "partition_id").select("ballot_id", "attr_val")


@query("c1_c2_c9_image_chain", f"WITH {v.IMAGE} SELECT i.image_path, i.ballot_id, CAST(ROW_NUMBER() OVER (PARTITION BY i.ballot_id ORDER BY i.page) - 1 AS INT) AS side, a.precinct FROM image i JOIN attr a USING (ballot_id)")
def _(spark, d):
    side = (F.row_number().over(Window.partitionBy("ballot_id").orderBy("page")) - 1).alias("side")
    return v.images(spark, d).select("image_path", "ballot_id", side).join(v.attributes(spark, d).select("ballot_id", "precinct"), "ballot_id").select("image_path", "ballot_id", "side", "precinct")


@query("c6_template_override", f"WITH {v.IMAGE}, e AS (SELECT dir_path, img_ord, MIN(image_path) AS exemplar FROM image GROUP BY ALL) SELECT image_path, CASE WHEN ballot_id % 2 = 0 THEN exemplar ELSE image_path END AS template FROM image JOIN e USING (dir_path, img_ord)")
def _(spark, d):
    i = v.images(spark, d)
    e = i.groupBy("dir_path", "img_ord").agg(F.min("image_path").alias("exemplar"))
    return pairing.templates(i, e, ["dir_path", "img_ord"], F.col("ballot_id") % 2 == 0)


@query("c7_attribute_audit", f"WITH {v.ATTR}, k AS (SELECT * FROM attr WHERE ballot_id % 5 <> 0) SELECT b.ballot_id, k.precinct, k.precinct IS NULL AND b.status <> 'quarantined' AS error FROM ballot b LEFT JOIN k USING (ballot_id)")
def _(spark, d):
    known = v.attributes(spark, d).where("ballot_id % 5 <> 0").select("ballot_id", "precinct")
    return grouping.audited(v.ballots(spark, d), known, "precinct", F.col("status") == "quarantined")


@query("c10_spreadsheet_join", "WITH m AS (SELECT 'k' || n_nationkey AS i, 'v' || (n_nationkey % 7) AS o FROM nation WHERE n_nationkey < 20) SELECT c_custkey, m.o AS attr_val, m.o IS NULL AS missing FROM customer LEFT JOIN m ON 'k' || c_nationkey = m.i")
def _(spark, d):
    sheet = v.read(spark, d, "nation").where("n_nationkey < 20").select(F.concat(F.lit("k"), "n_nationkey").alias("in"), F.concat(F.lit("v"), F.col("n_nationkey") % 7).alias("attr_val"))
    c = v.read(spark, d, "customer").withColumn("in", F.concat(F.lit("k"), "c_nationkey"))
    return c.join(sheet, "in", "left").select("c_custkey", "attr_val", F.col("attr_val").isNull().alias("missing"))


@query("c20_discarded_chain", f"WITH {v.IMAGE}, q AS (SELECT image_path FROM image WHERE ballot_id % 37 = 0 AND img_ord = 0) SELECT DISTINCT ballot_id FROM image JOIN q USING (image_path)")
def _(spark, d):
    i = v.images(spark, d)
    q = i.where("ballot_id % 37 = 0 and img_ord = 0").select("image_path")
    return i.join(q, "image_path", "left_semi").select("ballot_id").distinct()


@query("g1_g2_status_union", f"WITH {v.BALLOT}, {v.MARK} SELECT ballot_id FROM ballot WHERE status = 'quarantined' UNION SELECT ballot_id FROM mark WHERE intensity > 245 UNION SELECT ballot_id FROM ballot WHERE ballot_id % 41 = 0")
def _(spark, d):
    b, m = v.ballots(spark, d), v.marks(spark, d)
    return grouping.union_of(b.where("status = 'quarantined'"), m.where("intensity > 245"), b.where("ballot_id % 41 = 0"))


@query("b6_worst_status", f"WITH {v.BALLOT}, e AS (SELECT ballot_id, status FROM ballot UNION ALL SELECT ballot_id, 'discarded' FROM ballot WHERE ballot_id % 13 = 0 UNION ALL SELECT ballot_id, 'ok' FROM ballot) SELECT ballot_id, CASE MAX(CASE status WHEN 'discarded' THEN 2 WHEN 'quarantined' THEN 1 ELSE 0 END) WHEN 2 THEN 'discarded' WHEN 1 THEN 'quarantined' ELSE 'ok' END AS status FROM e GROUP BY 1")
def _(spark, d):
    b = v.ballots(spark, d).select("ballot_id", "status")
    return grouping.worst_status(b.unionByName(b.where("ballot_id % 13 = 0").withColumn("status", F.lit("discarded"))).unionByName(b.withColumn("status", F.lit("ok"))))


@query("b5_drop_bad_ballots", f"WITH {v.IMAGE} SELECT dir_path, CAST(COUNT(*) AS BIGINT) AS n FROM image WHERE ballot_id NOT IN (SELECT ballot_id FROM image WHERE page = 7) GROUP BY 1")
def _(spark, d):
    i = v.images(spark, d)
    return grouping.without(i, i.where("page = 7")).groupBy("dir_path").agg(F.count(F.lit(1)).alias("n"))


@query("g5_o4_fan_out", f"WITH {CODES}, p AS (SELECT DISTINCT partition_id FROM part_ WHERE ballot_id % 500 = 0 AND ballot_id % 1000 <> 0) SELECT ballot_id FROM part_ WHERE partition_id IN (SELECT partition_id FROM p) UNION SELECT ballot_id FROM part_ WHERE ballot_id % 1000 = 0")
def _(spark, d):
    p = grouping.partition_by_code(codes_of(spark, d))
    whole = p.where("ballot_id % 500 = 0 and ballot_id % 1000 <> 0").select("partition_id").distinct()
    return grouping.union_of(p.join(whole, "partition_id", "left_semi"), p.where("ballot_id % 1000 = 0"))


@query("o5_mark_fan_out", f"WITH {v.MARK}, b AS (SELECT DISTINCT ballot_id, page FROM mark WHERE intensity = 250) SELECT ballot_id, page, target_id FROM mark SEMI JOIN b USING (ballot_id, page)")
def _(spark, d):
    m = v.marks(spark, d)
    return m.join(m.where("intensity = 250").select("ballot_id", "page").distinct(), ["ballot_id", "page"], "left_semi").select("ballot_id", "page", "target_id")


@query("o6_image_quarantine", f"WITH {v.ATTR}, {PROPS} SELECT t AS attr_type, CAST(COUNT(*) AS BIGINT) AS n FROM props WHERE ballot_id NOT IN (SELECT ballot_id FROM props WHERE t = 'party' AND v = '1') GROUP BY 1")
def _(spark, d):
    p = props(spark, d)
    return grouping.without(p, p.where("attr_type = 'party' and attr_val = '1'")).groupBy("attr_type").agg(F.count(F.lit(1)).alias("n"))


@query("g6_attribute_types", f"WITH {v.ATTR}, {PROPS} SELECT DISTINCT t AS attr_type FROM props")
def _(spark, d):
    return props(spark, d).select("attr_type").distinct()


@query("b8_o21_attribute_predicates", f"WITH {v.ATTR}, {PROPS} SELECT bool_or(t = 'mode') AS has_mode, bool_or(t = 'digit') AS has_digit, CASE WHEN bool_or(t = 'party') THEN 'per ballot' ELSE 'per partition' END AS digit_mode FROM props")
def _(spark, d):
    return props(spark, d).agg(F.bool_or(F.col("attr_type") == "mode").alias("has_mode"), F.bool_or(F.col("attr_type") == "digit").alias("has_digit"), F.when(F.bool_or(F.col("attr_type") == "party"), "per ballot").otherwise("per partition").alias("digit_mode"))


@query("g4_merge_groups", f"WITH {v.ATTR}, {PROPS}, u AS (SELECT ballot_id, t, v, 0 AS src FROM props UNION ALL SELECT ballot_id, 'party', 'late', 1 FROM ballot WHERE ballot_id % 4 = 0) SELECT ballot_id, t AS attr_type, arg_max(v, src) AS attr_val FROM u GROUP BY ballot_id, t")
def _(spark, d):
    later = v.ballots(spark, d).where("ballot_id % 4 = 0").select("ballot_id", F.lit("party").alias("attr_type"), F.lit("late").alias("attr_val"))
    return grouping.merged(props(spark, d), later, ["ballot_id", "attr_type"], "attr_val")


@query("g7_value_domain", f"WITH {v.ATTR}, dom AS (SELECT n_name AS precinct, CAST(k AS VARCHAR) AS party FROM nation, range(4) t(k)), n AS (SELECT precinct, CAST(ballot_id % 3 AS VARCHAR) AS party, COUNT(*) AS n FROM attr GROUP BY ALL) SELECT precinct, party, CAST(COALESCE(n, 0) AS BIGINT) AS n FROM dom LEFT JOIN n USING (precinct, party)")
def _(spark, d):
    domain = v.read(spark, d, "nation").select(F.col("n_name").alias("precinct"), F.explode(F.array(*[F.lit(str(k)) for k in range(4)])).alias("party"))
    return grouping.value_domain(domain, v.attributes(spark, d).withColumn("party", (F.col("ballot_id") % 3).cast("string")), ["precinct", "party"])


@query("d23_g8_counter_ops", "WITH a AS (SELECT o_custkey AS k, COUNT(*) AS n FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1), b AS (SELECT o_custkey AS k, COUNT(*) AS n FROM orders WHERE o_orderkey % 3 = 0 GROUP BY 1), j AS (SELECT k, COALESCE(a.n, 0) AS x, COALESCE(b.n, 0) AS y FROM a FULL JOIN b USING (k)), u AS (SELECT '+' AS op, k, x + y AS n FROM j UNION ALL SELECT '-', k, x - y FROM j UNION ALL SELECT '|', k, GREATEST(x, y) FROM j UNION ALL SELECT '&', k, LEAST(x, y) FROM j) SELECT op, k, n FROM u WHERE n > 0")
def _(spark, d):
    o = v.read(spark, d, "orders").withColumnRenamed("o_custkey", "k")
    a, b = (grouping.counter(o.where(f"o_orderkey % {m} = 0"), "k") for m in (2, 3))
    out = None
    for op in "+-|&":
        one = grouping.counter_op(a, b, "k", op).select(F.lit(op).alias("op"), "k", "n")
        out = one if out is None else out.unionByName(one)
    return out


@query("g8_multiset_except", "SELECT l_returnflag, l_linenumber FROM lineitem WHERE l_linestatus = 'F' EXCEPT ALL SELECT l_returnflag, l_linenumber FROM lineitem WHERE l_linestatus = 'O'")
def _(spark, d):
    x = v.read(spark, d, "lineitem")
    return x.where("l_linestatus = 'F'").select("l_returnflag", "l_linenumber").exceptAll(x.where("l_linestatus = 'O'").select("l_returnflag", "l_linenumber"))


@query("d21_joined_digits", "WITH p AS (SELECT l_orderkey, l_linenumber - 1 AS pos, MIN(CAST(l_quantity AS INT) % 10) AS digit FROM lineitem GROUP BY ALL) SELECT l_orderkey, string_agg(CAST(digit AS VARCHAR), '' ORDER BY pos) AS digits, MIN(pos) = 0 AND MAX(pos) = COUNT(*) - 1 AS contiguous FROM p GROUP BY 1")
def _(spark, d):
    p = v.read(spark, d, "lineitem").groupBy("l_orderkey", (F.col("l_linenumber") - 1).alias("pos")).agg(F.min(F.col("l_quantity").cast("int") % 10).alias("digit"))
    return grouping.joined_digits(p, ["l_orderkey"])


@query("d19_median_gap", "WITH g AS (SELECT o_custkey, LEAD(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - o_orderkey AS gap FROM orders), l AS (SELECT o_custkey, list(gap ORDER BY gap) AS g FROM g WHERE gap IS NOT NULL GROUP BY 1) SELECT o_custkey, CASE WHEN len(g) <= 2 THEN g[1] ELSE g[CAST(FLOOR(len(g) / 2) AS INT) + 1] END AS median_gap FROM l")
def _(spark, d):
    return grouping.upper_median_gap(v.read(spark, d, "orders"), ["o_custkey"], "o_orderkey")


@query("d27_text_lengths", "SELECT lang, CAST(SUM(length(text)) AS BIGINT) AS n FROM documents GROUP BY lang")
def _(spark, d):
    return v.read(spark, d, "documents").groupBy("lang").agg(F.sum(F.length("text")).alias("n"))


@query("d28_quarantine_counts", f"WITH {v.BALLOT} SELECT CAST(COUNT(*) FILTER (WHERE status = 'quarantined') AS BIGINT) AS quarantined, CAST(COUNT(*) FILTER (WHERE status = 'ok') AS BIGINT) AS past FROM ballot")
def _(spark, d):
    return v.ballots(spark, d).agg(F.count(F.when(F.col("status") == "quarantined", 1)).alias("quarantined"), F.count(F.when(F.col("status") == "ok", 1)).alias("past"))


@query("h12_custom_attribute", f"WITH {v.IMAGE} SELECT ballot_id, regexp_extract(image_path, '/NATION_([0-9]+)/', 1) AS attr_val FROM image WHERE img_ord = 0")
def _(spark, d):
    return v.images(spark, d).where("img_ord = 0").select("ballot_id", F.regexp_extract("image_path", "/NATION_([0-9]+)/", 1).alias("attr_val"))


@query("h13_language_code", "SELECT doc_id, CASE lang WHEN 'es' THEN 'spa' WHEN 'fr' THEN 'fra' WHEN 'de' THEN 'deu' ELSE 'eng' END AS code FROM documents")
def _(spark, d):
    name = F.when(F.col("lang") == "es", "Spanish").when(F.col("lang") == "fr", "French").when(F.col("lang") == "de", "GERMAN").otherwise("english")
    return v.read(spark, d, "documents").select("doc_id", contests.language_code(name).alias("code"))


@query("h14_attribute_name", "SELECT n_nationkey, array_to_string(list_sort(['z' || n_nationkey % 3, n_name, 'm']), '_') AS name FROM nation")
def _(spark, d):
    return v.read(spark, d, "nation").select("n_nationkey", F.array_join(F.array_sort(F.array(F.concat(F.lit("z"), F.col("n_nationkey") % 3), "n_name", F.lit("m"))), "_").alias("name"))


@query("h24_path_functions", f"WITH {v.IMAGE} SELECT image_path, file_name AS name, regexp_replace(file_name, '\\.[^.]*$', '') AS stem, dir_path AS dir, split_part(dir_path, '/', 2) AS parent, CASE WHEN starts_with(image_path, 'ASIA/') THEN substr(image_path, 6) ELSE image_path END AS rel FROM image")
def _(spark, d):
    p = F.col("image_path")
    return v.images(spark, d).select("image_path", paths.file_name(p).alias("name"), paths.stem(p).alias("stem"), paths.directory(p).alias("dir"), paths.parent_name(p).alias("parent"), paths.relative_to(p, "ASIA").alias("rel"))


@query("o38_directory_vendor", f"WITH {v.IMAGE} SELECT image_path, CAST(DENSE_RANK() OVER (ORDER BY split_part(dir_path, '/', 2)) - 1 AS BIGINT) AS style FROM image")
def _(spark, d):
    i = v.images(spark, d).withColumn("parent", paths.parent_name(F.col("image_path")))
    return dense_ids(i, ["parent"], "style").select("image_path", "style")


@query("o36_pairs_of_images", f"WITH {v.IMAGE} SELECT image_path, CAST(img_ord // 2 AS BIGINT) AS pair_no, CASE WHEN img_ord % 2 = 1 THEN 'BACK' ELSE 'FRONT' END AS side FROM image")
def _(spark, d):
    return v.images(spark, d).select("image_path", F.floor(F.col("img_ord") / 2).alias("pair_no"), F.when(F.col("img_ord") % 2 == 1, "BACK").otherwise("FRONT").alias("side"))


@query("o40_patch_names", f"WITH {v.MARK} SELECT ballot_id, target_id, 'd' || ((ROW_NUMBER() OVER (PARTITION BY ballot_id, page ORDER BY target_id) - 1) // 750) || '/' || ballot_id || '_' || page || '_' || (ROW_NUMBER() OVER (PARTITION BY ballot_id, page ORDER BY target_id) - 1) || '.png' AS name FROM mark")
def _(spark, d):
    k = F.row_number().over(Window.partitionBy("ballot_id", "page").orderBy("target_id")) - 1
    name = F.concat(F.lit("d"), F.floor(k / 750), F.lit("/"), F.concat_ws("_", "ballot_id", "page", k), F.lit(".png"))
    return v.marks(spark, d).select("ballot_id", "target_id", name.alias("name"))


@query("o1_rank_votes", "WITH r AS (SELECT c_nationkey, c_mktsegment AS label, (c_custkey + length(c_mktsegment)) % 4 AS pos FROM customer), w AS (SELECT c_nationkey, label, SUM(pow(0.5, pos)) AS weight FROM r GROUP BY ALL) SELECT c_nationkey, label, ROUND(weight, 6) AS weight, CAST(ROW_NUMBER() OVER (PARTITION BY c_nationkey ORDER BY weight DESC, label) AS INT) AS place FROM w")
def _(spark, d):
    pos = ((F.col("c_custkey") + F.length("c_mktsegment")) % 4).cast("int")
    lists = v.read(spark, d, "customer").select("c_nationkey", F.concat(F.array_repeat(F.lit(None).cast("string"), pos), F.array("c_mktsegment")).alias("labels"))
    voted = grouping.rank_votes(lists.select("c_nationkey", "labels"), ["c_nationkey"])
    ranked = voted.where("label is not null")
    return ranked.withColumn("place", F.row_number().over(Window.partitionBy("c_nationkey").orderBy(F.desc("weight"), "label"))).select("c_nationkey", "label", F.round("weight", 6).alias("weight"), "place")


@query("o3_merge_same_label", f"WITH {v.ATTR}, {PROPS} SELECT t AS attr_type, v AS attr_val, CAST(COUNT(DISTINCT ballot_id) AS BIGINT) AS members FROM props GROUP BY ALL")
def _(spark, d):
    p = props(spark, d)
    return p.unionByName(p.where("ballot_id % 2 = 0")).groupBy("attr_type", "attr_val").agg(F.count_distinct("ballot_id").alias("members"))


@query("o8_first_definition", "SELECT p_type, arg_min(p_brand, p_partkey) AS brand FROM part GROUP BY 1")
def _(spark, d):
    return v.read(spark, d, "part").groupBy("p_type").agg(F.min_by("p_brand", "p_partkey").alias("brand"))


@query("o18_o19_label_progress", "WITH l AS (SELECT item_id, CASE WHEN item_id % 3 = 0 THEN '' ELSE 'Contest ' || item_id END AS text FROM benchmark) SELECT CAST(COUNT(*) FILTER (WHERE text <> '') AS BIGINT) AS done, CAST(COUNT(*) AS BIGINT) AS n FROM l")
def _(spark, d):
    l = v.read(spark, d, "benchmark").select(F.when(F.col("item_id") % 3 == 0, "").otherwise(F.concat(F.lit("Contest "), "item_id")).alias("text"))
    return l.agg(F.count_if(F.col("text") != "").alias("done"), F.count(F.lit(1)).alias("n"))


@query("o25_interleave", "WITH a AS (SELECT c_custkey AS id, c_nationkey AS list_no, ROW_NUMBER() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS k FROM customer) SELECT id, CAST(ROW_NUMBER() OVER (ORDER BY k, list_no) AS BIGINT) AS place FROM a")
def _(spark, d):
    a = v.read(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("list_no")).withColumn("k", F.row_number().over(Window.partitionBy("list_no").orderBy("id")))
    return global_rank(a, [F.col("k")], ["list_no"], "place").select("id", (F.col("place") + 1).alias("place"))


# --- thresholds -----------------------------------------------------------------------------------


@query("d16_histogram", f"WITH {v.MARK}, n AS (SELECT intensity, COUNT(*) AS n FROM mark GROUP BY 1) SELECT CAST(i AS INT) AS intensity, CAST(COALESCE(n, 0) AS BIGINT) AS n FROM range(256) t(i) LEFT JOIN n ON n.intensity = i")
def _(spark, d):
    return threshold.histogram(v.marks(spark, d)).select("intensity", "n")


GAUSS = f"""h AS (SELECT CAST(k AS INT) AS i, COALESCE(m.n, 0) AS n FROM range(256) t(k) LEFT JOIN (SELECT intensity, COUNT(*) AS n FROM mark GROUP BY 1) m ON m.intensity = k),
b AS (SELECT CAST(l AS INT) AS line, i, n, i >= l AS side FROM range(1, 255) t(l), h),
s AS (SELECT line, side, SUM(n) AS total, SUM(i * n) / SUM(n) AS mean FROM b GROUP BY ALL HAVING COUNT(*) FILTER (WHERE n > 0) > 1),
d AS (SELECT b.line, b.side, total, mean, sqrt(SUM((mean - i) * (mean - i) * (n / total))) AS dev FROM b JOIN s USING (line, side) GROUP BY ALL),
e AS (SELECT b.line, COALESCE(SUM(ABS(n / total - pow(2.71, -((i - mean) * (i - mean)) / (2 * dev * dev)) / sqrt(2 * 3.14 * dev * dev))), 0) AS error FROM b LEFT JOIN d USING (line, side) GROUP BY 1)"""


def _split_marks(spark, d):
    return threshold.histogram(v.marks(spark, d))


@query("e10_threshold_errors", f"WITH {v.MARK}, {GAUSS} SELECT line, ROUND(error, 6) AS error FROM e")
def _(spark, d):
    return threshold.threshold_errors(_split_marks(spark, d)).select("line", F.round("error", 6).alias("error"))


@query("e10_best_line", f"WITH {v.MARK}, {GAUSS}, r AS (SELECT line, ROUND(error, 9) AS error FROM e) SELECT line, error FROM r ORDER BY error, line LIMIT 1")
def _(spark, d):
    return threshold.best_line(threshold.threshold_errors(_split_marks(spark, d)))


@query("i5_otsu", f"WITH {v.MARK}, h AS (SELECT i, COALESCE(n, 0) AS n FROM range(256) t(i) LEFT JOIN (SELECT intensity, COUNT(*) AS n FROM mark GROUP BY 1) m ON m.intensity = i), w AS (SELECT i, COALESCE(SUM(n) OVER p, 0) AS w0, COALESCE(SUM(n * i) OVER p, 0) AS s0, SUM(n) OVER () AS a, SUM(n * i) OVER () AS s FROM h WINDOW p AS (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), b AS (SELECT CAST(i AS INT) AS line, ROUND(w0 * CAST(a - w0 AS DOUBLE) * (s0 / w0 - (s - s0) / (a - w0)) * (s0 / w0 - (s - s0) / (a - w0)), 3) AS between FROM w WHERE w0 > 0 AND w0 < a) SELECT line FROM b ORDER BY between DESC, line LIMIT 1".replace("between", "betw").replace("ROWS betw", "ROWS BETWEEN"))
def _(spark, d):
    return threshold.otsu(threshold.histogram(v.marks(spark, d))).select("line")


@query("e11_outliers", "WITH o AS (SELECT o_custkey, o_orderkey, o_totalprice AS x, (MAX(o_totalprice) OVER (PARTITION BY o_custkey) - MIN(o_totalprice) OVER (PARTITION BY o_custkey)) / 2 AS h FROM orders), f AS (SELECT *, CAST(COALESCE(x - LEAD(x, 1) OVER w > h, FALSE) OR COALESCE(x - LEAD(x, 2) OVER w > h, FALSE) AS INT) AS hit FROM o WINDOW w AS (PARTITION BY o_custkey ORDER BY x DESC, o_orderkey)) SELECT o_custkey, o_orderkey, MIN(hit) OVER (PARTITION BY o_custkey ORDER BY x DESC, o_orderkey ROWS UNBOUNDED PRECEDING) = 1 AS outlier FROM f")
def _(spark, d):
    o = v.read(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return threshold.outliers(o, ["o_custkey"], "o_totalprice", ["o_orderkey"], 2).select("o_custkey", "o_orderkey", "outlier")


@query("e12_column_islands", "WITH f AS (SELECT o_custkey, o_orderkey, CASE WHEN o_orderkey - LAG(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) <= 500 THEN 0 ELSE 1 END AS s FROM orders) SELECT o_custkey, o_orderkey, CAST(SUM(s) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING) - 1 AS BIGINT) AS col_no FROM f")
def _(spark, d):
    return threshold.columns_of(v.read(spark, d, "orders").select("o_custkey", "o_orderkey"), ["o_custkey"], "o_orderkey", 1000).select("o_custkey", "o_orderkey", "col_no")


@query("e14_lonely", "SELECT o_custkey, o_orderkey, COALESCE(o_orderkey - LAG(o_orderkey) OVER w, 1e18) > 800 AND COALESCE(LEAD(o_orderkey) OVER w - o_orderkey, 1e18) > 800 AS lonely FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)")
def _(spark, d):
    return threshold.lonely(v.read(spark, d, "orders").select("o_custkey", "o_orderkey"), ["o_custkey"], "o_orderkey", 400).select("o_custkey", "o_orderkey", "lonely")


@query("d15_o44_mean_intensity", "SELECT vec_id, ROUND(list_avg(embedding::DOUBLE[]), 6) AS mean FROM embeddings")
def _(spark, d):
    e = v.read(spark, d, "embeddings")
    return e.select("vec_id", F.round(threshold.mean_intensity(F.col("embedding").cast("array<double>")), 6).alias("mean"))


@query("d20_pixel_sigma", "WITH p AS (SELECT label, unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings) SELECT label, CAST(pos AS INT) AS pos, ROUND(stddev_pop(x), 6) AS sigma FROM p GROUP BY ALL")
def _(spark, d):
    e = v.read(spark, d, "embeddings").select("label", F.posexplode(F.col("embedding").cast("array<double>")).alias("pos", "x"))
    return e.groupBy("label", "pos").agg(F.round(F.stddev_pop("x"), 6).alias("sigma"))


@query("d25_overlays", "WITH p AS (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings) SELECT label, CAST(pos AS INT) AS pos, MIN(x) AS low, MAX(x) AS high FROM p GROUP BY ALL")
def _(spark, d):
    e = v.read(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("pos", "x"))
    return e.groupBy("label", "pos").agg(F.min("x").alias("low"), F.max("x").alias("high"))


@query("o24_lightest", "WITH m AS (SELECT label, vec_id, ROUND(list_avg(embedding::DOUBLE[]), 9) AS mean FROM embeddings) SELECT label, arg_max(vec_id, struct_pack(m := mean, k := -vec_id)) AS vec_id FROM m GROUP BY 1")
def _(spark, d):
    e = v.read(spark, d, "embeddings").select("label", "vec_id", F.round(threshold.mean_intensity(F.col("embedding").cast("array<double>")), 9).alias("m"))
    return e.groupBy("label").agg(F.max_by("vec_id", F.struct("m", -F.col("vec_id"))).alias("vec_id"))


# --- layout ---------------------------------------------------------------------------------------

BOX = "bx AS (SELECT l_orderkey AS g, ROW_NUMBER() OVER (PARTITION BY l_orderkey ORDER BY " + ", ".join(v.LINE) + ") AS target_id, CAST(l_partkey % 200 AS INT) AS x, CAST(l_suppkey % 100 AS INT) AS y, CAST(l_quantity AS INT) AS w, l_linenumber * 4 AS h FROM lineitem)"


def boxes(spark, d) -> DataFrame:
    own = Window.partitionBy("l_orderkey").orderBy(*v.LINE)
    return v.read(spark, d, "lineitem").select(F.col("l_orderkey").alias("g"), F.row_number().over(own).cast("long").alias("target_id"), (F.col("l_partkey") % 200).cast("int").alias("x"), (F.col("l_suppkey") % 100).cast("int").alias("y"), F.col("l_quantity").cast("int").alias("w"), (F.col("l_linenumber") * 4).alias("h"))


BIG = f"{BOX}, t AS (SELECT * FROM bx WHERE target_id % 2 = 0), c AS (SELECT g, target_id AS contest_id, x, y, w * 3 AS w, h * 3 AS h FROM bx WHERE target_id % 2 = 1), asg AS (SELECT t.g, t.target_id, MIN(c.contest_id) AS contest_id FROM t LEFT JOIN c ON t.g = c.g AND c.x <= t.x + round(0.1::DOUBLE * t.w) AND c.y <= t.y + round(0.1::DOUBLE * t.h) AND t.x + t.w - round(0.1::DOUBLE * t.w) <= c.x + c.w AND t.y + t.h - round(0.1::DOUBLE * t.h) <= c.y + c.h GROUP BY ALL)"


def big(spark, d):
    b = boxes(spark, d)
    return b.where("target_id % 2 = 0"), b.where("target_id % 2 = 1").select("g", F.col("target_id").alias("contest_id"), "x", "y", (F.col("w") * 3).alias("w"), (F.col("h") * 3).alias("h"))


@query("c12_o13_assign_targets", f"WITH {BIG} SELECT g, target_id, contest_id FROM asg")
def _(spark, d):
    t, c = big(spark, d)
    return layout.assign_targets(t, c, ["g"]).select("g", "target_id", "contest_id")


@query("c13_boxes_within", f"WITH {BIG} SELECT c.g, c.contest_id, CAST(COUNT(*) AS BIGINT) AS n FROM c JOIN t ON t.g = c.g AND t.x >= c.x - t.w / 3 AND t.y >= c.y - t.h / 3 AND t.x + t.w <= c.x + c.w + t.w / 3 AND t.y + t.h <= c.y + c.h + t.h / 3 GROUP BY ALL")
def _(spark, d):
    t, c = big(spark, d)
    return layout.targets_within(c, t, ["g"])


@query(
    "c15_adjacent",
    f"""WITH {BIG}, p AS (SELECT a.g, a.contest_id AS a_id, b.contest_id AS b_id, CASE WHEN a.x <= b.x THEN a ELSE b END AS lf, CASE WHEN a.x > b.x THEN a ELSE b END AS rg, 0.2 * LEAST(a.w, b.w) AS mw, 0.2 * LEAST(a.h, b.h) AS mh FROM c a JOIN c b ON a.g = b.g AND a.contest_id < b.contest_id),
q AS (SELECT *, CASE WHEN lf.y <= rg.y THEN lf ELSE rg END AS tp, CASE WHEN lf.y > rg.y THEN lf ELSE rg END AS bt FROM p)
SELECT g, a_id, b_id FROM q WHERE (ABS(tp.y + tp.h - bt.y) < mh AND NOT (lf.x < rg.x AND lf.x + lf.w < rg.x)) OR (ABS(lf.x + lf.w - rg.x) < mw AND NOT (tp.y < bt.y AND tp.y + tp.h < bt.y))""",
)
def _(spark, d):
    return layout.adjacent(big(spark, d)[1], ["g"])


@query("h19_h20_box_algebra", f"WITH {BOX}, p AS (SELECT a.g, a.target_id, a.x AS ax1, a.y AS ay1, a.x + a.w AS ax2, a.y + a.h AS ay2, b.x AS bx1, b.y AS by1, b.x + b.w AS bx2, b.y + b.h AS by2 FROM bx a JOIN bx b ON a.g = b.g AND a.target_id + 1 = b.target_id) SELECT g, target_id, CAST((ax2 - ax1) * (ay2 - ay1) AS BIGINT) AS area, CAST(GREATEST(0, LEAST(ax2, bx2) - GREATEST(ax1, bx1)) * GREATEST(0, LEAST(ay2, by2) - GREATEST(ay1, by1)) AS BIGINT) AS common, CAST(LEAST(ax1, bx1) AS BIGINT) AS ux1, CAST(GREATEST(ay2, by2) AS BIGINT) AS uy2 FROM p")
def _(spark, d):
    corners = layout.canonical(F.col("x") + F.col("w"), F.col("y"), F.col("x"), F.col("y") + F.col("h"))
    b = boxes(spark, d).select("g", "target_id", *[c.alias(n) for c, n in zip(corners, ("x1", "y1", "x2", "y2"))])
    j = b.alias("a").join(b.alias("b"), (F.col("a.g") == F.col("b.g")) & (F.col("a.target_id") + 1 == F.col("b.target_id")))
    u = layout.union_box("a", "b")
    return j.select("a.g", "a.target_id", layout.area("a").cast("long").alias("area"), layout.common_area("a", "b").cast("long").alias("common"), u[0].cast("long").alias("ux1"), u[3].cast("long").alias("uy2"))


@query("h21_clamp", f"WITH {BOX}, b AS (SELECT g, target_id, x - 20 AS x1, y - 10 AS y1, x + w AS x2, y + h AS y2 FROM bx), k AS (SELECT *, GREATEST(0, LEAST(x1, 119)) AS cx, GREATEST(0, LEAST(y1, 79)) AS cy FROM b) SELECT g, target_id, CAST(cx AS BIGINT) AS x1, CAST(cy AS BIGINT) AS y1, CAST(GREATEST(cx + 1, LEAST(x2, 120)) AS BIGINT) AS x2, CAST(GREATEST(cy + 1, LEAST(y2, 80)) AS BIGINT) AS y2 FROM k")
def _(spark, d):
    b = boxes(spark, d).select("g", "target_id", (F.col("x") - 20).alias("x1"), (F.col("y") - 10).alias("y1"), (F.col("x") + F.col("w")).alias("x2"), (F.col("y") + F.col("h")).alias("y2"))
    return b.select("g", "target_id", *[c.cast("long").alias(n) for n, c in layout.clamp(120, 80).items()])


@query("o29_expand", f"WITH {BOX}, b AS (SELECT g, target_id, x AS x1, y AS y1, x + w AS x2, y + h AS y2 FROM bx) SELECT g, target_id, CAST(GREATEST(0, x1 - FLOOR((x2 - x1) * 0.5)) AS BIGINT) AS x1, CAST(GREATEST(0, y1 - FLOOR((y2 - y1) * 0.5)) AS BIGINT) AS y1, CAST(LEAST(220, x2 + FLOOR((x2 - x1) * 0.5)) AS BIGINT) AS x2, CAST(LEAST(120, y2 + FLOOR((y2 - y1) * 0.5)) AS BIGINT) AS y2 FROM b")
def _(spark, d):
    b = boxes(spark, d).select("g", "target_id", F.col("x").alias("x1"), F.col("y").alias("y1"), (F.col("x") + F.col("w")).alias("x2"), (F.col("y") + F.col("h")).alias("y2"))
    return b.select("g", "target_id", *[c.cast("long").alias(n) for n, c in layout.expanded(0.5, 220, 120).items()])


@query("o12_bounding_box", f"WITH {BOX} SELECT g, MIN(x) AS x1, MIN(y) AS y1, MAX(x + w) AS x2, MAX(y + h) AS y2 FROM bx GROUP BY g")
def _(spark, d):
    return layout.bounding_box(boxes(spark, d), ["g"])


@query("o30_grid_cells", f"WITH {BOX} SELECT CAST(LEAST(3, FLOOR((x + w / 2) / 60)) AS INT) AS cx, CAST(LEAST(3, FLOOR((y + h / 2) / 32)) AS INT) AS cy, CAST(COUNT(*) AS BIGINT) AS n FROM bx GROUP BY ALL")
def _(spark, d):
    b = boxes(spark, d).select(layout.cell(F.col("x") + F.col("w") / 2, 60, 4).alias("cx"), layout.cell(F.col("y") + F.col("h") / 2, 32, 4).alias("cy"))
    return b.groupBy("cx", "cy").agg(F.count(F.lit(1)).alias("n"))


@query("o43_target_size", f"WITH {BOX} SELECT DISTINCT w, h FROM bx")
def _(spark, d):
    return boxes(spark, d).select("w", "h").distinct()


@query("o11_single_contests", f"WITH {BOX} SELECT g, target_id, target_id AS contest_id, x, y FROM bx")
def _(spark, d):
    return layout.single_contests(boxes(spark, d)).select("g", "target_id", "contest_id", "x", "y")


@query("b17_box_checks", f"WITH {BIG}, r AS (SELECT 'target outside all contests' AS rule, TRUE AS fatal, COUNT(*) AS n FROM asg WHERE contest_id IS NULL UNION ALL SELECT 'contest without targets', FALSE, COUNT(*) FROM c ANTI JOIN (SELECT DISTINCT g, contest_id FROM asg WHERE contest_id IS NOT NULL) a USING (g, contest_id) UNION ALL SELECT 'target of no size', TRUE, COUNT(*) FROM t WHERE w <= 0 OR h <= 0) SELECT rule, fatal, CAST(n AS BIGINT) AS n, n = 0 AS ok FROM r")
def _(spark, d):
    t, c = big(spark, d)
    return layout.box_checks(t, c, ["g"])


@query("d24_layout_scores", f"WITH {BOX}, l AS (SELECT g, COUNT(*) AS n_targets, CAST(MIN(w) // 10 AS INT) AS width, MAX(h) AS height FROM bx GROUP BY g), a AS (SELECT COUNT(*) AS m FROM l), s AS (SELECT g, ln(COUNT(*) OVER (PARTITION BY n_targets) / m) + ln(COUNT(*) OVER (PARTITION BY width) / m) + ln(COUNT(*) OVER (PARTITION BY height) / m) AS score FROM l, a) SELECT g, ROUND(score, 6) AS score FROM s")
def _(spark, d):
    l = boxes(spark, d).groupBy("g").agg(F.count(F.lit(1)).alias("n_targets"), F.floor(F.min("w") / 10).alias("width"), F.max("h").alias("height"))
    return layout.layout_scores(l, ["n_targets", "width", "height"]).select("g", F.round("score", 6).alias("score"))


@query("h26_resize_factor", "SELECT p_partkey, ROUND(LEAST(1.0, GREATEST(LEAST(1.0, 300.0 / GREATEST(p_size * 20, p_partkey % 900 + 50)), 100.0 / LEAST(p_size * 20, p_partkey % 900 + 50))), 6) AS f FROM part")
def _(spark, d):
    f = layout.resize_factor(F.col("p_size") * 20, F.col("p_partkey") % 900 + 50, 300, 100)
    return v.read(spark, d, "part").select("p_partkey", F.round(f, 6).alias("f"))


@query("o32_rotation", "SELECT o_custkey % 20 AS k, ROUND(degrees(atan(regr_slope(o_totalprice / 1000, o_orderkey))), 6) AS angle FROM orders GROUP BY 1")
def _(spark, d):
    found = layout.slope_angle(v.read(spark, d, "orders"), (F.col("o_custkey") % 20).alias("k"), F.col("o_orderkey"), F.col("o_totalprice") / 1000)
    return found.select("k", F.round("angle", 6).alias("angle"))


@query("o47_trimmed_mean", "WITH r AS (SELECT o_custkey % 20 AS k, o_totalprice AS x, ROW_NUMBER() OVER (PARTITION BY o_custkey % 20 ORDER BY o_totalprice, o_orderkey) AS r, COUNT(*) OVER (PARTITION BY o_custkey % 20) AS n FROM orders) SELECT k, ROUND(AVG(x), 4) AS mean FROM r WHERE r > FLOOR(n / 4) AND r <= n - FLOOR(n / 4) GROUP BY k")
def _(spark, d):
    o = v.read(spark, d, "orders").withColumn("k", F.col("o_custkey") % 20)
    return trimmed_mean(o, "k", "o_totalprice", ["o_orderkey"]).select("k", F.round("mean", 4).alias("mean"))


# --- contest identity -------------------------------------------------------------------------------

#: Contest texts: the whole of each text in quarters, a title and three choices.  Characters beyond ASCII are one sign, as DuckDB's levenshtein counts bytes.
TEXTS = "tx AS (SELECT item_id AS id, item_id % 3 AS block, text[1:q] AS title, [text[q + 1:2 * q], text[2 * q + 1:3 * q], text[3 * q + 1:]] AS choices, text FROM (SELECT item_id, regexp_replace(text, '[^ -~]', '~', 'g') AS text, length(text) // 4 AS q FROM benchmark))"


def texts(spark, d) -> DataFrame:
    q = F.floor(F.length("text") / 4).cast("int")
    part = lambda k, n: F.col("text").substr(q * k + 1, n)
    ascii_text = v.read(spark, d, "benchmark").withColumn("text", F.regexp_replace("text", "[^ -~]", "~"))
    b = ascii_text.select(F.col("item_id").alias("id"), (F.col("item_id") % 3).alias("block"), part(0, q).alias("title"), F.array(part(1, q), part(2, q), part(3, F.length("text"))).alias("choices"), "text")
    return b.withColumn("size", F.aggregate("choices", F.lit(0), lambda s, t: s + F.length(t)))


@query("c16_c17_h15_h16_contest_distance", f"WITH {TEXTS}, p AS (SELECT a.id AS a_id, b.id AS b_id, levenshtein(a.title, b.title) AS t, a.choices AS x, b.choices AS y, length(a.title) + length(b.title) + length(a.choices[1]) + length(a.choices[2]) + length(a.choices[3]) + length(b.choices[1]) + length(b.choices[2]) + length(b.choices[3]) AS n FROM tx a JOIN tx b ON a.block = b.block AND a.id < b.id), q AS (SELECT a_id, b_id, (t + LEAST(levenshtein(x[1], y[1]) + levenshtein(x[2], y[2]) + levenshtein(x[3], y[3]), levenshtein(x[1], y[2]) + levenshtein(x[2], y[3]) + levenshtein(x[3], y[1]), levenshtein(x[1], y[3]) + levenshtein(x[2], y[1]) + levenshtein(x[3], y[2]))) / GREATEST(1, n) AS distance FROM p) SELECT a_id, b_id, ROUND(distance, 6) AS distance FROM q")
def _(spark, d):
    return contests.pairs_in_blocks(texts(spark, d), ["block"], 1.0).select("a_id", "b_id", F.round("distance", 6).alias("distance"))


@query("c18_sorted_neighbourhood", f"WITH {TEXTS}, n AS (SELECT block, id, text, LEAD(id) OVER w AS next_id, LEAD(text) OVER w AS next_text FROM tx WINDOW w AS (PARTITION BY block ORDER BY length(text), id)) SELECT block, id, next_id, CAST(levenshtein(text, next_text) AS BIGINT) AS distance FROM n WHERE next_id IS NOT NULL")
def _(spark, d):
    return contests.neighbours(texts(spark, d), "block").select("block", "id", "next_id", *long("distance"))


@query("i10_chains", f"WITH {TEXTS}, s AS (SELECT *, CASE WHEN levenshtein(text, LAG(text) OVER w) < 0.75 * GREATEST(length(text), length(LAG(text) OVER w)) THEN 0 ELSE 1 END AS s FROM tx WINDOW w AS (PARTITION BY block ORDER BY length(text), id)) SELECT block, id, CAST(SUM(s) OVER (PARTITION BY block ORDER BY length(text), id ROWS UNBOUNDED PRECEDING) - 1 AS BIGINT) AS chain FROM s")
def _(spark, d):
    return contests.chains(texts(spark, d), "block", 1.5).select("block", "id", "chain")


@query("h18_same_labels", "WITH l AS (SELECT c_custkey AS id, [CASE WHEN c_custkey % 2 = 0 THEN upper(c_mktsegment) ELSE lower(c_mktsegment) END, 'Nation ' || c_nationkey] AS labels FROM customer) SELECT id, MIN(id) OVER (PARTITION BY lower(array_to_string(labels, '|'))) AS global_id FROM l")
def _(spark, d):
    first = F.when(F.col("c_custkey") % 2 == 0, F.upper("c_mktsegment")).otherwise(F.lower("c_mktsegment"))
    l = v.read(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.array(first, F.concat(F.lit("Nation "), "c_nationkey")).alias("labels"))
    return contests.same_labels(l).select("id", "global_id")


@query("e15_i16_rotation", "WITH r AS (SELECT p_partkey, CAST(p_partkey % 4 AS INT) AS k, ['a', 'b', 'c', 'd', 'w'] AS l FROM part) SELECT p_partkey, array_to_string(list_concat(list_concat(l[k + 1:4], l[1:k]), ['w']), '') AS rotated FROM r")
def _(spark, d):
    a = F.array(*[F.lit(x) for x in "abcdw"])
    return v.read(spark, d, "part").select("p_partkey", F.array_join(contests.rotate(a, (F.col("p_partkey") % 4).cast("int"), 1), "").alias("rotated"))


@query(
    "h17_fix_phrases",
    r"""WITH RECURSIVE t AS (SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN c_custkey || '  Party Preferense: Republicen  list' WHEN 1 THEN 'MEMBER OF THE STATE ASEMBLY' WHEN 2 THEN 'Party Preference: Democratic' WHEN 3 THEN 'for Member of the State Assembly'
  WHEN 4 THEN 'a Party Preferance Democratic b MEMBR OF THE STATE ASSEMBLY ' || c_mktsegment ELSE c_mktsegment END AS x FROM customer),
ph AS (SELECT * FROM (VALUES (1, 'Party Preference: Republican', 3), (2, 'Party Preference: Democratic', 3), (3, 'MEMBER OF THE STATE ASSEMBLY', 5)) v(k, item, sep)),
s AS (SELECT c_custkey, 1 AS k, 1 AS i, list_filter(string_split_regex(x, '\s+'), lambda w: w <> '') AS words FROM t
 UNION ALL SELECT c_custkey, CASE WHEN i + 1 > len(words) - sep + 1 THEN s.k + 1 ELSE s.k END, CASE WHEN i + 1 > len(words) - sep + 1 THEN 1 ELSE i + 1 END,
  CASE WHEN i <= len(words) - sep + 1 AND abs(length(array_to_string(words[i:i + sep - 1], ' ')) - length(item)) < length(item) // 10 AND levenshtein(array_to_string(words[i:i + sep - 1], ' '), item) < length(item) // 5
   THEN list_concat(list_concat(words[1:i - 1], string_split(item, ' ')), words[i + sep:]) ELSE words END FROM s JOIN ph ON s.k = ph.k)
SELECT c_custkey, array_to_string(words, ' ') AS fixed FROM s WHERE k = 4""",
)
def _(spark, d):
    k, name = F.col("c_custkey") % 6, F.col("c_mktsegment")
    x = F.when(k == 0, F.concat("c_custkey", F.lit("  Party Preferense: Republicen  list"))).when(k == 1, "MEMBER OF THE STATE ASEMBLY").when(k == 2, "Party Preference: Democratic").when(k == 3, "for Member of the State Assembly")
    x = x.when(k == 4, F.concat(F.lit("a Party Preferance Democratic b MEMBR OF THE STATE ASSEMBLY "), name)).otherwise(name)
    return v.read(spark, d, "customer").select("c_custkey", contests.fix_phrases(x).alias("fixed"))


@query("h27_o2_common_prefix", "WITH p AS (SELECT p_partkey, string_split(p_name, ' ') AS a, string_split(LEAD(p_name) OVER (ORDER BY p_partkey), ' ') AS b FROM part) SELECT p_partkey, CASE WHEN a[1] <> b[1] THEN 0 WHEN len(a) = 1 OR len(b) = 1 OR a[2] <> b[2] THEN 1 ELSE 2 END AS n FROM p WHERE b IS NOT NULL")
def _(spark, d):
    a = v.read(spark, d, "part").select("p_partkey", F.split("p_name", " ").alias("a"))
    b = a.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("a").alias("b"))
    return a.join(b, "p_partkey").select("p_partkey", grouping.common_prefix(F.col("a"), F.col("b")).alias("n"))


@query("h28_page_sets", f"WITH {v.IMAGE} SELECT ballot_id, string_agg(CAST(page AS VARCHAR), ',' ORDER BY page) AS pages FROM image GROUP BY 1")
def _(spark, d):
    return pairing.page_sets(v.images(spark, d))


@query("h25_distances", "WITH p AS (SELECT a.vec_id, a.embedding::DOUBLE[] AS x, b.embedding::DOUBLE[] AS y FROM embeddings a JOIN embeddings b ON a.vec_id + 1 = b.vec_id) SELECT vec_id, ROUND(list_distance(x, y), 6) AS l2, ROUND(list_sum(list_transform(list_zip(x, y), lambda z: abs(z[1] - z[2]))) / len(x), 6) AS l1 FROM p")
def _(spark, d):
    e = v.read(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"))
    j = e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("x").alias("y")), "vec_id")
    return j.select("vec_id", F.round(cluster.DISTANCES["L2"](F.col("x"), F.col("y")), 6).alias("l2"), F.round(cluster.DISTANCES["L1"](F.col("x"), F.col("y")), 6).alias("l1"))


# --- clustering: no SQL; tests hold them against plain versions ---------------------------------------


@query("i1_kmeans")
def _(spark, d):
    return cluster.kmeans(v.read(spark, d, "embeddings").select("vec_id", "embedding"), 10).select("vec_id", "cluster")


@query("i2_kmeans_in_groups")
def _(spark, d):
    return cluster.kmeans_in_groups(v.read(spark, d, "embeddings").select("vec_id", "embedding", "label"), "label", 2, "vec_id")


@query("i3_kmedoids_in_groups")
def _(spark, d):
    return cluster.kmedoids_in_groups(v.read(spark, d, "embeddings").select("vec_id", "embedding", "label"), "label", 2, "vec_id")


@query("i4_pca")
def _(spark, d):
    p = cluster.pca(v.read(spark, d, "embeddings").select("vec_id", "embedding"), 3)
    return p.select("vec_id", *[F.round(F.abs(F.col("components")[i]), 6).alias(f"p{i}") for i in range(3)])


@query("i6_split_mid", "WITH n AS (SELECT label, vec_id, COUNT(*) OVER (PARTITION BY label) AS n, ROW_NUMBER() OVER (PARTITION BY label ORDER BY vec_id) AS k FROM embeddings) SELECT label, vec_id, CASE WHEN n = 1 OR k <= n // 2 THEN 1 ELSE 2 END AS half FROM n")
def _(spark, d):
    return cluster.split_mid(v.read(spark, d, "embeddings").select("label", "vec_id"), ["label"], ["vec_id"])


@query("i8_exemplar_growth")
def _(spark, d):
    e = v.read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label", F.col("embedding").cast("array<double>").alias("embedding"))
    return cluster.exemplars(e.withColumn("light", F.round(threshold.mean_intensity(F.col("embedding")), 9)))


@query("i9_agglomerate")
def _(spark, d):
    t = texts(spark, d)
    return contests.agglomerate(contests.pairs_in_blocks(t, ["block"], 1.0).join(t.select(F.col("id").alias("a_id"), "block"), "a_id"), t.select("block", "id"), "block", 0.45)


@query("stream_window_counts", "SELECT date_trunc('day', ts) AS start, event_type, CAST(COUNT(*) AS BIGINT) AS n, ROUND(SUM(value), 4) AS total FROM events GROUP BY ALL")
def _(spark, d):
    from psephos.streaming.tally import windowed_counts

    return windowed_counts(v.read(spark, d, "events"), "ts", "event_type").withColumn("total", F.round("total", 4))

from psephos.plans import queries_boxes, queries_more, queries_pages  # noqa: E402, F401  register their queries
