"""The election seen in the star-schema tables: marks, ballots, attributes, contests; as DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LINE = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")
UPTO = {"A": 1, "N": 2, "R": 3}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """target observations: ballot_id, page, target_id, cid, choice, intensity; one per line item."""
    own = Window.partitionBy("l_orderkey").orderBy(*LINE)
    return read(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("ballot_id"),
        (F.col("l_linestatus") == "F").cast("int").alias("page"),
        F.row_number().over(own).alias("target_id"),
        F.col("l_returnflag").alias("cid"),
        F.col("l_linenumber").alias("choice"),
        (F.col("l_quantity") * 5).cast("int").alias("intensity"),
    )


MARK = f"""mark AS (SELECT l_orderkey AS ballot_id, CAST(l_linestatus = 'F' AS INT) AS page, CAST(ROW_NUMBER() OVER (PARTITION BY l_orderkey ORDER BY {', '.join(LINE)}) AS INT) AS target_id,
 l_returnflag AS cid, l_linenumber AS choice, CAST(FLOOR(l_quantity * 5) AS INT) AS intensity FROM lineitem)"""


def ballots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ballot_id, mode, status (ok or quarantined)."""
    return read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("ballot_id"), F.col("o_custkey").alias("cust"), F.col("o_orderpriority").alias("mode"), F.when(F.col("o_orderstatus") == "P", "quarantined").otherwise("ok").alias("status"))


BALLOT = "ballot AS (SELECT o_orderkey AS ballot_id, o_custkey AS cust, o_orderpriority AS mode, CASE WHEN o_orderstatus = 'P' THEN 'quarantined' ELSE 'ok' END AS status FROM orders)"


def attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ballot_id, mode, status, precinct, region and path (region/nation/ballot) of every ballot."""
    place = read(spark, sf_dir, "nation").join(read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    voter = read(spark, sf_dir, "customer").join(place, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("cust"), F.col("n_name").alias("precinct"), F.col("r_name").alias("region"))
    return ballots(spark, sf_dir).join(voter, "cust").select("ballot_id", "mode", "status", "precinct", "region", F.concat_ws("/", "region", "precinct", F.concat(F.col("ballot_id").cast("string"), F.lit(".png"))).alias("path"))


ATTR = f"""{BALLOT},
attr AS (SELECT ballot_id, mode, status, n_name AS precinct, r_name AS region, r_name || '/' || n_name || '/' || ballot_id || '.png' AS path
 FROM ballot JOIN customer ON cust = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


def contests(spark: SparkSession) -> DataFrame:
    """cid, upto, title, and choices by label; the labels of choices 3 and 4 are one, as write-ins often are."""
    return spark.createDataFrame([(c, u, f"Contest {c}", [label(k) for k in range(1, 8)]) for c, u in UPTO.items()], "cid string, upto int, title string, choices array<string>")


def label(k: int) -> str:
    return "writein" if k in (3, 4) else f"Choice {k}"


CONTEST = "contest AS (SELECT * FROM (VALUES ('A', 1, 'Contest A'), ('N', 2, 'Contest N'), ('R', 3, 'Contest R')) t(cid, upto, title))"
LABEL = "CASE WHEN choice IN (3, 4) THEN 'writein' ELSE 'Choice ' || choice END"
#: Marks are taken as filled up to this rank by intensity.
THRESHOLD = 20_000
ORDER = ("intensity", "ballot_id", "page", "target_id")
FILLED = f"""{MARK},
filled AS (SELECT *, ROW_NUMBER() OVER (ORDER BY intensity, ballot_id, page, target_id) - 1 AS rnk FROM mark),
result AS (SELECT *, rnk < {THRESHOLD} AS is_filled FROM filled)"""


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page images: two for most ballots (orders), paths by region and nation; ballot_id, img_ord, page, image_path, dir_path, file_name."""
    a = attributes(spark, sf_dir).withColumn("n", F.when(F.col("ballot_id") % 7 == 0, 1).when(F.col("ballot_id") % 11 == 0, 3).otherwise(2))
    one = a.select("ballot_id", "region", "precinct", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("img_ord"))
    name = F.concat(F.lit("b"), F.col("ballot_id").cast("string"), F.lit("_side"), F.col("img_ord").cast("string"), F.lit(".png"))
    return one.select("ballot_id", "img_ord", (F.col("img_ord") * 2 + F.lit(3)).alias("page"), F.concat_ws("/", "region", "precinct").alias("dir_path"), name.alias("file_name")).withColumn("image_path", F.concat_ws("/", "dir_path", "file_name"))


IMAGE = f"""{ATTR},
image AS (SELECT ballot_id, CAST(o AS INT) AS img_ord, CAST(o * 2 + 3 AS INT) AS page, region || '/' || precinct AS dir_path, 'b' || ballot_id || '_side' || o || '.png' AS file_name,
 region || '/' || precinct || '/b' || ballot_id || '_side' || o || '.png' AS image_path
 FROM attr, range(3) t(o) WHERE o < CASE WHEN ballot_id % 7 = 0 THEN 1 WHEN ballot_id % 11 = 0 THEN 3 ELSE 2 END)"""
