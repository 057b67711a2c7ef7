"""Readers and writers of the pipeline's tables and text formats."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
import zlib
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from psephos.functions.paths import is_image
from psephos.sources.tiff import tiff


def list_images(spark: SparkSession, root: str) -> DataFrame:
    """Paths of all images under a directory; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path")
    return files.where(is_image(F.col("path"))).select(F.col("path").alias("image_path"))


def read_images(spark: SparkSession, root: str) -> DataFrame:
    """image_path and content of all images under a directory."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return files.where(is_image(F.col("path"))).select(F.col("path").alias("image_path"), "content")


def decoded(content: bytes) -> np.ndarray:
    """A grey image (0 to 255) from PNG (8 bits, not interlaced), TIFF (see psephos.sources.tiff), binary PGM and PPM, or uncompressed BMP with 8 or 24 bits; colours by the usual weights.

    ValueError for anything else.
    """
    if content[:4] in (b"II*\0", b"MM\0*"):
        return tiff(content)
    if content[:8] == b"\x89PNG\r\n\x1a\n":
        return _png(content)
    if content[:2] in (b"P5", b"P6"):
        m = re.match(rb"P[56](?:\s+#[^\n]*)*\s+(\d+)\s+(\d+)\s+(\d+)\s", content)
        if m is None or int(m[3]) != 255:
            raise ValueError("not an 8-bit netpbm image")
        w, h, n = int(m[1]), int(m[2]), 1 if content[1] == 0x35 else 3
        return _grey(np.frombuffer(content, np.uint8, w * h * n, m.end()).reshape(h, w, n))
    if content[:2] == b"BM":
        start, w, h, bits, packing = (int.from_bytes(content[a:b], "little", signed=s) for a, b, s in ((10, 14, False), (18, 22, True), (22, 26, True), (28, 30, False), (30, 34, False)))
        if packing or bits not in (8, 24):
            raise ValueError("not an uncompressed BMP image with 8 or 24 bits")
        n, row = bits // 8, -(-w * bits // 32) * 4
        pixels = np.frombuffer(content, np.uint8, row * abs(h), start).reshape(abs(h), row)[:, : w * n].reshape(abs(h), w, n)
        if n == 1:
            colours = np.frombuffer(content, np.uint8, start - 14 - int.from_bytes(content[14:18], "little"), 14 + int.from_bytes(content[14:18], "little")).reshape(-1, 4)
            pixels = colours[pixels[:, :, 0], :3]
        return _grey(pixels[:: -1 if h > 0 else 1, :, ::-1])
    raise ValueError("an image of a kind that is not read here")


def _grey(a: np.ndarray) -> np.ndarray:
    return a[:, :, 0].astype(np.float64) if a.shape[2] < 3 else np.round(a[:, :, :3] @ np.array([0.299, 0.587, 0.114]))


def _png(content: bytes) -> np.ndarray:
    at, data, palette, head = 8, b"", None, None
    while at < len(content):
        n, kind = int.from_bytes(content[at : at + 4], "big"), content[at + 4 : at + 8]
        own = content[at + 8 : at + 8 + n]
        head, data, palette = (own if kind == b"IHDR" else head), data + (own if kind == b"IDAT" else b""), (own if kind == b"PLTE" else palette)
        at += 12 + n
    w, h, bits, colour, interlaced = int.from_bytes(head[:4], "big"), int.from_bytes(head[4:8], "big"), head[8], head[9], head[12]
    if bits != 8 or interlaced:
        raise ValueError("not a plain 8-bit PNG image")
    n = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[colour]
    raw = np.frombuffer(zlib.decompress(data), np.uint8).reshape(h, 1 + w * n)
    out, above = np.zeros((h, w * n), np.uint8), np.zeros(w * n, np.uint8)
    for y in range(h):
        line = raw[y, 1:].astype(np.int64)
        if raw[y, 0] == 2:
            line += above
        elif raw[y, 0] == 1:
            line = line.reshape(w, n).cumsum(axis=0).ravel()
        elif raw[y, 0] in (3, 4):
            left, up = np.zeros(n, np.int64), above.reshape(w, n).astype(np.int64)
            corner = np.zeros(n, np.int64)
            for x in range(w):
                own = line[x * n : x * n + n]
                if raw[y, 0] == 3:
                    own = own + (left + up[x]) // 2
                else:  # the neighbour nearest to left + up - corner, in that order
                    guess = left + up[x] - corner
                    d = np.abs(np.stack([left, up[x], corner]) - guess)
                    own = own + np.choose(d.argmin(axis=0), [left, up[x], corner])
                line[x * n : x * n + n] = left = own % 256
                corner = up[x]
        out[y] = above = (line % 256).astype(np.uint8)
    pixels = out.reshape(h, w, n)
    return _grey(np.frombuffer(palette, np.uint8).reshape(-1, 3)[pixels[:, :, 0]] if colour == 3 else pixels)


#: Decoded images that a task holds at a time: files are much smaller than their pixels.
AT_ONCE = 64


def grey_images(images: DataFrame, scaled: bool = False) -> DataFrame:
    """image_path, patch (a struct of h, w and data), status: images (image_path, content) as grey values from 0 to 255, or to 1 if scaled; what cannot be read has status err and no patch."""
    from psephos.operators.patches import PATCH, pack

    def run(it):
        for pdf in (batch.iloc[f : f + AT_ONCE] for batch in it for f in range(0, len(batch), AT_ONCE)):
            patches = []
            for content in pdf["content"]:
                try:
                    patches.append(pack(decoded(bytes(content)) / (255 if scaled else 1)))
                except (ValueError, KeyError, IndexError, TypeError, zlib.error):  # one bad image is a row of its own kind
                    patches.append(None)
            yield pdf[["image_path"]].assign(patch=patches, status=["err" if p is None else "ok" for p in patches])

    return images.select("image_path", "content").mapInPandas(run, f"image_path string, patch {PATCH}, status string")


def png(grey: np.ndarray) -> bytes:
    """A grey image (0 to 255) as PNG."""
    a = np.asarray(grey).astype(np.uint8)
    chunk = lambda kind, own: len(own).to_bytes(4, "big") + kind + own + zlib.crc32(kind + own).to_bytes(4, "big")
    head = a.shape[1].to_bytes(4, "big") + a.shape[0].to_bytes(4, "big") + bytes([8, 0, 0, 0, 0])
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(b"".join(b"\0" + row.tobytes() for row in a))) + chunk(b"IEND", b"")


def save_table(df: DataFrame, project: str, name: str) -> None:
    df.write.mode("overwrite").parquet(f"{project}/{name}")


def load_table(spark: SparkSession, project: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{project}/{name}")


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("ignoreLeadingWhiteSpace", "true").csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path)


def classified_lines(marks: DataFrame) -> DataFrame:
    """ballot, page, target and intensity with NUL between, by rising intensity."""
    return marks.orderBy("intensity", "ballot_id", "page", "target_id").select(F.concat_ws("\0", *[F.col(c).cast("string") for c in ("ballot_id", "page", "target_id", "intensity")]).alias("value"))


def parse_classified(lines: DataFrame) -> DataFrame:
    p = F.split("value", "\0")
    return lines.select(p[0].cast("long").alias("ballot_id"), p[1].cast("int").alias("page"), p[2].cast("int").alias("target_id"), p[3].cast("int").alias("intensity"))


def target_lines(results: DataFrame) -> DataFrame:
    """ballot, page, target, 0 or 1 (1 is filled); filled ones first."""
    line = F.concat_ws(", ", "ballot_id", "page", "target_id", F.col("is_filled").cast("int"))
    return results.orderBy(F.desc("is_filled"), "ballot_id", "page", "target_id").select(line.alias("value"))


def parse_targets(lines: DataFrame) -> DataFrame:
    p = F.split("value", ", *")
    return lines.select(p[0].cast("long").alias("ballot_id"), p[1].cast("int").alias("page"), p[2].cast("int").alias("target_id"), (p[3] == "1").alias("is_filled"))


def parse_quarantine(lines: DataFrame) -> DataFrame:
    """`path,cid,TFTF,cid,TF,` -> image_path, cid, votes."""
    p = F.split("value", ",")
    pairs = F.transform(F.sequence(F.lit(0), F.floor((F.size(p) - 1) / 2).cast("int") - 1), lambda i: F.struct(F.get(p, i * 2 + 1).alias("cid"), F.get(p, i * 2 + 2).alias("bits")))
    one = lines.where(F.size(p) > 2).select(p[0].alias("image_path"), F.explode(pairs).alias("x"))
    votes = F.transform(F.filter(F.split("x.bits", ""), lambda c: c != ""), lambda c: c == "T")
    return one.select("image_path", F.col("x.cid").cast("int").alias("cid"), votes.alias("votes"))


def quarantine_lines(manual: DataFrame) -> DataFrame:
    bits = F.array_join(F.transform("votes", lambda v: F.when(v, "T").otherwise("F")), "")
    own = F.array_sort(F.collect_list(F.struct(F.col("cid"), bits.alias("bits"))))
    rows = manual.groupBy("image_path").agg(F.array_join(F.transform(own, lambda x: F.concat_ws(",", x["cid"], x["bits"])), ",").alias("x"))
    return rows.select(F.concat("image_path", F.lit(","), "x", F.lit(",")).alias("value"))


def lookup_table(pairs: DataFrame) -> DataFrame:
    """in, out rows with a line number -> one row per `in`: the last of several."""
    return pairs.groupBy("in").agg(F.max_by("out", "line").alias("out"))


def cvr_lines(cvr: DataFrame) -> DataFrame:
    """Ragged CVR text: the ballot, then its contests in order with their marks and status."""
    own = F.array_sort(F.collect_list(F.struct("cid", "marks", "status")))
    return cvr.groupBy("ballot_id").agg(F.concat_ws(",", F.col("ballot_id").cast("string"), F.array_join(F.transform(own, lambda x: F.concat_ws(",", x["cid"], x["marks"], x["status"])), ",")).alias("value"))


def cvr_texts(choices: DataFrame) -> DataFrame:
    """Text per ballot path: a contest's title, then indented its status or its filled labels."""
    one = choices.groupBy("path", "title").agg(F.first("status").alias("status"), F.array_sort(F.collect_list(F.when(F.col("filled") == 1, F.col("label")))).alias("labels"))
    body = F.when(F.col("status") == "OK", F.array_join(F.transform("labels", lambda x: F.concat(F.lit("\n\t"), x)), "")).otherwise(F.concat(F.lit("\n\t"), "status"))
    text = one.select("path", "title", F.concat("title", body).alias("t"))
    return text.groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("title", "t"))), lambda x: x["t"]), "\n").alias("text"))


def write_text_tree(texts: DataFrame, root: str) -> None:
    """One file per path under root, written by the tasks; root must be a folder all executors share."""
    def put(rows):
        for r in rows:
            out = Path(root, re.sub(r"\.[^./]*$", "", r.path) + ".txt")
            out.parent.mkdir(parents=True, exist_ok=True)
            part = out.with_name(f".{out.name}.part")
            part.write_text(r.text)
            part.replace(out)

    texts.foreachPartition(put)


def report(tally: DataFrame) -> str:
    """The tally as text; a report is as long as the ballot's contests, so it is made on the driver."""
    out, section, contest = [], None, None
    for r in tally.orderBy("section", "title", "label").toLocalIterator():
        if r.section != section:
            section, contest = r.section, None
            out += ["-" * 40, section, "-" * 40]
        if r.title != contest:
            contest = r.title
            out.append(contest)
        out.append(f"\t{r.votes}\t{r.label}")
    return "\n".join(out) + "\n"


class Catalog:
    """A folder of projects, each a folder of tables."""

    _NAME = re.compile(r"[A-Za-z0-9][A-Za-z0-9_ -]*")

    def __init__(self, root: str):
        self.root = Path(root)

    def names(self) -> list[str]:
        return sorted(p.name for p in self.root.iterdir() if p.is_dir()) if self.root.exists() else []

    def valid(self, name: str) -> bool:
        return bool(self._NAME.fullmatch(name))

    def create(self, name: str) -> Path:
        if not self.valid(name):
            raise ValueError(f"not a project name: {name!r}")
        path = self.root / name
        path.mkdir(parents=True)
        return path

    def delete(self, name: str) -> None:
        if name not in self.names():
            raise KeyError(name)
        shutil.rmtree(self.root / name)

    def has(self, name: str, table: str) -> bool:
        return (self.root / name / table).exists()


def write_boxes(boxes: DataFrame, path: str) -> None:
    """Boxes as CSV, a folder per group and side."""
    boxes.write.mode("overwrite").partitionBy("group_id", "side").option("header", "true").csv(path)


def read_boxes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", "true").schema("kind string, box_id int, contest_local_id int, x int, y int, w int, h int, group_id int, side int").csv(path)


def write_patches(patches: DataFrame, path: str) -> None:
    """Patches range-split and sorted by intensity, so that a reader of an intensity range or a place opens few files."""
    patches.repartitionByRange("intensity").sortWithinPartitions("intensity", "ballot_id", "page", "target_id").write.mode("overwrite").parquet(path)


def read_patches(spark: SparkSession, path: str, low: int, high: int) -> DataFrame:
    """Patches with low <= intensity <= high; the bounds reach the files' statistics."""
    return spark.read.parquet(path).where(F.col("intensity").between(low, high))


def save_text(project: str, name: str, text: str) -> None:
    Path(project).mkdir(parents=True, exist_ok=True)
    Path(project, name).write_text(text)


def load_text(project: str, name: str) -> str:
    return Path(project, name).read_text()


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where that is unset and the master is local (tests), one of our own, removed at exit."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = _OWN.get("root")
        if root is None:
            path = tempfile.mkdtemp(prefix="psephos-")
            atexit.register(shutil.rmtree, path, ignore_errors=True)
            root = _OWN["root"] = f"file://{path}"
    return root.rstrip("/")


_OWN: dict[str, str] = {}


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; never used twice."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts lineage and outlives executors."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def removed(*tables: DataFrame) -> None:
    """Deletes tables of `written` that nothing needs any more: what was made of them is written itself."""
    for t in tables:
        path = getattr(t, "_written_to", None)
        if path is not None:
            jvm, conf = t.sparkSession._jvm, t.sparkSession._jsc.hadoopConfiguration()
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(conf).delete(where, True)
