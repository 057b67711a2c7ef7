"""Best-fit packing by a plan over the histogram of lengths."""

from __future__ import annotations

import bisect

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from psephos.llm.common import table, written
from psephos.llm.tokens import crc, encoder, text_runs

_SHIFT = 44  # bits of a rank beside a length


def plan(counts: dict[int, int], room: int) -> tuple[np.ndarray, int]:
    """Best fit over counts: lengths from long to short, each into the fullest open sequences that hold it.

    Returns rows (length, first rank, first sequence, offset, copies in a sequence) sorted by length and rank, and the number
    of sequences.  Rank r of a length is in the row with the last first rank <= r: d = r - first rank; sequence is
    first + d // copies; place is offset + length * (d % copies).  Sequences that are filled alike are one group, and a length splits
    two groups at most, so the rows are bounded by room, not by the number of documents.
    """
    rows, open_, free, n = [], {}, [], 0  # open_: room left -> groups (first sequence, how many)

    def put(left: int, first: int, many: int) -> None:
        if left and many:
            if left not in open_:
                open_[left] = []
                bisect.insort(free, left)
            open_[left].append((first, many))

    for length in sorted((k for k, c in counts.items() if k and c), reverse=True):
        rank, rest = 0, counts[length]
        while rest:
            at = bisect.bisect_left(free, length)
            if at < len(free):
                left = free[at]
                first, many = open_[left].pop()
                if not open_[left]:
                    del open_[left], free[at]
            else:
                left, first, many = room, n, -(-rest // (room // length))
                n += many
            copies = left // length
            full = min(many, rest // copies)
            if full:
                rows.append((length, rank, first, room - left, copies))
                put(left - copies * length, first, full)
                rank, rest = rank + full * copies, rest - full * copies
            if full < many:
                if 0 < rest < copies:
                    rows.append((length, rank, first + full, room - left, rest))
                    put(left - rest * length, first + full, 1)
                    rank, rest, full = rank + rest, 0, full + 1
                put(left, first + full, many - full)
    return np.array(sorted(rows), np.int64).reshape(-1, 5), n


def _pieces(path: str, kind: str, end: int, room: int):
    def run(batches):
        coder, part, seen = encoder(path, kind), TaskContext.get().partitionId(), np.zeros(room + 1, np.int64)
        for b in batches:
            for first, texts in text_runs(b.column(1)):
                flat, n = coder.encode(texts)
                ids = np.insert(flat, np.cumsum(n), end)
                n += 1
                doc = np.repeat(np.arange(len(n)), -(-n // room))
                piece = np.arange(len(doc)) - np.searchsorted(doc, doc)
                start = piece * room
                length = np.minimum(room, n[doc] - start)
                at = (np.cumsum(n) - n)[doc] + start
                crcs = [crc(ids[a : a + k]) for a, k in zip(at, length)]
                order = np.argsort(length, kind="stable")
                own = length[order]
                rank = np.empty(len(own), np.int64)
                rank[order] = seen[own] + np.arange(len(own)) - np.searchsorted(own, own)
                seen += np.bincount(length, minlength=room + 1)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(first, len(texts)).take(pa.array(doc)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crcs, pa.int64()), pa.array(np.full(len(doc), part, np.int32)), pa.array(rank)],
                    names=["doc_id", "piece", "start", "length", "ids_crc32", "part", "rank"],
                )

    return run


def _placed(shared):
    def run(batches):
        rows = shared.value
        keys = rows[:, 0] << _SHIFT | rows[:, 1]
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            own = rows[np.searchsorted(keys, length << _SHIFT | rank, "right") - 1]
            d = rank - own[:, 1]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(own[:, 2] + d // own[:, 4]), pa.array(own[:, 3] + length * (d % own[:, 4]))], names=[*b.schema.names[:-1], "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, tokenizer: str, kind: str = "word", end: int = 1, room: int = 4096, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of every document.

    A document is its ids and the end id; those over room are cut into pieces of room ids.  Encoding writes a row per piece with
    its rank among the pieces of its length in that task; counts by task and length, summed along tasks, make ranks over all.  The
    histogram has room rows at most and is planned on the driver; the plan's size is bounded by room as well, and each piece finds its slot by length
    and rank.  No piece is moved by its text, and no length, however common, meets in one task.

    Null and empty texts are one piece with the end id; long texts are encoded whole.  Repeated rows are packed each; which of equally long pieces goes where does not matter.  doc_id is cast to
    long; other columns are left out, whatever their names.  An empty table gives no rows.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(_pieces(tokenizer, kind, end, room), "doc_id long, piece int, start long, length long, ids_crc32 long, part int, rank long")
    pieces = written(rows, "pieces")
    counts = pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    base = counts.select("part", "length", F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    histogram = {r.length: r.n for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # room rows at most
    slots, _ = plan(histogram, room)
    ranked = pieces.join(base, ["part", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("rank")).alias("rank"))
    return ranked.mapInArrow(_placed(spark.sparkContext.broadcast(slots)), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op9_best_fit_packing(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    """Every piece of every document and its place; nulls, long and empty texts, repeated rows and empty tables as in pack."""
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer or public_tokenizers.path("word_bpe_49k.json"))
