"""Chat formatting: conversations as one text each with a loss mask, assembled by columns of bytes, and read back."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from psephos.llm.common import give_back_memory, shared_path, table

#: Bytes of texts that are assembled at a time, bytes whose places are computed at a time, and bytes from which a conversation goes on in another piece.
STRETCH, PLACES, PIECE = 4 << 20, 1 << 20, 16 << 20
#: A formatted piece: loss holds (start, end) in code points of its text.
FORMATTED = "conv_id long, piece long, whole boolean, n_turns long, text string, loss array<struct<start: long, end: long>>"
LOSS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


@dataclass(frozen=True)
class Template:
    """A turn is opening, role, middle, text, closing, ending.

    In roles and texts, the escape goes before every escape and every place where opening or closing begins (and middle, in roles), so that none of them stands there unescaped; taking the
    escapes off gives the text again.  No mark may hold the escape, and middle and closing may not begin as any mark ends or stand in another, since then one could lie across a text's edge.
    """

    opening: str = "### "
    middle: str = ": "
    closing: str = "</turn>"
    ending: str = "\n"
    escape: str = "\\"
    learned: tuple[str, ...] = ("assistant",)

    def __post_init__(self):
        if len(self.escape) != 1 or not self.escape.isascii():
            raise ValueError("the escape must be one ASCII character")
        marks = (self.opening, self.middle, self.closing)
        for mark in marks:
            if not mark or not mark.isascii() or self.escape in mark:
                raise ValueError(f"not a mark: {mark!r}")
            for found in marks[1:]:
                if (mark != found and found in mark) or any(found.startswith(mark[-k:]) for k in range(1, len(mark))):
                    raise ValueError(f"{found!r} could begin in {mark!r}")

    def marks(self, of_role: bool = False) -> list[bytes]:
        return [m.encode() for m in (self.escape, self.opening, self.closing, *([self.middle] if of_role else []))]

    def escaped(self, text: bytes, of_role: bool = False) -> bytes:
        """One text, by the same rule as `scattered`."""
        at = np.frombuffer(text, np.uint8)
        cuts = places(at, np.array([0, len(at)]), self.marks(of_role))
        out = np.empty(len(at) + len(cuts), np.uint8)
        scattered(out, at, np.array([0, len(at)]), np.array([0]), cuts, ord(self.escape))
        return out.tobytes()

    def turns(self, text: bytes) -> list[tuple[bytes, bytes]]:
        """(role, text) of each turn of a formatted text.  Bytes that UTF-8 never holds stand in for what is escaped while the text is split."""
        hidden = self._hidden(text)
        out = []
        for turn in hidden.split((self.closing + self.ending).encode())[:-1]:
            role, _, said = turn[len(self.opening) :].partition(self.middle.encode())
            out.append((self._shown(role), self._shown(said)))
        return out

    def unescaped(self, text: bytes) -> bytes:
        return self._shown(self._hidden(text))

    def _firsts(self) -> list[bytes]:
        return sorted({m[:1] for m in self.marks(True)[1:]})

    def _hidden(self, text: bytes) -> bytes:
        e = self.escape.encode()
        if e not in text:
            return text
        text = text.replace(e + e, b"\xff")
        for k, c in enumerate(self._firsts()):
            text = text.replace(e + c, bytes([0xF8 + k]))
        return text

    def _shown(self, text: bytes) -> bytes:
        for k, c in enumerate(self._firsts()):
            text = text.replace(bytes([0xF8 + k]), c)
        return text.replace(b"\xff", self.escape.encode())


TEMPLATE = Template()


def places(data: np.ndarray, at: np.ndarray, marks: list[bytes]) -> np.ndarray:
    """Where in data (bytes of texts one after the other; at: where each begins, and the end) a mark begins that ends in the same text, in order."""
    found = []
    for f in range(0, len(data), PLACES):
        stretch = data[f : f + PLACES]
        for mark in marks:
            i = np.flatnonzero(stretch == mark[0]) + f
            i = i[i + len(mark) <= len(data)]
            for k in range(1, len(mark)):
                i = i[data[i + k] == mark[k]]
            if len(mark) > 1 and len(i):
                i = i[at[np.searchsorted(at, i, "right")] >= i + len(mark)]
            found.append(i)
    return np.unique(np.concatenate(found)) if found else np.empty(0, np.int64)


def scattered(out: np.ndarray, data: np.ndarray, at: np.ndarray, begin: np.ndarray, cuts: np.ndarray, escape: int) -> None:
    """Copies texts (data, at) to where each begins in out, with an escape before each place in cuts; the places of a stretch of bytes are computed at a time."""
    shift = begin - at[:-1] - np.searchsorted(cuts, at[:-1])
    for f in range(0, len(data), PLACES):
        e = min(f + PLACES, len(data))
        inside = np.clip(at, f, e)
        ahead = np.zeros(e - f, np.int64)
        own = cuts[np.searchsorted(cuts, f) : np.searchsorted(cuts, e)]
        ahead[own - f] = 1
        ahead = np.cumsum(ahead) + np.searchsorted(cuts, f)
        to = np.arange(f, e) + np.repeat(shift, np.diff(inside)) + ahead
        out[to] = data[f:e]
        out[to[own - f] - 1] = escape


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary column without nulls, and where each value begins, and the end."""
    offsets, data = column.buffers()[1], column.buffers()[2]
    at = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    flat = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.empty(0, np.uint8)
    return flat, at - at[0]


def code_points(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Number of code points of each text: bytes that do not go on with one."""
    out = np.zeros(len(at) - 1, np.int64)
    for f in range(0, len(data), PLACES):
        e = min(f + PLACES, len(data))
        ahead = np.concatenate([[0], np.cumsum((data[f:e] & 0xC0) != 0x80)])
        out += np.diff(ahead[np.clip(at, f, e) - f])
    return out


def assembled(roles: pa.Array, texts: pa.Array, template: Template):
    """Turns (binary columns without nulls) as one buffer: (bytes, where each turn begins and the end, code points of each turn, loss spans as code points from each turn's begin, -1 for none).

    Segment lengths and their running sums give where heads, texts and closings go; all are copied into one buffer that is allocated once.
    """
    coded = roles.dictionary_encode()
    names, of = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False)
    heads = [(template.opening.encode() + template.escaped(r, True) + template.middle.encode()) for r in names]
    learned = np.array([r.decode("utf-8", "replace") in template.learned for r in names], bool)
    tail = np.frombuffer((template.closing + template.ending).encode(), np.uint8)
    data, at = _bytes(texts)
    cuts = places(data, at, template.marks())
    escapes = np.diff(np.searchsorted(cuts, at))
    head = np.array([len(h) for h in heads], np.int64)[of]
    body = np.diff(at) + escapes
    start = np.concatenate([[0], np.cumsum(head + body + len(tail))])
    out = np.empty(start[-1], np.uint8)
    first, of_first = _bytes(pa.array(heads, pa.binary()).take(pa.array(of)))
    scattered(out, first, of_first, start[:-1], np.empty(0, np.int64), 0)
    scattered(out, data, at, start[:-1] + head, cuts, ord(template.escape))
    out[(start[1:] - len(tail))[:, None] + np.arange(len(tail))] = tail
    ahead = np.array([len(h.decode("utf-8", "replace")) for h in heads], np.int64)[of]
    said = code_points(data, at) + escapes
    return out, start, ahead + said + len(tail), np.where(learned[of], ahead, -1), np.where(learned[of], ahead + said, -1)


def _pieces(template: Template, piece_bytes: int, stretch: int):
    """Turns sorted by conversation -> formatted pieces.  A conversation that may go on in another task's rows, or beyond piece_bytes, is not `whole`."""

    def run(batches):
        piece = TaskContext.get().partitionId() << 32
        conv, first, begun, cut = None, True, False, False  # of the conversation held: its id, whether it is this task's first, whether rows were read, whether it was cut already
        parts, turns, chars, loss, size = [], 0, 0, [], 0

        def record(ids, whole, n, texts, spans):
            nonlocal piece
            numbers = np.arange(piece, piece + len(ids))
            piece += len(ids)
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(numbers), pa.array(whole, pa.bool_()), pa.array(n, pa.int64()), texts, pa.array(spans, LOSS)], names=["conv_id", "piece", "whole", "n_turns", "text", "loss"])

        def held(whole):
            out = record([conv], [whole], [turns], pa.array([b"".join(parts)], pa.binary()).cast(pa.string()), [[{"start": a, "end": b} for a, b in loss]])
            parts.clear(), loss.clear()
            return out

        for batch in batches:
            at = _bytes(batch.column("text"))[1]
            f = 0
            while f < batch.num_rows:
                e = max(f + 1, int(np.searchsorted(at, at[f] + stretch, "right")) - 1)
                rows = batch.slice(f, e - f)
                f = e
                out, start, points, a, b = assembled(rows.column("role"), rows.column("text"), template)
                ids = rows.column("conv_id").to_pylist()
                # conversations of this stretch: the first may go on with what is held, the last is held
                edges = [0, *(i for i in range(1, len(ids)) if ids[i] != ids[i - 1]), len(ids)]
                ahead = np.concatenate([[0], np.cumsum(points)])
                view, done = memoryview(out), []
                for i, j in zip(edges, edges[1:]):
                    if begun and ids[i] != conv:
                        if parts:
                            yield held(not first and not cut)
                        first, cut, turns, chars, size = False, False, 0, 0, 0
                    conv, begun = ids[i], True
                    own = slice(i, j)
                    learned = a[own] >= 0
                    from_here = (ahead[:-1] - ahead[i])[own][learned]
                    spans = list(zip((a[own][learned] + from_here).tolist(), (b[own][learned] + from_here).tolist()))
                    if not parts and not cut and not first and j < len(ids):  # whole in this stretch: it stays in the buffer
                        done.append((i, j, spans))
                        continue
                    if done:
                        yield from _from_buffer(out, start, ids, done, record)
                        done = []
                    parts.append(bytes(view[start[i] : start[j]]))
                    loss += [(x + chars, y + chars) for x, y in spans]
                    turns, chars, size = turns + j - i, chars + int(ahead[j] - ahead[i]), size + int(start[j] - start[i])
                    if size > piece_bytes:
                        yield held(False)
                        cut, turns, chars, size = True, 0, 0, 0
                if done:
                    yield from _from_buffer(out, start, ids, done, record)
        if parts:
            yield held(False)  # the next task's rows may go on with it
        give_back_memory()

    return run


def _from_buffer(out, start, ids, done, record):
    """Conversations next to each other in the buffer, as a string column on it."""
    offsets = np.array([start[i] for i, _, _ in done] + [start[done[-1][1]]], np.int32)
    texts = pa.Array.from_buffers(pa.string(), len(done), [None, pa.py_buffer(offsets), pa.py_buffer(out)])
    yield record([ids[i] for i, _, _ in done], [True] * len(done), [j - i for i, j, _ in done], texts, [[{"start": x, "end": y} for x, y in spans] for _, _, spans in done])


def formatted(conversations: DataFrame, template: Template = TEMPLATE, piece_bytes: int = PIECE, stretch: int = STRETCH, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, piece, whole, n_turns, text and loss of conversations: the turns of a piece in order as one text, and where in it (in code points) texts of the learned roles stand.

    Rows are range-split by conversation and turn, so no conversation has to fit a task.  One that is whole in a task is one row (whole is true); one that lies on the edge of a task, or has
    over piece_bytes (looked at after every stretch of texts), is several rows, whose texts one after the other, in the order of `piece`, are its text.  Every turn is whole in its piece.

    A null text or role is empty; a null conv_id is a conversation of its own; null turns come first; equal turns go by role, then by the text's hash, then by the text; repeated rows are turns
    each.  Other columns are ignored; an empty table gives no rows.  Texts of any length are assembled whole, a stretch of places at a time.
    """
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = conversations.select(F.col(conv_id).cast("long").alias("conv_id"), F.col(turn).alias("turn"), empty(role).alias("role"), empty(text).alias("text"))
    rows = rows.withColumn("h", F.xxhash64("text")).withColumn("row", F.monotonically_increasing_id())
    dealt = rows.repartitionByRange("conv_id", "turn", "role", "h", "row").sortWithinPartitions("conv_id", "turn", "role", "h", "text")
    return dealt.select("conv_id", F.col("role").cast("binary").alias("role"), F.col("text").cast("binary").alias("text")).mapInArrow(_pieces(template, piece_bytes, stretch), FORMATTED)


def parsed(pieces: DataFrame, template: Template = TEMPLATE) -> DataFrame:
    """conv_id, piece, turn (from 0 in its piece), role, text of formatted pieces: the way back."""

    def run(batches):
        for batch in batches:
            for c, p, t in zip(*(batch.column(x) for x in ("conv_id", "piece", "text"))):
                found = template.turns(t.as_py().encode())
                role, said = zip(*found) if found else ((), ())
                k = len(found)
                yield pa.RecordBatch.from_arrays([pa.array([c.as_py()] * k, pa.int64()), pa.array([p.as_py()] * k, pa.int64()), pa.array(np.arange(k)), pa.array(role, pa.binary()).cast(pa.string()), pa.array(said, pa.binary()).cast(pa.string())], names=["conv_id", "piece", "turn", "role", "text"])

    return pieces.select("conv_id", "piece", "text").mapInArrow(run, "conv_id long, piece long, turn long, role string, text string")


def saved(pieces: DataFrame) -> DataFrame:
    """Pieces written to the shared folder as Parquet, whole ones apart from others, and read from there."""
    path = shared_path(pieces.sparkSession, "chat")
    pieces.write.partitionBy("whole").parquet(path)
    return pieces.sparkSession.read.schema(pieces.schema).parquet(path)


DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _digests(template: Template):
    """Pieces, those of a conversation next to each other and in order -> a row for each conversation, by what its text and its mask say."""

    def run(batches):
        rows, conv, state = [], None, None

        def flush():
            cols = list(zip(*rows)) if rows else [()] * 6
            rows.clear()
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

        def close():
            rows.append((conv, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))

        for batch in batches:
            for c, text, loss in zip(*(batch.column(x) for x in ("conv_id", "text", "loss"))):
                c, text = c.as_py(), text.as_py()
                if state is None or c != conv:
                    if state is not None:
                        close()
                    conv, state = c, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, said in template.turns(text.encode()):
                    state[0] += 1
                    state[1].update(role + b"\n" + said + b"\n")
                for span in loss.as_py():
                    said = template.unescaped(text[span["start"] : span["end"]].encode())
                    state[2] += len(said.decode())
                    state[3].update(said)
                state[4] += len(text)
            yield flush()
        if state is not None:
            close()
            yield flush()

    return run


def digests(pieces: DataFrame, template: Template = TEMPLATE) -> DataFrame:
    """For each conversation what is read back from its pieces.  Whole ones are read where they are; only the others' pieces are brought together, and read one after the other."""
    read = _digests(template)
    columns = ["conv_id", "piece", "text", "loss"]
    whole = pieces.where("whole").select(*columns).mapInArrow(read, DIGESTS)
    others = pieces.where("not whole").select(*columns).repartition("conv_id").sortWithinPartitions("conv_id", "piece")
    return whole.unionByName(others.mapInArrow(read, DIGESTS))


#: A conversation whose texts hold the template's own marks.
PLANTED = [(-7, 0, "user", r"\### Assistant: </turn> ok"), (-7, 1, "assistant", r"\### Assistant: </turn> ok")]


def op13_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars of all `conversations` and one more, read back from the written output; nulls, ties, repeated rows and empty tables as in formatted."""
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    more = spark.createDataFrame(PLANTED, "conv_id long, turn long, role string, text string")
    return digests(saved(formatted(rows.unionByName(more))))


OP13_SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (SELECT *, replace(replace(replace(text, '\', '\\'), '### ', '\### '), '</turn>', '\</turn>') AS t,
  replace(replace(replace(replace(role, '\', '\\'), '### ', '\### '), '</turn>', '\</turn>'), ': ', '\: ') AS r FROM c)
SELECT conv_id, COUNT(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
  CAST(coalesce(SUM(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(SUM(length('### ' || r || ': ' || t || '</turn>' || chr(10))) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
