import hashlib
import random
from itertools import groupby

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from psephos.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, piece string, h int"
T = chat.TEMPLATE


def escaped(text, marks):
    """Character by character."""
    return "".join(("\\" if any(text.startswith(m, i) for m in marks) else "") + c for i, c in enumerate(text))


def plain(rows):
    """By loops: the formatted text of each conversation, its loss spans, and what the query returns."""
    out = {}
    key = lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] or "")
    for conv, own in groupby(sorted(rows, key=key), key=lambda r: r[0]):
        text, spans, turns, learned, n = "", [], b"", "", 0
        for _, _, role, said in own:
            role, said = role or "", said or ""
            head = "### " + escaped(role, ("\\", "### ", "</turn>", ": ")) + ": "
            body = escaped(said, ("\\", "### ", "</turn>"))
            if role == "assistant":
                spans.append((len(text) + len(head), len(text) + len(head) + len(body)))
                learned += said
            text += head + body + "</turn>\n"
            turns += f"{role}\n{said}\n".encode()
            n += 1
        out[conv] = (text, spans, (conv, n, hashlib.sha256(turns).hexdigest(), len(learned), hashlib.sha256(learned.encode()).hexdigest(), len(text)))
    return out


def texts():
    rnd = random.Random(4)
    bits = ["\\", "### ", "###", "#", "</turn>", "</turn", "<", ">", " ", ": ", "é", "日本", "\U0001f600", "\n", "a", "word "]
    return ["".join(rnd.choice(bits) for _ in range(rnd.randint(0, 14))) for _ in range(600)] + ["", "\\", "</turn>", "### " * 3, "</turn></turn>"]


def rows():
    rnd, out = random.Random(6), []
    said = texts()
    for conv in range(60):
        for turn in range(rnd.choice([1, 2, 3, 9, 40])):
            out.append((conv, turn, rnd.choice(["user", "assistant", "assistant", "system: ", "### \\", "", None]), rnd.choice([*said, None])))
    out += [(None, 0, "user", "null id"), (None, 1, "assistant", "too"), (100, None, "assistant", "null turn"), (100, 5, "assistant", "b")]
    return out


def frame(spark, found, n=4):
    return spark.createDataFrame([(*r, "x", 1) for r in found], SCHEMA).repartition(n)


def glued(pieces):
    """Each conversation's text and spans, of its pieces."""
    out = {}
    for r in sorted(pieces.collect(), key=lambda r: r.piece):
        text, spans, n = out.get(r.conv_id, ("", [], 0))
        out[r.conv_id] = (text + r.text, spans + [(s.start + len(text), s.end + len(text)) for s in r.loss], n + r.n_turns)
    return out


@pytest.mark.parametrize("limits", [{}, {"stretch": 40}, {"stretch": 200, "piece_bytes": 100}])
def test_formatted_and_read_back(spark, limits):
    found = rows()
    want = plain(found)
    pieces = chat.saved(chat.formatted(frame(spark, found), **limits))
    assert {c: (t, s) for c, (t, s, _) in glued(pieces).items()} == {c: (t, s) for c, (t, s, _) in want.items()}
    assert sorted(map(tuple, chat.digests(pieces).collect()), key=str) == sorted((w[2] for w in want.values()), key=str)
    turns = chat.parsed(pieces).collect()
    assert sorted((r.conv_id if r.conv_id is not None else -1, r.role, r.text) for r in turns) == sorted((c if c is not None else -1, role or "", said or "") for c, _, role, said in found)
    if not limits:
        assert pieces.where("whole").count() > 20


def test_one_conversation_of_many_rows(spark):
    """A conversation with most rows is dealt out by turns, and pieces of it are bounded."""
    found = [(1, i, "assistant" if i % 2 else "user", f"text {i} \\ ### ") for i in range(5000)] + [(i, 0, "user", "x") for i in range(2, 300)]
    pieces = chat.saved(chat.formatted(frame(spark, found, 8), piece_bytes=5000, stretch=2000))
    assert pieces.where("conv_id = 1").count() > 20
    assert max(len(r.text) for r in pieces.collect()) < 15_000
    assert sorted(map(tuple, chat.digests(pieces).collect())) == sorted(w[2] for w in plain(found).values())


def test_ties_repeats_and_empty(spark):
    assert chat.digests(chat.saved(chat.formatted(frame(spark, [])))).collect() == []
    same = [(1, 0, "assistant", "same")] * 30
    assert [tuple(r) for r in chat.digests(chat.saved(chat.formatted(frame(spark, same)))).collect()] == [plain(same)[1][2]]
    ties = [(1, 0, role, f"{role}{k}") for role in ("user", "assistant") for k in range(5)]
    one, two = (chat.digests(chat.saved(chat.formatted(frame(spark, x)))).collect() for x in (ties, ties[::-1]))
    assert one == two and one[0].n_turns == 10


def test_long_texts(spark):
    long = ("é### \\ </turn>" * 30_000) + "x" * 2_000_000
    found = [(1, 0, "user", long), (1, 1, "assistant", long), (2, 0, "assistant", "short")]
    pieces = chat.saved(chat.formatted(frame(spark, found)))
    assert sorted(map(tuple, chat.digests(pieces).collect())) == sorted(w[2] for w in plain(found).values())


def test_bytes_by_columns(monkeypatch):
    """Stretches of a few bytes give what a character by character copy gives; also marks that overlap."""
    monkeypatch.setattr(chat, "PLACES", 7)
    said = texts()
    for t in said[:200]:
        assert T.escaped(t.encode()).decode() == escaped(t, ("\\", "### ", "</turn>"))
        assert T.unescaped(T.escaped(t.encode())).decode() == t
    out, start, points, a, b = chat.assembled(pa.array([b"assistant"] * len(said), pa.binary()), pa.array([t.encode() for t in said], pa.binary()), T)
    for k, t in enumerate(said):
        body = out[start[k] : start[k + 1]].tobytes().decode()
        assert len(body) == points[k] and T.unescaped(body[a[k] : b[k]].encode()).decode() == t and T.turns(body.encode()) == [(b"assistant", t.encode())]


def test_templates():
    for bad in ("aba", "", "x\\y", "é"):
        with pytest.raises(ValueError):
            chat.Template(closing=bad)
    with pytest.raises(ValueError):
        chat.Template(opening="<<|", closing="|>>")
    other = chat.Template(opening="<<[", middle="=", closing="|>>", ending="", escape="%")
    rnd = random.Random(8)
    for _ in range(300):
        turns = [tuple("".join(rnd.choice("<>[|=%a") for _ in range(rnd.randint(0, 9))).encode() for _ in range(2)) for _ in range(3)]
        text = b"".join(b"<<[" + other.escaped(r, True) + b"=" + other.escaped(t) + b"|>>" for r, t in turns)
        assert other.turns(text) == turns


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001"])
def test_query_against_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{sf}/conversations.parquet'")
    want = con.execute(chat.OP13_SQL)
    names = [c[0] for c in want.description]
    got = chat.op13_chat_format(spark, sf)
    assert sorted(map(tuple, got.select(names).collect())) == sorted(want.fetchall())
