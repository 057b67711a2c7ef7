import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from psephos.llm import packing, tokens
from psephos.llm.common import shared_path

ODD = [" ", "  ", "\n", "\t", "a", "Bc", "é", "é", "'s", "'ll", "12", "!!", "\xa0", "\x1c", "<|endoftext|>", "<|", "漢字", "Σ", "İ", "ﬁ", "\x85", "\r\n", "ΑΣ", "́", "É", "ñ,", "(", "'", "=\u0338", "x" * 70, "9", ".", "\u2003", "\u3000 ", "ÿ", "×", "\0", "<|startoftext|>", "<|ENDOFTEXT|>"]


@pytest.mark.parametrize("name,kind", [("byte_bpe_50k.json", "byte"), ("word_bpe_49k.json", "word")])
def test_chunks_give_the_ids_of_whole_texts(name, kind):
    rnd = random.Random(3)
    texts = ["".join(rnd.choice(ODD) for _ in range(rnd.randint(0, 14))) for _ in range(12000)]
    whole, own = Tokenizer.from_file(P.path(name)), tokens.Encoder(P.path(name), kind, most_chunks=2000)
    for i in range(0, len(texts), 500):
        part = texts[i : i + 500]
        flat, n = own.encode([t.encode() for t in part])
        assert [x.tolist() for x in np.split(flat, np.cumsum(n)[:-1])] == [x.ids for x in whole.encode_batch(part, add_special_tokens=False)]


ROWS = [(7, "the the"), (3, None), (5, ""), (7, "the the"), (None, "x y"), (-2, "long " * 6000), (9, "né\n\n b  c ")]


def docs(spark):
    return spark.createDataFrame([(i, t, 1) for i, t in ROWS], "doc_id long, text string, part int")


def ids_of(name, text, end):
    return [*Tokenizer.from_file(P.path(name)).encode(text or "", add_special_tokens=False).ids, end]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_token_files_round_trip(spark):
    path = shared_path(spark, "t")
    tokens.write_tokens(docs(spark), path, P.path("byte_bpe_50k.json"))
    want, start = [], 0
    for i, t in sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = ids_of("byte_bpe_50k.json", t, 0)
        want.append((i, start, len(ids), crc(ids)))
        start += len(ids)
    got = sorted(map(tuple, tokens.token_digests(spark, path).collect()), key=lambda r: r[1])
    assert got == want
    assert sorted(r.doc_id for r in tokens.read_tokens(spark, path, 5, 7).collect()) == [5, 7, 7]
    assert tokens.read_tokens(spark, path, 9).select("ids").first().ids == ids_of("byte_bpe_50k.json", ROWS[-1][1], 0)


def test_empty_tables(spark):
    none = docs(spark).where("false")
    path = shared_path(spark, "t")
    tokens.write_tokens(none, path, P.path("byte_bpe_50k.json"))
    assert tokens.token_digests(spark, path).count() == 0
    assert packing.pack(none, P.path("word_bpe_49k.json")).count() == 0


def test_pack(spark):
    out = packing.pack(docs(spark), P.path("word_bpe_49k.json")).collect()
    want = []
    for i, t in ROWS:
        ids = ids_of("word_bpe_49k.json", t, 1)
        want += [(i, k, k * 4096, len(ids[k * 4096 : (k + 1) * 4096]), crc(ids[k * 4096 : (k + 1) * 4096])) for k in range(-(-len(ids) // 4096))]
    assert sorted(map(str, [tuple(r)[:5] for r in out])) == sorted(map(str, want))
    placed(out)


def placed(rows):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in by.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 4096
    return len(by)


def test_plan_is_best_fit_decreasing():
    rnd = random.Random(5)
    for room in (10, 64):
        counts = {k: rnd.randint(0, 30) for k in range(1, room + 1)}
        rows, n = packing.plan(counts, room)
        seen = {}
        for length, first, seq, offset, copies in rows.tolist():
            last = min([f for k, f, *_ in rows.tolist() if k == length and f > first] or [counts[length]])
            for d in range(last - first):
                seen.setdefault(seq + d // copies, []).append((offset + length * (d % copies), length))
        assert sum(map(len, seen.values())) == sum(counts.values()) and len(seen) == n
        for own in seen.values():
            at = 0
            for offset, length in sorted(own):
                assert offset == at
                at += length
            assert at <= room
        left = []  # one document at a time
        for length in sorted((k for k, c in counts.items() for _ in range(c)), reverse=True):
            fits = [x for x in left if x >= length]
            if fits:
                left.remove(min(fits))
                left.append(min(fits) - length)
            else:
                left.append(room - length)
        assert n == len(left)
