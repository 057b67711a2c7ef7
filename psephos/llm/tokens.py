"""Token ids: encoding by public tokenizers, and Parquet files of ids that can be read in parts."""

from __future__ import annotations

import os
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from psephos.llm.common import give_back_memory, shared_path, table

#: White space beyond ASCII: a space after it belongs to the same run of white space.
_WIDE = re.compile(rb"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")
#: Byte-level alphabet: printable bytes stand for themselves, the others for the characters from 256 on.
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
_ALPHABET = {b: chr(b) for b in _PRINTABLE} | {b: chr(256 + i) for i, b in enumerate(sorted(set(range(256)) - set(_PRINTABLE)))}
_NEVER = "\xff"  # stands for the byte 255, which no UTF-8 text holds
_DIGIT = re.compile("[0-9]")

_SPACE = np.isin(np.arange(256), list(b" \t\n\v\f\r"))
#: Classes of bytes between which pre-tokens end: 1 letters, 2 digits, 3 ASCII punctuation, 5 white space, 0 others.  Latin-1 letters of two bytes are letters as well.
_CLASS = np.zeros(256, np.uint8)
for _k, _b in ((1, b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"), (2, b"0123456789"), (3, rb"""!"#$%&'()*+,-./:;<=>?@[\]^_`{|}~"""), (5, b" \t\n\v\f\r")):
    _CLASS[list(_b)] = _k
#: Second bytes of letters that begin with the byte C3: all but the signs for times and divided by; and those that no lower-casing changes.
_LATIN = {"byte": np.isin(np.arange(256), [*range(0x80, 0x97), *range(0x98, 0xB7), *range(0xB8, 0xC0)]), "word": np.isin(np.arange(256), [0x9F, *range(0xA0, 0xB7), *range(0xB8, 0xC0)])}
_rng = np.random.default_rng(20240229)
_VALUE = _rng.integers(1, 2**63, 256, dtype=np.uint64)
_BASE = int(_rng.integers(1, 2**63)) | 1


class _Powers:
    """Powers of an odd number and of its inverse, modulo 2**64, as far as asked for."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            n = max(n, 2 * len(self.up))
            self.up, self.down = (np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, x, np.uint64)])) for x in (_BASE, pow(_BASE, -1, 2**64)))
        return self.up, self.down


_POWERS = _Powers()


def span_hashes(buffer: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of the bytes, alike wherever the span stands."""
    up, down = _POWERS.upto(len(buffer) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_VALUE[buffer] * up[: len(buffer)])])
    h = (sums[ends] - sums[starts]) * down[starts]
    h ^= (ends - starts).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def _grown(x: np.ndarray, n: int) -> np.ndarray:
    """x at the start of an array of n; the rest of it takes no memory until it is used."""
    out = np.empty(n, x.dtype)
    out[: len(x)] = x
    return out


class Encoder:
    """Encodes texts chunk by chunk; a chunk that is known needs no second encoding.

    kind "byte": byte-level BPE whose pre-tokens take white space at their start only, so a text may be cut wherever white
    space follows other characters.  kind "word": BPE with word ends that drops white space and case, so a text may be cut at any
    ASCII white space, and A-Z lower-cased.  Both also end a pre-token between letters, digits and punctuation, but for letters after an apostrophe.  So the ids are those of the
    whole text; texts with a special token are encoded whole.  Chunks are known by 64-bit hashes, those over `longest` bytes not at all.

    Known chunks lie in a table with two places for each; a new one takes the place of another if both are taken.  Beyond most_chunks, those that were not met since the last time are forgotten.
    """

    def __init__(self, path: str, kind: str, most_chunks: int = 1_200_000, longest: int = 64):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.kind, self.most_chunks, self.longest = Tokenizer.from_file(path), kind, most_chunks, longest
        special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile(b"|".join(map(re.escape, special)) or rb"(?!)", re.IGNORECASE)
        self.bare = Tokenizer(self.tokenizer.model)  # the same vocabulary, held once
        self.bare.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.never = self.bare.encode(_NEVER, add_special_tokens=False).ids
        assert len(self.never) == 1, "the vocabulary lacks single bytes"
        # how a chunk's bytes are spelled for `bare`: space only leads, digits of kind "word" are pre-tokens each
        self.spelled = "".join("\0" if b == 0 else "\n" if b == 10 else _ALPHABET[b] for b in range(256))
        self.bits = max(10, int(most_chunks * 1.7).bit_length())
        self.key, self.at = np.zeros(1 << self.bits, np.uint64), np.zeros(1 << self.bits, np.int32)
        self._forget(np.zeros(0, np.int64))

    # entries: starts and lengths in flat, met since the last forgetting; arrays grow by doubling

    def _forget(self, kept: np.ndarray) -> None:
        """Only the entries `kept` stay."""
        if not len(kept):
            self.n = self.used = 0
            self.starts, self.lengths, self.met, self.flat = np.zeros(1024, np.int32), np.zeros(1024, np.int32), np.zeros(1024, bool), np.zeros(4096, np.int32)
            self.key[:] = 0
            return
        lengths = self.lengths[kept]
        ends = np.cumsum(lengths)
        self.flat = self.flat[np.repeat(self.starts[kept] - (ends - lengths), lengths) + np.arange(int(ends[-1]))]
        new = np.full(self.n, -1, np.int32)
        new[kept] = np.arange(len(kept))
        self.starts, self.lengths, self.met, self.n, self.used = (ends - lengths).astype(np.int32), lengths, np.zeros(len(kept), bool), len(kept), int(ends[-1])
        taken = np.nonzero(self.key)[0]
        self.at[taken] = new[self.at[taken]]
        self.key[taken[self.at[taken] < 0]] = 0

    def _add(self, flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """New entries; their numbers."""
        n, used = self.n + len(starts), self.used + len(flat)
        if n > len(self.starts):
            self.starts, self.lengths, self.met = (_grown(x[: self.n], 2 * n) for x in (self.starts, self.lengths, self.met))
        if used > len(self.flat):
            self.flat = _grown(self.flat[: self.used], 2 * used)
        own = np.arange(self.n, n)
        self.starts[own], self.lengths[own], self.met[own] = starts + self.used, lengths, True
        self.flat[self.used : used] = flat
        self.n, self.used = n, used
        return own

    def _cut(self, buffer: np.ndarray, firsts: np.ndarray, joined: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of the chunks, and the bytes' classes; firsts: where texts start."""
        kinds, begins = _CLASS[buffer], np.zeros(len(buffer) + 1, bool)
        begins[firsts] = True
        lead = np.nonzero(buffer[:-1] == 0xC3)[0]
        lead = lead[_LATIN[self.kind][buffer[lead + 1]]]
        kinds[lead] = kinds[lead + 1] = 1
        space = kinds == 5
        before = np.concatenate([[True], space[:-1]])
        turn = np.zeros(len(buffer), bool)
        turn[1:] = (kinds[1:] != kinds[:-1]) & (kinds[1:] % 5 > 0) & (kinds[:-1] % 5 > 0) & ~((buffer[:-1] == 39) & (kinds[1:] == 1))
        if self.kind == "byte":
            for m in _WIDE.finditer(joined):
                if m.end() < len(before):
                    before[m.end()] = True
            starts = np.nonzero(begins[:-1] | space & ~before | turn)[0]
            return starts, np.append(starts[1:], len(buffer)), kinds
        starts = np.nonzero(~space & (before | begins[:-1] | turn))[0]
        after = np.concatenate([space[1:], [True]])
        ends = np.nonzero(~space & (after | begins[1:] | np.concatenate([turn[1:], [True]])))[0] + 1
        return starts, ends, kinds

    def _encode_chunks(self, buffer: np.ndarray, kinds: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, and each chunk's start and length there.

        Plain chunks, one run of letters, digits or punctuation after at most one space or line end, are spelled in the byte-level alphabet and told apart by a token that no text has.
        """
        sizes = ends - starts
        if not len(starts):
            return np.zeros(0, np.int32), sizes, sizes
        lead = np.zeros(len(starts), bool) if self.kind == "word" else (sizes > 1) & ((buffer[starts] == 32) | (buffer[starts] == 10))
        firsts = np.cumsum(sizes) - sizes
        places = np.repeat(starts - firsts, sizes) + np.arange(int(sizes.sum()))
        own = kinds[places]
        own[firsts[lead]] = own[firsts[lead] + 1]
        low, high = np.minimum.reduceat(own, firsts), np.maximum.reduceat(own, firsts)
        plain = (low == high) & (low % 5 > 0)
        lengths, chunk, begin, outs = np.zeros(len(starts), np.int64), sizes[plain], starts[plain], []
        for f in range(0, len(chunk), 5000):
            n = chunk[f : f + 5000] + 1
            at = np.cumsum(n)
            text = buffer[np.minimum(np.repeat(begin[f : f + 5000] - (at - n), n) + np.arange(int(at[-1])), len(buffer) - 1)]
            text[at - 1] = 0
            text = text.tobytes().decode("latin-1").translate(self.spelled)
            if self.kind == "word":
                text = _DIGIT.sub(r"\g<0> ", text)
            text = text.replace("\n", f"{_ALPHABET[10]} ").replace("\0", f" {_NEVER} ")
            outs.append(np.array(self.bare.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.int32))
        ids = np.concatenate([*outs, np.zeros(0, np.int32)])
        stops = np.nonzero(ids == self.never[0])[0]
        lengths[plain] = np.diff(stops, prepend=-1) - 1
        flat = ids[ids != self.never[0]]
        own = np.cumsum(lengths) - lengths
        if not plain.all():
            rest = np.nonzero(~plain)[0]
            chunks = [buffer[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(starts[rest].tolist(), ends[rest].tolist())]
            found = [x.ids for x in self.tokenizer.encode_batch_fast(chunks, add_special_tokens=False)]
            n = np.fromiter(map(len, found), np.int64, len(found))
            own[rest], lengths[rest] = len(flat) + np.cumsum(n) - n, n
            flat = np.concatenate([flat, np.fromiter((i for x in found for i in x), np.int32, int(n.sum()))])
        return flat, own, lengths

    def _known(self, buffer: np.ndarray, kinds: np.ndarray, hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The entry of each chunk; those not known yet are learned."""
        if self.n > self.most_chunks:
            live = self.at[self.key != 0]
            live = np.unique(live[self.met[live]])
            self._forget(live if len(live) <= self.most_chunks // 2 else live[: self.most_chunks // 2])
        hashes = hashes | np.uint64(1)  # 0 is an empty place
        one = (hashes >> np.uint64(64 - self.bits)).astype(np.int64)
        entry, missed = self.at[one].astype(np.int64), self.key[one] != hashes
        miss = np.nonzero(missed)[0]
        if len(miss):
            two = (hashes[miss] & np.uint64((1 << self.bits) - 1)).astype(np.int64)
            hit = self.key[two] == hashes[miss]
            entry[miss[hit]] = self.at[two[hit]]
            miss = miss[~hit]
        hits = entry[~missed]
        self.met[hits] = True
        if len(miss):
            unique, first, inverse = np.unique(hashes[miss], return_index=True, return_inverse=True)
            s, e = starts[miss[first]], ends[miss[first]]
            own = self._add(*self._encode_chunks(buffer, kinds, s, e))
            entry[miss] = own[inverse]
            place = (unique >> np.uint64(64 - self.bits)).astype(np.int64)
            free = self.key[place] == 0
            self.key[place[free]], self.at[place[free]] = unique[free], own[free]
            left = self.key[place] != unique
            place = (unique[left] & np.uint64((1 << self.bits) - 1)).astype(np.int64)
            self.key[place], self.at[place] = unique[left], own[left]
        return entry

    def _encode_run(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        joined = b"".join(texts)
        joined = joined.lower() if self.kind == "word" else joined
        buffer, sizes = np.frombuffer(joined, np.uint8), np.fromiter(map(len, texts), np.int64, len(texts))
        if not len(buffer):
            return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
        firsts = np.cumsum(sizes) - sizes
        starts, ends, kinds = self._cut(buffer, firsts, joined)
        lengths, offsets = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
        long = ends - starts > self.longest
        if long.any():
            short = ~long
            s, e = starts[short], ends[short]
            at = self._known(buffer, kinds, span_hashes(buffer, s, e), s, e)
            more, own, n = self._encode_chunks(buffer, kinds, starts[long], ends[long])
            lengths[short], offsets[short] = self.lengths[at], self.starts[at]
            lengths[long], offsets[long] = n, self.used + own
            if self.used + len(more) > len(self.flat):
                self.flat = _grown(self.flat[: self.used], 2 * self.used + len(more))
            self.flat[self.used : self.used + len(more)] = more  # beyond what is used: for this run only
            flat = self.flat
        else:
            at = self._known(buffer, kinds, span_hashes(buffer, starts, ends), starts, ends)
            lengths, offsets, flat = self.lengths[at].astype(np.int64), self.starts[at].astype(np.int64), self.flat
        total = np.cumsum(lengths)
        all_ = int(total[-1]) if len(total) else 0
        ids = flat[np.repeat(offsets - (total - lengths), lengths) + np.arange(all_)]
        sums = np.concatenate([[0], total])
        edges = np.searchsorted(starts, np.append(firsts, len(buffer)))
        return ids, np.diff(sums[edges])

    def encode(self, texts: list[bytes], part: int = 1 << 19) -> tuple[np.ndarray, np.ndarray]:
        """All ids on end, and the number of ids of each text.  Texts over `part` bytes are taken in parts, cut at white space where possible."""
        space = re.compile(rb"[!-~][\t-\r ]")
        ids, counts, run, held = [], [], [], 0

        def flush():
            nonlocal run, held
            flat, n = self._encode_run(run)
            ids.append(flat)
            counts.append(n)
            run, held = [], 0

        parts = []
        for t in texts:
            if self.special.search(t):
                flush()
                found = self.tokenizer.encode_batch_fast([t.decode("utf-8", "replace")], add_special_tokens=False)[0].ids
                ids.append(np.array(found, np.int32))
                counts.append(np.array([len(found)], np.int64))
                parts.append(1)
                continue
            at, own = 0, 0
            while len(t) - at > part and (m := space.search(t, at + part)):
                run.append(t[at : m.start() + 1])
                at, own = m.start() + 1, own + 1
                flush()
            run.append(t[at:])
            held += len(run[-1])
            parts.append(own + 1)
            if held >= part:
                flush()
        flush()
        n = np.concatenate(counts)
        ends = np.cumsum(parts)
        sums = np.concatenate([[0], np.cumsum(n)])
        return np.concatenate(ids), np.diff(sums[np.concatenate([[0], ends])])


_ENCODERS: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, kind: str) -> Encoder:
    """This worker's encoder: what it has learned serves its later tasks as well."""
    if (path, kind) not in _ENCODERS:
        _ENCODERS[path, kind] = Encoder(path, kind)
    return _ENCODERS[path, kind]


def text_runs(column: pa.Array, most_bytes: int = 1 << 19):
    """(first row, texts as bytes) in runs of about most_bytes; null is empty."""
    run, first, held = [], 0, 0
    for i, t in enumerate(column.cast(pa.large_binary())):
        run.append(t.as_py() or b"")
        held += len(run[-1])
        if held >= most_bytes:
            yield first, run
            run, first, held = [], i + 1, 0
    if run:
        yield first, run
    give_back_memory()


def crc(ids: np.ndarray) -> int:
    """CRC-32 of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(ids.astype("<u4", copy=False).tobytes())


#: How files of ids are written: delta encoding for numbers, dictionaries for ids, row groups of 32 MB, pages of 64 KB with indexes.
PARQUET = {"parquet.writer.version": "PARQUET_2_0", "parquet.enable.dictionary": "true", "parquet.block.size": str(32 << 20), "parquet.page.size": str(64 << 10), "parquet.page.row.count.limit": "2000", "compression": "zstd"}


def _encoded(path: str, kind: str, end: int):
    def run(batches):
        own, part, start = encoder(path, kind), TaskContext.get().partitionId(), 0
        for b in batches:
            for first, texts in text_runs(b.column(1)):
                flat, n = own.encode(texts)
                ids = np.insert(flat, np.cumsum(n), end).astype(np.int32, copy=False)
                n += 1
                ends = np.cumsum(n)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(first, len(texts)), pa.array(np.full(len(n), part, np.int32)), pa.array(start + ends - n), pa.array(n), pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(ids))],
                    names=["doc_id", "part", "start_in_part", "n_tokens", "ids"],
                )
                start += int(ends[-1])

    return run


def write_tokens(docs: DataFrame, out: str, tokenizer: str, kind: str = "byte", end: int = 0, doc_id: str = "doc_id", text: str = "text", options: dict[str, str] = PARQUET) -> None:
    """Writes the ids of every document, each with an end id, to Parquet files in ascending doc_id order (null first; equal ids by text).

    Columns doc_id, part, start_in_part, n_tokens, ids.  Documents are range-split by id, then encoded where they are written, so
    texts move once and ids never.  Statistics and page indexes on doc_id let a reader skip row groups and pages.  Null and empty
    texts have the end id only; long ones are encoded whole, in parts.  Repeated rows are written each; doc_id is cast to long; other columns are left out, whatever their names.  An empty table makes an empty file.
    """
    dealt = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    rows = dealt.mapInArrow(_encoded(tokenizer, kind, end), "doc_id long, part int, start_in_part long, n_tokens long, ids array<int>")
    rows.write.options(**options).parquet(out)


def read_tokens(spark: SparkSession, path: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """The files' rows, or those with first <= doc_id <= last: the bounds reach the files' row groups and pages."""
    df = spark.read.parquet(path)
    for bound, held in ((first, lambda c: c >= first), (last, lambda c: c <= last)):
        df = df if bound is None else df.where(held(F.col("doc_id")))
    return df


def part_starts(tokens: DataFrame) -> DataFrame:
    """(part, base): ids in all files before part; one row per part, read from metadata columns only."""
    totals = tokens.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    return totals.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))


def _digests(batches):
    for b in batches:
        ids = b.column("ids")
        flat, offsets = ids.flatten().to_numpy(), ids.offsets.to_numpy() - ids.offsets[0].as_py()
        crcs = [crc(flat[s:e]) for s, e in zip(offsets[:-1], offsets[1:])]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("part"), b.column("start_in_part"), pa.array(np.diff(offsets).astype(np.int64)), pa.array(crcs, pa.int64())], names=["doc_id", "part", "start_in_part", "n_tokens", "ids_crc32"])


def token_digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in files of ids."""
    tokens = read_tokens(spark, path)
    rows = tokens.mapInArrow(_digests, "doc_id long, part int, start_in_part long, n_tokens long, ids_crc32 long")
    return rows.join(part_starts(tokens), "part").select("doc_id", (F.col("base") + F.col("start_in_part")).alias("start"), "n_tokens", "ids_crc32")


def op7_token_output(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files; nulls, long and empty texts, repeated rows and empty tables as in write_tokens."""
    import public_tokenizers

    path = shared_path(spark, "tokens")
    write_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"), path, tokenizer or public_tokenizers.path("byte_bpe_50k.json"))
    return token_digests(spark, path)
