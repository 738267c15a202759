"""Token-id files: fixed-size id blocks transposed into bit or byte planes, each plane zstandard-compressed, with a chunk index."""

from __future__ import annotations

import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytescan import Hasher, Memory, buffers, claim, lower_az, not_letter, slices, spans, trim
from .shared import shared_dir

MAGIC = b"LSBP0001"
#: Ids of a block; documents of an ordered bucket (a file), about. Beyond MOST_FILES x FILE_DOCS documents, files grow instead.
BLOCK_IDS, FILE_DOCS, MOST_FILES = 65_536, 20_000, 65_536
#: Words that a worker remembers, and bytes beyond which a word is not one of them.
REMEMBERED, LONG_WORD = 3_000_000, 256
# How the tokenizer's file must normalise and cut texts.
EXPECTED = [
    {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
    None,
]


# -- the format -----------------------------------------------------------------------------------------------------


def shuffled(ids: np.ndarray, mode: str) -> list[bytes]:
    """The planes of a block of unsigned 32-bit ids, lowest first, as far as any is not all zero."""
    raw = np.ascontiguousarray(ids, "<u4").view("u1").reshape(-1, 4)
    if mode == "byte":
        planes = [raw[:, i] for i in range(4)]
    else:
        bits = np.unpackbits(raw, axis=1, bitorder="little")
        planes = [np.packbits(bits[:, i]) for i in range(32)]
    while planes and not planes[-1].any():
        planes.pop()
    return [p.tobytes() for p in planes]


def unshuffled(planes: list[bytes], n: int, mode: str) -> np.ndarray:
    if mode == "byte":
        raw = np.zeros((n, 4), "u1")
        for i, p in enumerate(planes):
            raw[:, i] = np.frombuffer(p, "u1")
    else:
        bits = np.zeros((n, 32), "u1")
        for i, p in enumerate(planes):
            bits[:, i] = np.unpackbits(np.frombuffer(p, "u1"), count=n)
        raw = np.packbits(bits, axis=1, bitorder="little")
    return raw.view("<u4").ravel()


class Writer:
    """magic, compressed planes of each block, index, length of the index (8 bytes), magic.

    The index is zstandard-compressed JSON: mode, ids, documents, and for each block its offset, number of ids and
    plane sizes; one more entry holds the documents' ids and lengths as an Arrow table.
    """

    def __init__(self, out, mode: str = "bit", block: int = BLOCK_IDS, level: int = 1):
        import zstandard

        self.out, self.mode, self.block = out, mode, block
        self.zstd = zstandard.ZstdCompressor(level=level)
        self.at = out.write(MAGIC) or len(MAGIC)
        self.held: list[np.ndarray] = []
        self.count, self.total, self.documents, self.chunks = 0, 0, 0, []
        self.docs: list[pa.Table] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.add_many(pa.array([doc_id], pa.int64()), np.array([len(ids)]), ids)

    def add_many(self, doc_ids: pa.Array, sizes: np.ndarray, ids: np.ndarray) -> None:
        """Documents with their numbers of ids, and the ids of all one after the other."""
        self.docs.append(pa.table({"doc_id": doc_ids.cast(pa.int64()), "n": pa.array(sizes, pa.int64())}))
        self.documents += len(doc_ids)
        self.held.append(ids)
        self.count += len(ids)
        if self.count >= self.block:
            both = np.concatenate(self.held)
            cut = len(both) // self.block * self.block
            for s in range(0, cut, self.block):
                self._flush(both[s : s + self.block])
            self.held, self.count = [both[cut:]], len(both) - cut

    def _flush(self, ids: np.ndarray) -> None:
        planes = [self.zstd.compress(p) for p in shuffled(ids, self.mode)]
        self.chunks.append([self.at, len(ids), [len(p) for p in planes]])
        for p in planes:
            self._put(p)
        self.total += len(ids)

    def _put(self, raw: bytes) -> None:
        self.out.write(raw)
        self.at += len(raw)

    def close(self) -> None:
        if self.count:
            self._flush(np.concatenate(self.held))
        table = pa.concat_tables(self.docs) if self.docs else pa.table({"doc_id": pa.array([], pa.int64()), "n": pa.array([], pa.int64())})
        table = table.combine_chunks()
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema) as w:
            w.write_table(table)
        raw = self.zstd.compress(sink.getvalue().to_pybytes())
        where = [self.at, len(raw)]
        self._put(raw)
        index = self.zstd.compress(json.dumps({"mode": self.mode, "ids": self.total, "documents": where, "chunks": self.chunks}).encode())
        self._put(index)
        self._put(struct.pack("<Q", len(index)) + MAGIC)
        self.out.close()


class Reader:
    """Random access to the blocks of one file; `source` reads, seeks and knows its size."""

    def __init__(self, source):
        import zstandard

        self.f, self.zstd = source, zstandard.ZstdDecompressor()
        size = source.size()
        tail = self._read(size - 16, 16)
        if tail[8:] != MAGIC or self._read(0, 8) != MAGIC:
            raise ValueError("not a token-id file, or cut short")
        n = struct.unpack("<Q", tail[:8])[0]
        self.index = json.loads(self.zstd.decompress(self._read(size - 16 - n, n)))
        at, n = self.index["documents"]
        self.docs = pa.ipc.open_stream(self.zstd.decompress(self._read(at, n))).read_all()

    def _read(self, at: int, n: int) -> bytes:
        self.f.seek(at)
        return self.f.read(n)

    def block(self, i: int) -> np.ndarray:
        at, n, sizes = self.index["chunks"][i]
        raw, planes = self._read(at, sum(sizes)), []
        for s in sizes:
            planes.append(self.zstd.decompress(raw[:s]))
            raw = raw[s:]
        return unshuffled(planes, n, self.index["mode"])

    def documents(self) -> Iterator[tuple[int | None, np.ndarray]]:
        """Every document's id and ids, in order, with one block and one document in memory."""
        held, i = np.zeros(0, "u4"), 0
        for d, n in zip(self.docs["doc_id"].to_pylist(), self.docs["n"].to_pylist()):
            parts, have = [held], len(held)
            while have < n:
                parts.append(self.block(i))
                have += len(parts[-1])
                i += 1
            both = np.concatenate(parts) if len(parts) > 1 else held
            yield d, both[:n]
            held = both[n:]


# -- tokens ---------------------------------------------------------------------------------------------------------


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: printable ones for themselves, all others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b if b in plain else next(rest)) for b in range(256)]


class Tokens:
    """Ids of whole texts under a `tokenizers` file whose normaliser folds white space, without special tokens.

    No token reaches across white space, so words are found in whole buffers. A plain word (letters below U+0250, then
    at most common punctuation) is cut into its letters and its punctuation, as the file's own pre-tokeniser cuts it;
    the pieces are hashed (64 bits), each distinct one is tokenized once and remembered, and the ids of all are
    gathered. Words beyond LONG_WORD bytes are tokenized where they stand.

    A file with another normaliser or pre-tokeniser than the expected ones is refused.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if [spec["normalizer"], spec["pre_tokenizer"], spec["post_processor"]] != EXPECTED:
            raise ValueError("not a tokenizer of lower-cased words")
        self.model, self.letter = self.tok.model, dict(enumerate(byte_letters()))
        self.same, self.low = np.arange(256, dtype="u1"), lower_az()
        self.space, self.tail = np.isin(self.same, (9, 10, 32)), np.isin(self.same, list(b".,!?;:"))
        self.odd = not_letter()
        self.odd[0xC2] = True  # signs, digits and spaces from U+0080 to U+00BF, whose few letters go with them
        self.odd[0xCA:] = True  # so that U+00C0 to U+024F are the only letters beyond ASCII
        self._forget()

    def _forget(self) -> None:
        self.memory, self.ids = Memory(), np.zeros(0, "u4")
        self.begin, self.size = np.zeros(0, "i8"), np.zeros(0, "i8")

    def tokenize(self, word: bytes, plain: bool) -> list[int]:
        if plain:
            return [t.id for t in self.model.tokenize(word.decode().lower().encode().decode("latin-1").translate(self.letter))]
        return self.tok.encode(word.decode(), add_special_tokens=False).ids

    def learn(self, hashes: np.ndarray, words: list[bytes], plain: np.ndarray) -> None:
        ids = [self.tokenize(w, p) for w, p in zip(words, plain.tolist())]
        size = np.fromiter(map(len, ids), "i8", len(ids))
        self.begin = np.concatenate([self.begin, len(self.ids) + np.cumsum(size) - size])
        self.size = np.concatenate([self.size, size])
        self.ids = np.concatenate([self.ids, np.fromiter(chain.from_iterable(ids), "u4", size.sum())])
        self.memory.add(hashes)

    def cut(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, ...]:
        """Start, end, document, hash and plainness of every piece: letters and punctuation of plain words, whole words else."""
        start, end, doc = spans(data, off, self.space)
        tail, at = end.copy(), np.arange(len(end))
        while len(at):
            at = at[(tail[at] > start[at])]
            at = at[self.tail[data[tail[at] - 1]]]
            tail[at] -= 1
        odd = self.odd[data]
        pair = data[:-1].astype("u2") << 8 | data[1:]
        odd[:-1] |= np.isin(pair, (0xC397, 0xC3B7, 0xC4B0))  # two signs that are no letters, and one that has two in lower case
        seen = np.r_[0, np.cumsum(odd)]
        plain = (tail > start) & (seen[tail] == seen[start]) & (tail - start <= LONG_WORD)
        two = plain & (tail < end)
        first = np.cumsum(1 + two) - 1 - two
        n = len(start) + int(two.sum())
        s, e, d, p = np.empty(n, "i8"), np.empty(n, "i8"), np.empty(n, "i8"), np.zeros(n, bool)
        s[first], e[first], d[first], p[first] = start, np.where(plain, tail, end), doc, plain
        then = first[two] + 1
        s[then], e[then], d[then] = tail[two], end[two], doc[two]
        h = Hasher(data, self.same)(s, e)
        at = np.flatnonzero(p)
        h[at] = Hasher(data, self.low)(s[at], e[at])
        return s, e, d, h, p

    def encode(self, texts: pa.Array, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, each with the id `end` after it, and the number of each text's ids."""
        data, off = buffers(texts)
        start, stop, doc, h, plain = self.cut(data, off)
        raw = data.tobytes()
        long = np.flatnonzero(stop - start > LONG_WORD)
        at = self.memory.find(h)
        at[long] = 0
        miss = np.flatnonzero(at < 0)
        if len(miss):
            if len(self.memory) + len(miss) > REMEMBERED and len(self.memory):
                self._forget()
                miss = np.flatnonzero(stop - start <= LONG_WORD)
            new, first = np.unique(h[miss], return_index=True)
            first = miss[first]
            self.learn(new, [raw[s:e] for s, e in zip(start[first].tolist(), stop[first].tolist())], plain[first])
            at = self.memory.find(h)
            at[long] = 0
        if not len(self.memory):  # nothing but long words
            self.learn(np.zeros(1, "u8"), [b""], np.zeros(1, bool))
        begin, size, ids = self.begin[at], self.size[at], self.ids
        if len(long):
            own = [np.array(self.tokenize(raw[start[i] : stop[i]], False), "u4") for i in long]
            size[long] = [len(x) for x in own]
            begin[long] = len(ids) + np.cumsum(size[long]) - size[long]
            ids = np.concatenate([ids, *own])
        count = np.bincount(doc, size, len(texts)).astype("i8") if len(doc) else np.zeros(len(texts), "i8")
        to = np.cumsum(size)
        flat = ids[np.repeat(begin - (to - size), size) + np.arange(to[-1] if len(to) else 0)]
        if end is None:
            return flat, count
        out = np.full(len(flat) + len(texts), end, "u4")
        body = np.ones(len(out), bool)
        body[np.cumsum(count + 1) - 1] = False
        out[body] = flat
        return out, count + 1


@lru_cache(2)
def tokens(path: str) -> Tokens:
    return Tokens(path)


# -- writing and reading ----------------------------------------------------------------------------------------------


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a URI; Hadoop's names of object stores are those that Arrow knows without their last letter."""
    uri = re.sub("^s3[an]://", "s3://", uri)
    return pafs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (pafs.LocalFileSystem(), uri)


class Buckets:
    """Ordered buckets of about `rows` rows of a document id, rows without id last.

    `cuts` are the ids at even quantiles: one that occurs m times there heads m buckets of its own, to which its rows
    are dealt in turn, and the ids beyond it get the next; so are rows without id to as many as they ask for.
    """

    def __init__(self, cuts: list[int], nulls: int, rows: int):
        ids, times = np.unique(np.array(cuts, "i8"), return_counts=True)
        heavy = times > 1
        after = ids[heavy] + 1
        after = after[~np.isin(after, ids)]
        self.ids, at = np.unique(np.concatenate([ids, after]), return_index=True)
        self.parts = np.concatenate([times, np.ones(len(after), "i8")])[at]
        self.first = 1 + np.cumsum(self.parts) - self.parts
        self.null_first = 1 + int(self.parts.sum())
        self.null_parts = max(1, -(-nulls // rows))
        self.count = self.null_first + self.null_parts

    def of(self, ids: np.ndarray, null: np.ndarray, turn: np.ndarray) -> np.ndarray:
        out = np.zeros(len(ids), "i8")
        if len(self.ids):
            i = np.searchsorted(self.ids, ids, side="right") - 1
            some = i >= 0
            out[some] = (self.first[i] + turn % self.parts[i])[some]
        out[null] = self.null_first + turn[null] % self.null_parts
        return out


def _encode(path: str, end: int, buckets: Buckets, wide: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("tokens", tokens.cache_clear)
        t, seen = tokens(path), 0
        for b in batches:
            for part in slices(b, 1):
                ids, count = t.encode(part.column(1), end)
                null = part.column(0).is_null().to_numpy(zero_copy_only=False)
                doc = part.column(0).fill_null(0).to_numpy(zero_copy_only=False)
                bucket = buckets.of(doc, null, seen + np.arange(len(part)))
                seen += len(part)
                raw = ids.astype("<u4" if wide else "<u2")
                off = np.r_[0, np.cumsum(count)] * raw.itemsize
                packed = pa.Array.from_buffers(pa.large_binary(), len(part), [None, pa.py_buffer(off.astype("i8")), pa.py_buffer(raw)]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(bucket.astype("i4")), part.column(0), packed], names=["bucket", "doc_id", "ids"])

    return run


def _write(folder: str, mode: str, wide: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _open(folder)
        fs.create_dir(base, recursive=True)
        writer, now, name, done = None, None, "", []

        def close() -> None:
            writer.close()
            final = f"{base}/part-{now:06d}.bp"
            fs.move(name, final)  # a task run twice puts the same documents there
            done.append((now, f"{folder}/part-{now:06d}.bp", writer.documents, writer.total))

        for b in batches:
            bucket = b.column(0).to_numpy()
            data, off = buffers(b.column(2))
            ids, off = data.view("<u4" if wide else "<u2"), off // (4 if wide else 2)
            for s, e in _runs(bucket):
                if bucket[s] != now:
                    if writer:
                        close()
                    now, name = bucket[s], f"{base}/.{uuid.uuid4().hex}"
                    writer = Writer(fs.open_output_stream(name), mode)
                writer.add_many(b.column(1).slice(s, e - s), np.diff(off[s : e + 1]), ids[off[s] : off[e]].astype("<u4"))
        if writer:
            close()
        trim()
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.int32()), pa.array([d[1] for d in done], pa.string()), pa.array([d[2] for d in done], pa.int64()), pa.array([d[3] for d in done], pa.int64())], names=["bucket", "path", "documents", "tokens"])

    return run


def _runs(a: np.ndarray) -> Iterator[tuple[int, int]]:
    """Begin and end of every run of equal values."""
    at = np.r_[0, np.flatnonzero(a[1:] != a[:-1]) + 1, len(a)] if len(a) else np.zeros(1, "i8")
    return zip(at[:-1].tolist(), at[1:].tolist())


def write(docs: DataFrame, path: str, end: int, folder: str | None = None, mode: str = "bit", doc_id: str = "doc_id", text: str = "text") -> list[tuple[str, int, int]]:
    """Encode every whole text, append the id `end`, and write all in ascending doc_id order; (file, documents, first token) of every file in order.

    Texts are encoded where they are read; ids alone are shuffled, to ordered buckets of about FILE_DOCS documents by
    quantiles of doc_id, one bucket a task and one file a bucket, so no task holds more than a block and the driver
    sees one row a file. Files appear whole under their final names, so a lost executor's task can run again.

    Null texts are empty (the end id alone). Equal doc_ids stand together in no particular order, those without doc_id
    last; where so many rows share an id (or have none) that they fill several buckets, they are dealt to these in
    turn. An empty table writes no file. Other columns are ignored.
    """
    from tokenizers import Tokenizer

    folder = folder or f"{shared_dir(docs.sparkSession)}/loopscope/tokens-{uuid.uuid4().hex}"
    wide = max(Tokenizer.from_file(path).get_vocab_size(), end) > 0xFFFF
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    n, some = rows.agg(F.count(F.lit(1)), F.count("doc_id")).first()
    if not n:
        return []
    parts = min(MOST_FILES, -(-some // FILE_DOCS))
    cuts = rows.agg(F.percentile_approx("doc_id", [i / parts for i in range(1, parts)], 20 * parts).alias("b")).first()["b"] if parts > 1 else []
    buckets = Buckets(cuts, n - some, FILE_DOCS)
    coded = rows.mapInArrow(_encode(path, end, buckets, wide), "bucket int, doc_id long, ids binary")
    files = coded.repartitionById(buckets.count, F.col("bucket")).sortWithinPartitions("bucket", F.asc_nulls_last("doc_id")).mapInArrow(_write(folder, mode, wide), "bucket int, path string, documents long, tokens long").collect()
    out, at = [], 0
    for r in sorted(files):
        out.append((r["path"], r["documents"], at))
        at += r["tokens"]
    return out


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for path, at in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            fs, name = _open(path)
            with fs.open_input_file(name) as f:
                docs, starts, sizes, sums = [], [], [], []
                for d, ids in Reader(f).documents():
                    docs.append(d)
                    starts.append(at)
                    sizes.append(len(ids))
                    sums.append(zlib.crc32(np.ascontiguousarray(ids, "<u4")))
                    at += len(ids)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (docs, starts, sizes, sums)], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def read(spark, files: list[tuple[str, int, int]]) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files that write() listed; a task a file."""
    rows = spark.createDataFrame([(f, at) for f, _, at in files], "path string, first long")
    return rows.repartition(max(1, len(files))).mapInArrow(_read, "doc_id long, start long, n_tokens long, ids_crc32 long")
