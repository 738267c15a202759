"""SentencePiece BPE encoding by a prefix table, and decoding."""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType, StructField, StructType

from .bytescan import claim, slices
from .shared import aside

SPACE = "▁"
#: Segments and pairs that a worker remembers.
REMEMBERED = 500_000


class Remembered(dict):
    """A table that makes what it lacks and starts anew when full."""

    def __init__(self, make, most: int):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, key):
        if len(self) >= self.most:
            self.clear()
        out = self[key] = self.make(key)
        return out


class Encoder:
    """Merge-type BPE over the pieces of a SentencePiece model with byte fallback and without text normalisation.

    encode() gives the ids of merging, again and again, the adjacent pair whose joined piece has the best score
    (leftmost of equals). A list of tokens is that encoding if and only if every two neighbours are compatible: the
    pair alone encodes to itself. So each prefix of a text has a unique last token, the one match of the automaton
    that ends there and is compatible with the last token of the prefix before it. One pass fills this table; the
    ids are read off backwards.

    Texts are cut where no piece reaches across: before a word's leading space, around line feeds, and around
    characters without a piece (they become byte ids). Runs of several spaces, whose pieces tie in score, take the
    merges literally.
    """

    def __init__(self, path: str, most: int = REMEMBERED):
        import ahocorasick
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bos, self.eos = sp.bos_id(), sp.eos_id()
        self.ids: dict[str, int] = {}
        self.score: dict[str, float] = {}
        self.byte = [0] * 256
        self.raw: list[bytes] = []
        for i in range(sp.get_piece_size()):
            p = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte[int(p[3:5], 16)] = i
                self.raw.append(bytes([int(p[3:5], 16)]))
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                self.raw.append(b"")
            else:
                self.ids[p] = i
                self.score[p] = sp.get_score(i)
                self.raw.append(p.replace(SPACE, " ").encode())
        self.joined = {p[i : i + 2] for p in self.ids for i in range(len(p) - 1)}  # neighbours inside some piece
        if any(b == SPACE and a != SPACE for a, b in self.joined) or any("\n" in p for p in self.ids):
            raise ValueError("this model's pieces reach across words")
        self.automaton = ahocorasick.Automaton()
        for p in self.ids:
            self.automaton.add_word(p, p)
        self.automaton.make_automaton()
        self.whole = Remembered(lambda p: self.merges(p) == [p], most)
        self.compatible = Remembered(self._compatible, most)
        self.first = Remembered(self._segment, most)  # without and with a leading space
        self.inner = Remembered(self._word, most)
        self.newline = self._bytes("\n")
        self.bytes_of = self.raw.__getitem__

    def _bytes(self, ch: str) -> bytes:
        return np.array([self.byte[b] for b in ch.encode()], "<u4").tobytes()

    def merges(self, text: str) -> list[str]:
        """The pieces of a text by the merges themselves."""
        parts: list[str | None] = list(text)
        n = len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap: list[tuple[float, int, int, str]] = []

        def offer(i: int, j: int) -> None:
            if 0 <= i and j < n and (s := self.score.get(both := parts[i] + parts[j])) is not None:
                heapq.heappush(heap, (-s, i, j, both))

        for i in range(n - 1):
            offer(i, i + 1)
        while heap:
            _, i, j, both = heapq.heappop(heap)
            if parts[i] is None or after[i] != j or parts[j] is None or parts[i] + parts[j] != both:
                continue
            parts[i], parts[j] = both, None
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            offer(before[i], i)
            offer(i, after[i])
        return [p for p in parts if p is not None]

    def _compatible(self, pair: tuple[str, str]) -> bool:
        return self.whole[pair[1]] and (pair[0][-1] + pair[1][0] not in self.joined or self.merges(pair[0] + pair[1]) == list(pair))

    def table(self, text: str) -> list[str]:
        """The pieces of a text whose characters all have pieces, by the prefix table."""
        last: list[str | None] = [None] * len(text)
        compatible = self.compatible
        for end, piece in self.automaton.iter(text):
            before = end - len(piece)
            if before < 0:
                if self.whole[piece]:
                    last[end] = piece
            elif compatible[last[before], piece]:
                last[end] = piece
        out, at = [], len(text) - 1
        while at >= 0:
            out.append(last[at])
            at -= len(last[at])
        return out[::-1]

    def _segment(self, text: str) -> bytes:
        """Little-endian ids of one segment."""
        if not text:
            return b""
        if SPACE * 2 in text:
            parts = self.merges(text)
        else:
            parts, run = [], ""
            for ch in text:
                if ch not in self.ids:
                    parts += [*(self.table(run) if run else ()), ch]
                    run = ""
                elif run and run[-1] + ch not in self.joined:
                    parts += self.table(run)
                    run = ch
                else:
                    run += ch
            if run:
                parts += self.table(run)
        return b"".join(np.array([self.ids[p]], "<u4").tobytes() if p in self.ids else self._bytes(p) for p in parts)

    def _word(self, word: str) -> bytes:
        """Ids of a segment with its leading space; a last character that joins nothing is cut off, so that `word` and `word,` are one entry's work."""
        if len(word) > 1 and word[-2:] not in self.joined and word[-1] in self.ids:
            return self.inner[word[:-1]] + self.first[word[-1]]
        return self._segment(SPACE + word)

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers, with begin and end ids."""
        out = [np.array([self.bos], "<u4").tobytes()]
        if text:
            first, inner = self.first.__getitem__, self.inner.__getitem__
            if SPACE in text:
                text = text.replace(SPACE, " ")
            for i, line in enumerate(text.split("\n")):
                if i:
                    out.append(self.newline)
                elif not line:
                    out.append(inner(""))
                    continue
                words = line.split(" ")
                if not i:
                    words.insert(0, "")
                if "" in words[1:]:
                    words = self._runs(words)
                if words[0]:
                    out.append(first(words[0]))
                out.extend(map(inner, words[1:]))
        out.append(np.array([self.eos], "<u4").tobytes())
        return b"".join(out)

    @staticmethod
    def _runs(words: list[str]) -> list[str]:
        """Empty words join the next one as spaces: runs of spaces stay with what follows them."""
        out, held = [words[0]], ""
        for k, w in enumerate(words[1:], 1):
            if not w and k < len(words) - 1:
                held += SPACE
            else:
                out.append(held + w)
                held = ""
        return out

    def decode(self, ids: bytes) -> str:
        """The text of ids: the leading space that encoding adds goes; bytes that are no UTF-8 become U+FFFD."""
        raw = b"".join(map(self.bytes_of, np.frombuffer(ids, "<u4").tolist()))
        return raw[raw[:1] == b" " :].decode("utf-8", "replace")


@lru_cache(2)
def encoder(path: str, most: int = REMEMBERED) -> Encoder:
    return Encoder(path, most)


def encode(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """docs and ids (binary, little-endian unsigned 32-bit, with begin and end ids) of every whole text; null and empty texts are the two ids alone.

    A row-wise pass without a shuffle; rows come back one for one, whatever they repeat; a column `ids` is replaced.
    """
    rest = [c for c in docs.columns if c != "ids"]
    rows, fields = aside(docs, text, rest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("pieces", encoder.cache_clear)
        e = encoder(path)
        for b in batches:
            for part in slices(b, 0):
                yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array([e.encode(t) for t in part.column(0).to_pylist()], pa.binary())], names=[*rest, "ids"])

    return rows.mapInArrow(run, StructType([*fields, StructField("ids", BinaryType())]))


def decode(rows: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """rows and decoded (string) of a column of ids as encode() makes it; null ids give null."""
    rest = [c for c in rows.columns if c != "decoded"]
    got, fields = aside(rows, ids, rest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array([None if x is None else e.decode(x) for x in b.column(0).to_pylist()], pa.string())], names=[*rest, "decoded"])

    return got.mapInArrow(run, StructType([*fields, StructField("decoded", StringType())]))


def digests(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", most: int = REMEMBERED) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row: encode() and decode() in one pass over each slice; a worker remembers `most` segments and pairs.

    Null and empty texts are the begin and end ids alone; rows come back one for one; other columns are ignored.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("pieces", encoder.cache_clear)
        e = encoder(path, most)
        for b in batches:
            for part in slices(b, 1):
                ids = [e.encode(t) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in ids]), pa.array([hashlib.sha256(e.decode(x).encode()).hexdigest() for x in ids])],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")
