"""Overlap chunking: long texts are split at word boundaries into chunks that own the words that begin in them and carry the next few."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from .bytescan import buffers, slices, spans
from .shared import named, small_batches

#: A chunk owns the words that begin in so many bytes of its text; texts up to that size are left alone.
CHUNK_BYTES = 32_768


def letters_and_digits() -> np.ndarray:
    """Separators that leave ASCII letters and digits and all bytes of longer characters."""
    t = np.ones(256, bool)
    t[48:58] = t[65:91] = t[97:123] = False
    t[128:] = False
    return t


def is_long(text: str, size: int = CHUNK_BYTES):
    """Whether a text is to be chunked; not so for null."""
    return F.coalesce(F.octet_length(named(text)) > size, F.lit(False))


def word_strings(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """Byte ranges of a buffer, ascending and apart, as an Arrow array of strings."""
    size = np.r_[0, np.cumsum(end - start)]
    if size[-1] and len(start):
        edge = np.zeros(len(data) + 1, "i1")
        edge[start] += 1
        edge[end] -= 1
        data = data[np.cumsum(edge[:-1]).astype(bool)]
    else:
        data = data[:0]
    kind, offsets = (pa.string(), size.astype("i4")) if size[-1] < 1 << 31 else (pa.large_string(), size)
    return pa.Array.from_buffers(kind, len(start), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


def chunked(df: DataFrame, text: str, sep: np.ndarray, carry: int, size: int = CHUNK_BYTES) -> DataFrame:
    """A row for each chunk of each text: all columns, text replaced by the chunk's, and chunk, first, owned.

    A chunk owns the words that begin in its `size` bytes of the text and ends with up to `carry` words more, so
    every run of carry + 1 words lies whole in the chunk that owns its first word, and in no other one as such.
    first is the place of its first word in the text, owned the number of words it owns. Chunks without a word of their own
    are left out, but for a text without any word, which has one empty chunk. Words are never cut: one that is longer
    than a chunk stays whole. Columns named chunk, first and owned are replaced.
    """
    small_batches(df.sparkSession)
    rest = [c for c in df.columns if c not in (text, "chunk", "first", "owned")]
    rows = df.select(named(text).alias("text"), *[named(c).alias(f"c{i}") for i, c in enumerate(rest)])
    added = [StructField("text", StringType()), StructField("chunk", IntegerType()), StructField("first", LongType()), StructField("owned", LongType())]
    out = StructType([StructField(f.name, f.dataType) for f in rows.schema.fields[1:]] + added)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 0):
                data, off = buffers(part.column(0))
                start, end, doc = spans(data, off, sep)
                if not len(start):
                    row = np.arange(len(part))
                    texts, chunk, first, owned = [""] * len(part), row * 0, row * 0, row * 0
                else:
                    no = (start - off[doc]) // size
                    head = np.flatnonzero(np.r_[True, (np.diff(doc) != 0) | (np.diff(no) != 0)])
                    stop = np.r_[head[1:], len(start)]
                    words = np.searchsorted(doc, np.arange(len(part) + 1))
                    last = np.minimum(stop + carry, words[doc[head] + 1])
                    raw = data.tobytes()
                    texts = [raw[a:b].decode() for a, b in zip(start[head].tolist(), end[last - 1].tolist())]
                    row, chunk, first, owned = doc[head], no[head], head - words[doc[head]], stop - head
                    bare = np.setdiff1d(np.arange(len(part)), row)
                    zero = np.zeros(len(bare), "i8")
                    texts, row = texts + [""] * len(bare), np.r_[row, bare]
                    chunk, first, owned = np.r_[chunk, zero], np.r_[first, zero], np.r_[owned, zero]
                kept = [c.take(pa.array(row)) for c in part.columns[1:]]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(texts, pa.string()), pa.array(chunk, pa.int32()), pa.array(first, pa.int64()), pa.array(owned, pa.int64())], names=out.names)

    return rows.mapInArrow(run, out).toDF(*rest, text, "chunk", "first", "owned")
