"""Benchmark decontamination: a positional inverted index of the corpus, in which windows of test words are found as phrases or nearly so."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, BooleanType, IntegerType, LongType, StringType, StructField, StructType

from .bytescan import buffers, lower_az, slices, spans
from .chunking import chunked, is_long, letters_and_digits, word_strings
from .shared import named, small_batches, staged

#: Words of a window.
WIDTH = 10
#: Words of a segment of the index, about; empty places between its texts, so that no phrase leads from one to the next.
SEGMENT_WORDS, BETWEEN = 1_000_000, 64
#: The index keeps the test's terms alone as long as they are at most so many; beyond, it keeps every term.
MOST_TERMS = 1_000_000
#: Pairs of window and item that are searched for at a time, in one broadcast; candidates that a task holds at a time.
BLOCK_PAIRS, CANDIDATES = 200_000, 2_000_000
#: Text bytes cut into words at a time.
PART_BYTES = 8 << 20


def _words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts in order, and each text's number of words."""
    data, off = buffers(texts)
    data = lower_az()[data]
    start, end, doc = spans(data, off, letters_and_digits())
    return word_strings(data, start, end), np.bincount(doc, minlength=len(texts)) if len(doc) else np.zeros(len(texts), "i8")


# -- the test ---------------------------------------------------------------------------------------------------------


def windows_of(items: DataFrame, item_id: str = "item_id", text: str = "text", width: int = WIDTH) -> DataFrame:
    """terms, item: every run of `width` words of every item, once an item; of an item with fewer, all its words."""
    small_batches(items.sparkSession)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 0):
                words, n = _words(part.column(0))
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n)].astype("i4")), words.cast(pa.string()))
                yield pa.RecordBatch.from_arrays([part.column(1), lists], names=["item", "words"])

    rows = items.select(named(text).alias("text"), F.coalesce(named(item_id).cast("string"), F.lit("")).alias("item")).mapInArrow(cut, "item string, words array<string>")
    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - width + 1, F.lit(1)))
    return rows.where(F.size("words") > 0).select("item", F.explode(F.transform(starts, lambda i: F.slice("words", i, width))).alias("terms")).distinct()


class Block:
    """Windows to be searched for together: their words as codes, each window's words from the rarest on, and its items."""

    def __init__(self, terms: list[list[str]], items: list[str], frequency: dict[str, int]):
        kinds: dict[tuple[str, ...], int] = {}
        of = [kinds.setdefault(tuple(t), len(kinds)) for t in terms]
        self.names = sorted(set(items))
        at = {x: i for i, x in enumerate(self.names)}
        by = sorted(zip(of, (at[x] for x in items)))
        self.items = np.array([i for _, i in by], "i8")
        self.item_at = np.searchsorted(np.array([w for w, _ in by], "i8"), np.arange(len(kinds) + 1))
        vocabulary = sorted({t for k in kinds for t in k})
        self.vocabulary = pa.array(vocabulary, pa.string())
        code = {t: i for i, t in enumerate(vocabulary)}
        width = max(map(len, kinds), default=1)
        self.size = np.array([len(k) for k in kinds], "i8")
        self.code = np.full((len(kinds), width), -1, "i8")
        for i, k in enumerate(kinds):
            self.code[i, : len(k)] = [code[t] for t in k]
        often = np.array([frequency.get(t, 0) for t in vocabulary] + [1 << 62], "i8")  # the last stands for what a short window lacks
        self.order = np.argsort(often[self.code], axis=1, kind="stable")


# -- the index --------------------------------------------------------------------------------------------------------


def index(docs: DataFrame, vocabulary: list[str] | None = None, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH, slop: int = 0) -> DataFrame:
    """Postings of the texts' words, a row a segment: texts that were read together, about SEGMENT_WORDS words.

    A segment has its texts' row, doc_id, place of the first word (base), words and owned words, what of the text goes
    before (first) and whether that is the whole text; and its terms, each term's number of places, and all places, term by
    term as gaps, compressed. With a vocabulary only its terms are kept. Long texts are chunks that carry the width - 1 + slop
    words after their own, dealt over all tasks. Null and wordless texts have a place and no words.
    """
    small_batches(docs.sparkSession)
    kind = docs.schema[doc_id].dataType
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)
    rows = docs.select(named(text).alias("text"), F.monotonically_increasing_id().alias("row"), named(doc_id).alias("doc_id"))
    long = chunked(rows.where(is_long("text")), "text", letters_and_digits(), width - 1 + slop).hint("rebalance")
    none = F.lit(None).cast("long")
    both = rows.where(~is_long("text")).select("text", "row", "doc_id", F.lit(0).cast("long").alias("first"), none.alias("owned")).unionByName(long.select("text", "row", "doc_id", "first", "owned"))
    longs, ints = ArrayType(LongType()), ArrayType(IntegerType())
    schema = StructType([StructField("rows", longs), StructField("doc_ids", ArrayType(kind)), StructField("first", longs), StructField("owned", longs), StructField("whole", ArrayType(BooleanType())), StructField("base", ints), StructField("terms", ArrayType(StringType())), StructField("sizes", ints), StructField("places", BinaryType())])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = None if sent.value is None else pa.array(sent.value, pa.string())
        held, n = [], 0
        for batch in batches:
            for part in slices(batch, 0, PART_BYTES):
                words, count = _words(part.column(0))
                base = n + np.cumsum(count + BETWEEN) - count - BETWEEN
                place = np.repeat(base - (np.cumsum(count) - count), count) + np.arange(len(words))
                n = int(base[-1] + count[-1] + BETWEEN)
                if kept is not None:
                    mask = pc.is_in(words, value_set=kept.cast(words.type))
                    words, place = words.filter(mask), place[mask.to_numpy(zero_copy_only=False)]
                own = part.column(4).fill_null(1 << 60).to_numpy()
                held.append((part.columns[1:4], np.minimum(own, count), own == 1 << 60, base, words.cast(pa.large_string()), place))
                if n >= SEGMENT_WORDS:
                    yield segment(held)
                    held, n = [], 0
        if held:
            yield segment(held)

    def segment(held: list[tuple]) -> pa.RecordBatch:
        import zstandard

        coded = pa.concat_arrays([h[4] for h in held]).dictionary_encode()
        code, place = coded.indices.to_numpy(), np.concatenate([h[5] for h in held])
        order = np.argsort(code, kind="stable")
        sizes = np.bincount(code, minlength=len(coded.dictionary))
        gaps = np.diff(place[order], prepend=0)
        head = np.cumsum(sizes) - sizes
        gaps[head] = place[order][head]
        packed = zstandard.ZstdCompressor(level=1).compress(gaps.astype("<i4").tobytes())
        columns = [pa.concat_arrays([h[0][i] for h in held]) for i in range(3)]
        columns += [pa.array(np.concatenate([h[i] for h in held])) for i in (1, 2)] + [pa.array(np.concatenate([h[3] for h in held]), pa.int32())]
        columns += [coded.dictionary.cast(pa.string()), pa.array(sizes, pa.int32())]
        lists = [pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c) for c in columns]
        return pa.RecordBatch.from_arrays([*lists, pa.array([packed], pa.binary())], names=schema.names)

    return both.mapInArrow(build, schema)


def frequencies(segments: DataFrame) -> DataFrame:
    """term, n: how many places each term of the index has."""
    pairs = segments.select(F.explode(F.arrays_zip("terms", "sizes")).alias("x"))
    return pairs.groupBy(F.col("x.terms").alias("term")).agg(F.sum("x.sizes").alias("n"))


# -- the search -------------------------------------------------------------------------------------------------------


class Segment:
    """Places of a block's terms in one row of the index, as one ascending array of (code, place)."""

    def __init__(self, row: dict, block: Block):
        import zstandard

        self.base, self.owned = row["base"].to_numpy(), row["owned"].to_numpy()
        sizes = row["sizes"].to_numpy().astype("i8")
        place = np.frombuffer(zstandard.ZstdDecompressor().decompress(row["places"]), "<i4").astype("i8")
        if len(sizes):
            place = np.cumsum(place)
            head = np.cumsum(sizes) - sizes
            place -= np.repeat(np.r_[0, place[head[1:] - 1]], sizes)
        code = pc.index_in(row["terms"], value_set=block.vocabulary).fill_null(-1).to_numpy()
        code = np.repeat(code, sizes)
        some = code >= 0
        code, place = code[some], place[some]
        order = np.argsort(code, kind="stable")
        self.keys = np.r_[code[order].astype("i8") << 32 | place[order], 1 << 62]
        self.start = np.searchsorted(self.keys[:-1], np.arange(len(block.vocabulary) + 1, dtype="i8") << 32)

    def find(self, block: Block, slop: int = 0) -> tuple[np.ndarray, ...]:
        """window, text, first and last place (within the text) of every occurrence whose first word its text owns.

        Candidates are the places of a window's rarest term, moved back by its place in the window; the other terms' lists
        are met from the rarer to the more frequent one, and only what is left goes on.
        """
        n = np.diff(self.start)
        have = np.r_[n, 1][block.code]  # a short window lacks nothing
        able = np.flatnonzero((have > 0).all(1))
        lead = block.order[able, 0]
        count = n[block.code[able, lead]]
        out, at = [], 0
        upto = np.cumsum(count * (2 * slop + 1))
        while at < len(able):
            to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + CANDIDATES, side="right")))
            w, c = able[at:to], count[at:to]
            begin = self.start[block.code[w, lead[at:to]]]
            got = self.keys[np.repeat(begin - (np.cumsum(c) - c), c) + np.arange(c.sum())] & 0xFFFFFFFF
            out.append(self.follow(block, np.repeat(w, c), got - np.repeat(lead[at:to], c), slop))
            at = to
        window, first, last = (np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, "i8"),) * 3
        text = np.searchsorted(self.base, first, side="right") - 1
        own = first - self.base[text] < self.owned[text] if len(text) else np.zeros(0, bool)
        window, text, first, last = window[own], text[own], first[own], last[own]
        return window, text, first - self.base[text], last - self.base[text]

    def follow(self, block: Block, w: np.ndarray, first: np.ndarray, slop: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if slop:  # the first word stands where it is; the rarest one may be off its place
            moved = (first + np.arange(-slop, slop + 1)[:, None]).ravel()
            w = np.tile(w, 2 * slop + 1)
            keep = moved >= 0
            w, first = w[keep], moved[keep]
            key = block.code[w, 0] << 32 | first
            keep = self.keys[np.searchsorted(self.keys, key)] == key
            both = np.unique(np.stack([w[keep], first[keep]]), axis=1)
            w, first = both[0], both[1]
        else:
            keep = first >= 0
            w, first = w[keep], first[keep]
        last = first.copy()
        for j in range(0 if slop else 1, block.code.shape[1]):
            k = block.order[w, j]
            code = block.code[w, k]
            low = np.where(k == 0, first, np.maximum(first + k - slop, first + 1))
            high = np.where(k == 0, first, first + k + slop)
            got = self.keys[np.searchsorted(self.keys, code << 32 | low)]
            none = code < 0
            keep = none | (got <= (code << 32 | high))
            last = np.maximum(last, np.where(none, 0, got & 0xFFFFFFFF))[keep]
            w, first = w[keep], first[keep]
        if not slop:
            last = first + block.size[w] - 1
        return w, first, last


def _spread(values: np.ndarray, heads: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs values[heads[i]:heads[i + 1]] for i in which, one after the other, and which of them each value comes from."""
    n = heads[which + 1] - heads[which]
    return values[np.repeat(heads[which] - (np.cumsum(n) - n), n) + np.arange(n.sum())], np.repeat(np.arange(len(which)), n)


def merged(text: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The union of stretches of each text, as stretches that neither touch nor overlap."""
    order = np.lexsort((first, text))
    text, first, last = text[order], first[order], last[order]
    far = np.int64(1 << 40)
    reach = np.maximum.accumulate(last + text * far)
    new = np.r_[True, (first + text * far)[1:] > reach[:-1] + 1] if len(text) else np.zeros(0, bool)
    head = np.flatnonzero(new)
    stop = np.r_[head[1:], len(text)][: len(head)]
    return text[head], first[head], reach[stop - 1] - text[head] * far if len(head) else last


def _rows(batch: pa.RecordBatch) -> Iterator[dict]:
    for i in range(len(batch)):
        yield {n: (c[i].as_py() if n == "places" else c[i].values) for n, c in zip(batch.schema.names, batch.columns)}


FOUND = "row long, doc_id {kind}, whole boolean, n_words long, ranges array<struct<first:long,last:long>>, items array<string>"


def _lists(of: np.ndarray, n: int, values: pa.Array) -> pa.ListArray:
    """Values as one list for each of n texts; `of` ascends."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(of, np.arange(n + 1)), pa.int32()), values)


def search(segments: DataFrame, block: Block, counted: bool = True) -> DataFrame:
    """row, doc_id, whole, n_words (0 unless counted), ranges (stretches of its words that windows cover), items, for every text or chunk of the index."""
    sent = segments.sparkSession.sparkContext.broadcast(block)
    kind = segments.schema["doc_ids"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = sent.value
        names = pa.array(b.names, pa.string())
        for batch in batches:
            for row in _rows(batch):
                n, shift = len(row["rows"]), row["first"].to_numpy()
                window, text, first, last = Segment(row, b).find(b)
                item, of = _spread(b.items, b.item_at, window)
                pairs = np.unique(text[of] * len(names) + item) if len(item) else np.zeros(0, "i8")
                items = _lists(pairs // max(1, len(names)), n, names.take(pa.array(pairs % max(1, len(names)))))
                text, first, last = merged(text, first, last)
                ranges = pa.StructArray.from_arrays([pa.array(first + shift[text], pa.int64()), pa.array(last + shift[text], pa.int64())], names=["first", "last"])
                words = row["owned"].to_numpy() if counted else np.zeros(n, "i8")
                yield pa.RecordBatch.from_arrays([row["rows"], row["doc_ids"], row["whole"], pa.array(words), _lists(text, n, ranges), items], names=["row", "doc_id", "whole", "n_words", "ranges", "items"])

    return segments.mapInArrow(run, FOUND.format(kind=kind))


def covered(ranges: Column) -> Column:
    """How many words the union of (first, last) stretches covers."""
    zero = F.struct(F.lit(-1).cast("long").alias("last"), F.lit(0).cast("long").alias("n"))
    grown = lambda a, r: F.struct(F.greatest(a["last"], r["last"]).alias("last"), (a["n"] + F.greatest(r["last"] - F.greatest(a["last"], r["first"] - 1), F.lit(0))).alias("n"))
    return F.aggregate(F.array_sort(ranges), zero, grown, lambda a: a["n"])


def _blocks(windows: DataFrame, segments: DataFrame) -> Iterator[Block]:
    """All pairs of window and item in blocks of about BLOCK_PAIRS, dealt by hash, with the index's frequencies of their terms."""
    blocks = max(1, -(-windows.count() // BLOCK_PAIRS))
    often = staged(frequencies(segments), "frequencies")
    for k in range(blocks):
        part = windows.where(F.pmod(F.xxhash64("terms", "item"), F.lit(blocks)) == k)
        own = often.join(part.select(F.explode("terms").alias("term")).distinct(), "term", "left_semi")
        got, n = part.toArrow(), own.toArrow()
        yield Block(got["terms"].to_pylist(), got["item"].to_pylist(), dict(zip(n["term"].to_pylist(), n["n"].to_pylist())))


def _prepared(docs: DataFrame, items: DataFrame, doc_id: str, item_id: str, width: int, slop: int) -> tuple[DataFrame, DataFrame]:
    windows = staged(windows_of(items, item_id, "text", width), "windows")
    kinds = staged(windows.select(F.explode("terms").alias("term")).distinct(), "test-terms")
    vocabulary = kinds.toArrow()["term"].to_pylist() if kinds.count() <= MOST_TERMS else None
    return windows, staged(index(docs, vocabulary, doc_id, "text", width, slop), "positional-index")


def contamination(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", width: int = WIDTH) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every row of docs.

    Words are runs of ASCII letters (lower-cased) and digits and of all characters beyond ASCII. A window is a run of `width` words
    of an item's text, or the whole of an item with fewer words; n_hit counts the words of a document that lie in any
    occurrence of any window, n_items the different item ids with one, and items_sha256 is the digest of those ids, sorted
    as strings and joined by commas.

    Segments of the index are searched where they lie: no list of places is shuffled, however frequent its term. Windows are
    broadcast in blocks of about BLOCK_PAIRS; more of them take more passes over the index. Chunks of a long text are
    put together by its row. Null, empty and wordless texts have no words and no hits; items without words have no
    window, items without an id count under the empty one, and repeated items once. Rows are documents of their own, whatever ids repeat.
    Other columns are ignored. Without items nothing is hit; without documents there are no rows.
    """
    windows, segments = _prepared(docs, items, doc_id, item_id, width, 0)
    found = None
    for k, block in enumerate(_blocks(windows, segments)):
        part = search(segments, block, k == 0)
        found = part if found is None else found.unionByName(part)
    found = staged(found, "hits")
    several = found.where(~F.col("whole")) if k == 0 else found
    together = several.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.sum("n_words").alias("n_words"), F.flatten(F.collect_list("ranges")).alias("ranges"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))
    if k == 0:
        together = together.unionByName(found.where("whole").select("row", "doc_id", "n_words", "ranges", "items"))
    hit = covered(F.col("ranges"))
    return together.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", F.array_sort("items")), 256).alias("items_sha256"), (F.size("ranges") > 0).alias("contaminated"))


def matches(docs: DataFrame, items: DataFrame, slop: int = 0, doc_id: str = "doc_id", item_id: str = "item_id", width: int = WIDTH) -> DataFrame:
    """doc_id, item_id, first, last, exact: every occurrence of every window, as places of words within the text, from 0.

    With slop = 0 all are phrases. With more (under BETWEEN - width), a window also matches where its first word stands at a place and
    every other word after it, at most `slop` words off where the phrase has it; exact tells phrases apart. An item is
    reported once for each place where any of its windows begins. Edge cases as in contamination().
    """
    if not 0 <= slop < BETWEEN - width:
        raise ValueError("slop must be less than the places between texts")
    windows, segments = _prepared(docs, items, doc_id, item_id, width, slop)
    kind = segments.schema["doc_ids"].dataType.elementType.simpleString()
    out = None
    for block in _blocks(windows, segments):
        sent = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            b = sent.value
            for batch in batches:
                for row in _rows(batch):
                    seg, shift = Segment(row, b), row["first"].to_numpy()
                    window, text, first, last = seg.find(b, slop)
                    phrase = {x for x in zip(*(y.tolist() for y in seg.find(b)[:3]))} if slop else None
                    exact = np.array([x in phrase for x in zip(window.tolist(), text.tolist(), first.tolist())], bool) if slop else np.ones(len(window), bool)
                    item, of = _spread(b.items, b.item_at, window)
                    to = pa.array(text[of])
                    yield pa.RecordBatch.from_arrays([row["rows"].take(to), row["doc_ids"].take(to), pa.array([b.names[i] for i in item], pa.string()), pa.array((first + shift[text])[of], pa.int64()), pa.array((last + shift[text])[of], pa.int64()), pa.array(exact[of])], names=["row", "doc_id", "item_id", "first", "last", "exact"])

        part = segments.mapInArrow(run, f"row long, doc_id {kind}, item_id string, first long, last long, exact boolean")
        out = part if out is None else out.unionByName(part)
    return out.groupBy("row", "doc_id", "item_id", "first").agg(F.max(F.struct("exact", "last")).alias("m")).select("doc_id", "item_id", "first", F.col("m.last").alias("last"), F.col("m.exact").alias("exact"))
