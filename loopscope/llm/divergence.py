"""Divergence of sources: how unlike the term shares of a language's sources are, pair by pair and term by term, from an inverted index."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .bytescan import buffers, lower_az, not_letter, slices, spans, trim
from .chunking import word_strings
from .shared import named, small_batches, staged

#: Documents that a term of a language must be in; ranks of terms that are returned.
LEAST_DOCS, MOST_TERMS = 3, 200
#: Shares are in units of a billionth, which is 31,250 x 32,000: two steps of long division stay exact up to 2.9e14 occurrences.
STEPS = (31_250, 32_000)
#: Bytes of text that are counted at a time, and rows of counts that a task holds before it hands them on.
COUNT_BYTES, HELD_ROWS = 4 << 20, 300_000
#: Rows of counts that the index is built from at a time, and pairs of postings that a task holds.
BUILT_ROWS, HELD_PAIRS = 50_000, 1_000_000
COUNTS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])


def _count(part: pa.RecordBatch) -> pa.Table:
    """lang, source, term, n (occurrences), docs of a batch (text, lang, source); a row without a term for each of its groups."""
    names = list(zip(part.column(1).fill_null("").to_pylist(), part.column(2).fill_null("").to_pylist()))
    kinds = sorted(set(names))
    at = {k: i for i, k in enumerate(kinds)}
    group = np.array([at[x] for x in names], "i8")
    data, off = buffers(part.column(0))
    data = lower_az()[data]
    start, end, doc = spans(data, off, not_letter())
    coded = word_strings(data, start, end).dictionary_encode()
    code, terms = coded.indices.to_numpy().astype("i8"), coded.dictionary
    k = max(1, len(terms))
    pair, n = np.unique(doc * k + code, return_counts=True)
    key, inv = np.unique(group[pair // k] * k + pair % k, return_inverse=True)
    langs, sources = (pa.array([x[i] for x in kinds], pa.string()) for i in (0, 1))
    of = pa.array(key // k)
    some = pa.table([langs.take(of), sources.take(of), terms.take(pa.array(key % k)).cast(pa.string()), pa.array(np.bincount(inv, n, len(key)).astype("i8")), pa.array(np.bincount(inv, minlength=len(key)).astype("i8"))], schema=COUNTS)
    zero = pa.array(np.zeros(len(kinds), "i8"))
    return pa.concat_tables([pa.table([langs, sources, pa.nulls(len(kinds), pa.string()), zero, zero], schema=COUNTS), some])


def _merged(parts: list[pa.Table]) -> pa.Table:
    """Equal (lang, source, term) summed, group by group, so that what is shuffled compresses well."""
    both = pa.concat_tables(parts)
    both = both.group_by(["lang", "source", "term"]).aggregate([("n", "sum"), ("docs", "sum")]).rename_columns(COUNTS.names)
    return both.sort_by([("lang", "ascending"), ("source", "ascending")])


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.Table] = []
    for batch in batches:
        for part in slices(batch, 0, COUNT_BYTES):
            held.append(_count(part))
            if sum(map(len, held)) > HELD_ROWS:
                held = [_merged(held)]
            if len(held[0]) > HELD_ROWS:
                yield from held.pop().to_batches(100_000)
                trim()
    if held:
        yield from _merged(held).to_batches(100_000)
    del held
    trim()


def term_counts(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """lang, source, term, n, docs: occurrences and documents of every term in every group; a row without a term for every group."""
    small_batches(docs.sparkSession)
    rows = docs.select(named(text).alias("text"), named(lang).cast("string").alias("lang"), named(source).cast("string").alias("source"))
    own = rows.mapInArrow(_counts, "lang string, source string, term string, n long, docs long").repartition("lang", "source", "term")  # tasks have summed their own
    return own.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _postings(least: int):
    """Rows (lang, term, source, n, docs) in the order of lang and term as rows of the index; the last term waits for the next rows."""

    def closed(rows: pa.Table, last: bool) -> tuple[pa.RecordBatch, pa.Table]:
        rows = rows.combine_chunks()
        codes = [rows[c].combine_chunks().dictionary_encode().indices.to_numpy() if rows.num_rows else np.zeros(0, "i4") for c in ("lang", "term")]
        head = np.flatnonzero(np.r_[True, (np.diff(codes[0]) != 0) | (np.diff(codes[1]) != 0)][: rows.num_rows])
        upto = rows.num_rows if last else int(head[-1])
        head = head[head < upto]
        n, docs = rows["n"].to_numpy()[:upto], rows["docs"].to_numpy()[:upto]
        stop = np.r_[head[1:], upto][: len(head)]
        kept = np.flatnonzero(np.add.reduceat(docs, head) >= least) if len(head) else head
        total = np.add.reduceat(n, head)[kept] if len(head) else n[:0]
        size = stop[kept] - head[kept]
        at = pa.array(np.repeat(head[kept] - (np.cumsum(size) - size), size) + np.arange(size.sum()))
        first = pa.array(head[kept])
        flat = pa.StructArray.from_arrays([rows["source"].combine_chunks().take(at), rows["n"].combine_chunks().take(at)], names=["source", "n"])
        lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(size)].astype("i4")), flat)
        out = pa.RecordBatch.from_arrays([rows["lang"].combine_chunks().take(first), rows["term"].combine_chunks().take(first), pa.array(total), lists], names=["lang", "term", "total", "postings"])
        return out, rows.slice(upto)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for batch in batches:
            held.append(pa.table(batch))
            if sum(map(len, held)) >= BUILT_ROWS:
                out, rest = closed(pa.concat_tables(held), False)
                held = [rest]
                yield out
        if held:
            yield closed(pa.concat_tables(held), True)[0]

    return run


def inverted_index(counts: DataFrame, least: int = LEAST_DOCS) -> DataFrame:
    """lang, term, total, postings (source, n) of every term that at least `least` documents of its language hold.

    A term's postings are one for each source that has it, however many rows that source has; they are gathered from rows
    sorted by term, so nothing but one term's is held longer than its batch.
    """
    rows = counts.where("term is not null").select("lang", "term", "source", "n", "docs").repartition("lang", "term").sortWithinPartitions("lang", "term")
    return rows.mapInArrow(_postings(least), "lang string, term string, total long, postings array<struct<source:string,n:long>>")


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (lang, postings) as lang, a, n_a, b, n_b, m: how often a posting of each kind stands before one of the other."""
    held: list[pa.RecordBatch] = []
    pairs = 0
    for batch in batches:
        held.append(batch)
        size = np.diff(batch.column(1).offsets.to_numpy()).astype("i8")
        pairs += int((size * (size - 1) // 2).sum())
        if pairs >= HELD_PAIRS:
            yield from _met(pa.Table.from_batches(held))
            held, pairs = [], 0
    if held:
        yield from _met(pa.Table.from_batches(held))
    del held
    trim()


def _met(rows: pa.Table) -> Iterator[pa.RecordBatch]:
    rows = rows.combine_chunks()
    lists = rows["postings"].combine_chunks()
    off = lists.offsets.to_numpy().astype("i8")
    size, flat, off = np.diff(off), lists.flatten(), off - off[0]
    lang, source = rows["lang"].combine_chunks().dictionary_encode(), flat.field("source").dictionary_encode()
    n = flat.field("n").to_numpy()
    counts, code = np.unique(n, return_inverse=True)
    kind = (np.repeat(lang.indices.to_numpy(), size).astype("i8") * max(1, len(source.dictionary)) + source.indices.to_numpy()) * max(1, len(counts)) + code
    kinds, kind = np.unique(kind, return_inverse=True)
    after = np.repeat(off[1:], size) - np.arange(len(kind)) - 1  # postings of the term behind each
    upto, at = np.cumsum(after), 0
    while at < len(kind):
        to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + 2 * HELD_PAIRS, side="right")))
        k = after[at:to]
        left = np.repeat(np.arange(at, to), k)
        right = left + 1 + np.arange(len(left)) - np.repeat(np.cumsum(k) - k, k)
        key, m = np.unique(kind[left] * len(kinds) + kind[right], return_counts=True)
        a, b = kinds[key // len(kinds)], kinds[key % len(kinds)]
        name = lambda x: source.dictionary.take(pa.array(x // len(counts) % len(source.dictionary)))
        own = lambda x: pa.array(counts[x % len(counts)])
        at = to
        yield pa.RecordBatch.from_arrays([lang.dictionary.take(pa.array(a // len(counts) // len(source.dictionary))), name(a), own(a), name(b), own(b), pa.array(m.astype("i8"))], names=["lang", "a", "n_a", "b", "n_b", "m"])


def share(n: Column, all_: Column, kinds: Column) -> Column:
    """1 + floor(1e9 (n + 1) / (all + kinds)), in long arithmetic; null where there are no kinds."""
    whole = F.when(kinds > 0, all_ + kinds)
    first = (n + 1) * STEPS[0]
    q, r = _div(first, whole), first % whole
    return 1 + q * STEPS[1] + _div(r * STEPS[1], whole)


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def gap(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / q)."""
    return _div((p - q) * (p - q), q)


def count_kinds(index: DataFrame) -> DataFrame:
    """lang, source, n, m: how many kept terms occur n times in a group."""
    return index.select("lang", F.inline("postings")).groupBy("lang", "source", "n").agg(F.count(F.lit(1)).alias("m"))


def groups(counts: DataFrame, index: DataFrame, kinds: DataFrame) -> DataFrame:
    """lang, source, kinds (V), own (N), total (of the language), zero (the share of a term that the group lacks) of every group."""
    sizes = kinds.groupBy("lang", "source").agg(F.sum(F.col("n") * F.col("m")).alias("own"))
    langs = index.groupBy("lang").agg(F.count(F.lit(1)).alias("kinds"), F.sum("total").alias("total"))
    out = counts.where("term is null").select("lang", "source").join(sizes, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0, ["own", "kinds", "total"])
    return out.withColumn("zero", share(F.lit(0).cast("long"), F.col("own"), F.col("kinds")))


def pair_values(index: DataFrame, group: DataFrame, some: DataFrame) -> DataFrame:
    """lang, source, item (another source of the language), value: the gaps of all kept terms summed.

    A pair starts at V times the gap of two zero counts. A term that only one of the two holds corrects that by the gap of
    its share to the other's zero: such corrections depend on the count alone, so they come from `some`, how many terms
    have each count. A term that both hold corrects once more for its pair of counts, and such pairs are counted by
    (source, count, source, count) where the postings are, before anything is shuffled. Nothing is emitted where both
    counts are zero.
    """
    a = group.select("lang", F.col("source").alias("a"), F.col("own").alias("own_a"), F.col("zero").alias("zero_a"), "kinds")
    b = group.select("lang", F.col("source").alias("b"), F.col("own").alias("own_b"), F.col("zero").alias("zero_b"))
    own_a = lambda n: share(F.col(n), F.col("own_a"), F.col("kinds"))
    own_b = lambda n: share(F.col(n), F.col("own_b"), F.col("kinds"))
    wide = lambda c: c.cast("decimal(38,0)")
    base = gap(F.col("zero_a"), F.col("zero_b"))
    two = a.join(b, "lang").where("a <> b")
    start = two.select("lang", "a", "b", F.coalesce(wide(F.col("kinds")) * base, wide(F.lit(0))).alias("v"))
    in_a = some.withColumnRenamed("source", "a").join(two, ["lang", "a"])
    in_b = some.withColumnRenamed("source", "b").join(two, ["lang", "b"])
    one = in_a.select("lang", "a", "b", (wide(gap(own_a("n"), F.col("zero_b")) - base) * F.col("m")).alias("v"))
    other = in_b.select("lang", "a", "b", (wide(gap(F.col("zero_a"), own_b("n")) - base) * F.col("m")).alias("v"))
    met = index.where(F.size("postings") > 1).select("lang", "postings").mapInArrow(_pairs, "lang string, a string, n_a long, b string, n_b long, m long")
    met = met.groupBy("lang", "a", "n_a", "b", "n_b").agg(F.sum("m").alias("m"))
    met = met.join(a, ["lang", "a"]).join(b, ["lang", "b"])

    def both(p: Column, p0: Column, q: Column, q0: Column) -> Column:
        return wide(gap(p, q) - gap(p, q0) - gap(p0, q) + gap(p0, q0)) * F.col("m")

    met = met.select("lang", "a", "b", F.array(both(own_a("n_a"), F.col("zero_a"), own_b("n_b"), F.col("zero_b")), both(own_b("n_b"), F.col("zero_b"), own_a("n_a"), F.col("zero_a"))).alias("v"))
    there, back = met.select("lang", "a", "b", F.col("v")[0].alias("v")), met.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), F.col("v")[1].alias("v"))
    all_ = start.unionByName(one).unionByName(other).unionByName(there.unionByName(back))
    return all_.groupBy("lang", F.col("a").alias("source"), F.col("b").alias("item")).agg(F.sum("v").cast("long").alias("value"))


def term_values(index: DataFrame, group: DataFrame) -> DataFrame:
    """lang, source, item (a kept term that the group holds and whose share there is above the language's), value: its gap."""
    held = index.select("lang", F.col("term").alias("item"), "total", F.inline("postings")).join(group.withColumnRenamed("total", "all"), ["lang", "source"])
    held = held.withColumn("p", share(F.col("n"), F.col("own"), F.col("kinds"))).withColumn("q", share(F.col("total"), F.col("all"), F.col("kinds")))
    return held.where("p > q").select("lang", "source", "item", gap(F.col("p"), F.col("q")).alias("value"))


def audit(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least: int = LEAST_DOCS, most: int = MOST_TERMS) -> DataFrame:
    """lang, source, part, item, value, rank: each group's divergence from the language's other sources, and its `most` most typical terms.

    Terms are runs of ASCII letters (lower-cased) and of all characters beyond ASCII; a language keeps those that at least `least`
    of its rows hold. A share is 1 + floor(1e9 (count + 1) / (all + kinds)) and a gap floor((p - q)^2 / q), in whole
    numbers. Part `pair` has all other sources of the language, part `term` up to `most` terms; ranks go by value,
    descending, then by item as UTF-8.

    Texts are counted where they are read, so what is shuffled is a row a task, group and term; a group that holds most rows has as many
    terms as it has words, not rows. The terms' window keeps `most` rows a group and task before its shuffle. Null text,
    lang and source are the empty string; a group without terms has its zero counts; a language without kept terms has pairs of value
    0; a language of one source has no pairs. Repeated rows count as often as they occur. Other columns are ignored. An
    empty table gives no rows.
    """
    counts = staged(term_counts(docs, text, lang, source), "term-counts")
    index = staged(inverted_index(counts, least), "inverted-index")
    kinds = staged(count_kinds(index), "count-kinds")
    group = staged(groups(counts, index, kinds), "groups")
    by = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pair_values(index, group, kinds).withColumn("rank", F.row_number().over(by))
    terms = term_values(index, group).withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= most)
    both = pairs.withColumn("part", F.lit("pair")).unionByName(terms.withColumn("part", F.lit("term")))
    return both.select("lang", "source", "part", "item", "value", "rank")
