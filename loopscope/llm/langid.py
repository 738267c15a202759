"""Language ID with interpolated Kneser-Ney character models."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

from .bytescan import SLICE_BYTES, Sorted, claim, mix, slices, trim
from .shared import aside, named, staged

#: Units of the longest gram; a gram is four UTF-16 units in one 64-bit key (letters beyond U+FFFF are two units).
ORDER = 4
#: Cross-entropies are counted in bins of so many nats for the rejection bounds; the scales that the score tries.
BIN, SCALES = 1e-4, 2.0 ** np.arange(0, 9)
SPACE = 32


@lru_cache(1)
def _letters() -> np.ndarray:
    """Code point -> lower-case letter, or a space for anything else."""
    out = np.full(0x110000, SPACE, "u4")
    for c in range(0x110000):
        ch = chr(c)
        if ch.isalpha():
            out[c] = ord(ch.lower()) if len(ch.lower()) == 1 else c
    return out


def _units(c: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-16 units of code points, and where texts that begin at some code points begin among the units."""
    wide = c > 0xFFFF
    if not wide.any():
        return c.astype("u2"), begins
    at = np.arange(len(c)) + np.cumsum(wide) - wide
    out = np.zeros(len(c) + int(wide.sum()), "u2")
    out[at] = np.where(wide, 0xD7C0 + (c >> 10), c)
    out[at[wide] + 1] = 0xDC00 + (c[wide] & 0x3FF)
    return out, np.append(at, len(out))[begins]


def grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all grams of the texts, and how many each text has: runs of other characters are one space, with spaces at both ends."""
    strings = texts.to_pylist()
    size = np.array([len(s) for s in strings], "i8") + 1
    joined = (" ".join(strings) + " ").encode("utf-32-le", "surrogatepass")
    c = _letters()[np.frombuffer(joined, "u4")]
    gap = c == SPACE
    keep = ~gap
    keep[1:] |= gap[1:] & ~gap[:-1]
    ends = np.cumsum(size)
    begins = ends - size
    keep[begins] = ~gap[begins]
    kept = np.add.reduceat(keep, begins, dtype="i8") if len(begins) else np.zeros(0, "i8")
    c, at = _units(c[keep], np.cumsum(kept) - kept)
    kept = np.diff(np.append(at, len(c)))
    n = np.where(np.logical_or.reduceat(np.append(c != SPACE, False), at) & (kept > 0), kept, 0) if len(kept) else kept  # 0 for a text without letters
    keys = np.zeros(len(c), "u8")
    for back in range(ORDER):
        shifted = np.full(len(c), SPACE, "u8")
        shifted[back:] = c[: len(c) - back]
        if back:
            for i in range(back):
                idx = at + i
                shifted[idx[(kept > i)]] = SPACE
        keys |= shifted << np.uint64(16 * back)
    if (n != kept).any():
        keys = keys[np.repeat(n == kept, kept)]
    return keys, n


def _pieces(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    claim("langid", _letters.cache_clear)
    for b in batches:
        yield from slices(b, column, SLICE_BYTES)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, gram, n of (lang, text): one row for each language and gram of the partition."""
    held: dict[str, list] = {}

    def merge(parts: list) -> list:
        k, n = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        order = np.argsort(k)
        k, n = k[order], n[order]
        at = np.flatnonzero(np.r_[True, k[1:] != k[:-1]]) if len(k) else np.zeros(0, "i8")
        return [(k[at], np.add.reduceat(n, at) if len(at) else n)]

    for part in _pieces(batches, 1):
        lang = np.array(part.column(0).to_pylist(), object)
        keys, n = grams(part.column(1))
        of = np.repeat(np.arange(len(n)), n)
        for name in dict.fromkeys(lang):
            k, c = np.unique(keys[(lang == name)[of]], return_counts=True)
            held.setdefault(name, []).append((k, c))
            if len(held[name]) >= 32:
                held[name] = merge(held[name])
    for name, parts in held.items():
        k, c = merge(parts)[0]
        yield pa.RecordBatch.from_arrays([pa.array([name] * len(k), pa.string()), pa.array(k.view("i8")), pa.array(c.astype("i8"))], names=["lang", "gram", "n"])


class Hashed(Sorted):
    """A sorted array of the hashes of keys."""

    def __init__(self, keys: np.ndarray):
        super().__init__(mix(keys.astype("u8")))

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Position in the sorted array, -1 where absent."""
        return super().find(mix(keys))


class Model:
    """Interpolated Kneser-Ney of one language: counts for the longest grams, continuation counts below, absolute discounts."""

    def __init__(self, keys: np.ndarray, n: np.ndarray):
        self.levels = []
        k, c = keys, n.astype("f8")
        for order in range(ORDER, 0, -1):
            ones, twos = (c == 1).sum(), (c == 2).sum()
            d = ones / (ones + 2 * twos) if ones and twos else 0.5
            ctx, inv = np.unique(k >> np.uint64(16), return_inverse=True)
            total, kinds = np.bincount(inv, c), np.bincount(inv)
            grams_, contexts = Hashed(k), Hashed(ctx)
            self.levels.append((np.uint64((1 << (16 * order)) - 1), grams_, ((c - d) / total[inv])[grams_.order], contexts, (d * kinds / total)[contexts.order]))
            if order > 1:  # of each shorter gram: how many characters go before it
                k, c = np.unique(k & np.uint64((1 << (16 * (order - 1))) - 1), return_counts=True)
                c = c.astype("f8")
        self.base = 1.0 / (len(k) + 1)

    def prob(self, keys: np.ndarray) -> np.ndarray:
        p = np.full(len(keys), self.base)
        for mask, grams_, share, contexts, rest in reversed(self.levels):
            k = keys & mask
            c = contexts.find(k >> np.uint64(16))
            g = grams_.find(k)
            seen = c >= 0
            p[seen] = p[seen] * rest[c[seen]]
            hit = g >= 0
            p[hit] += share[g[hit]]
        return p


class Identifier:
    """All languages' models over one sorted hash array of grams; a text's language has the lowest cross-entropy per character."""

    def __init__(self, counts: dict[str, tuple[np.ndarray, np.ndarray]]):
        self.langs = sorted(counts)
        self.models = [Model(*counts[x]) for x in self.langs]
        union = np.unique(np.concatenate([counts[x][0] for x in self.langs]))
        self.table = Hashed(union)
        self.logp = np.stack([-np.log(m.prob(union[self.table.order])) for m in self.models], 1).astype("f4")
        self.scale, self.most = 8.0, np.full(len(self.langs), np.inf)

    def entropies(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Texts x languages nats a character, and each text's number of grams (0: no letters)."""
        keys, n = grams(texts)
        out = np.zeros((len(n), len(self.langs)))
        if len(keys):
            at = self.table.find(keys)
            cost = self.logp[at]
            new = np.flatnonzero(at < 0)
            if len(new):
                k, back = np.unique(keys[new], return_inverse=True)
                cost[new] = np.stack([-np.log(m.prob(k)) for m in self.models], 1)[back]
            some = np.flatnonzero(n)
            out[some] = np.add.reduceat(cost, (np.cumsum(n) - n)[some], axis=0, dtype="f8") / n[some, None]
        return out, n

    def limit(self, n: np.ndarray, lang: np.ndarray) -> np.ndarray:
        """Cross-entropy beyond which a text of n characters is rejected: short texts vary more."""
        return self.most[lang] * (1 + 3 / np.sqrt(np.maximum(n, 1)))

    def calibrate(self, own: list[tuple[np.ndarray, np.ndarray]], fits: np.ndarray) -> None:
        """Bounds for rejection from the counts of each language's own texts by cross-entropy (in BIN, ascending), and the scale with the greatest sum of log-likelihoods."""
        for i, (e, n) in enumerate(own):
            if len(e):
                place, upto = 0.999 * (n.sum() - 1), np.cumsum(n)
                lo, hi = (e[np.searchsorted(upto, k, "right")] * BIN for k in (math.floor(place), math.ceil(place)))
                self.most[i] = 1.15 * (lo + (hi - lo) * (place - math.floor(place)))
        self.scale = float(SCALES[np.argmax(fits)])

    def answer(self, texts: pa.Array) -> tuple[list, np.ndarray, np.ndarray, np.ndarray]:
        e, n = self.entropies(texts)
        best = e.argmin(1)
        score = 1 / np.exp(-self.scale * (e - e.min(1, keepdims=True))).sum(1)
        own = e[np.arange(len(e)), best]
        none = n == 0
        rejected = none | (own > self.limit(n, best))
        return [None if z else self.langs[i] for i, z in zip(best, none)], np.where(none, 0.0, score), own, rejected


def _measured(batches: Iterator[pa.RecordBatch], model: Identifier) -> Iterator[pa.RecordBatch]:
    """at, bin, n of (lang, text): how many of the partition's texts of each language have which own cross-entropy; and fits, the sums of the true languages' log-likelihoods by scale, in one row with at -1."""
    at_of = {x: i for i, x in enumerate(model.langs)}
    held, fits = np.zeros((0, 3), "i8"), np.zeros(len(SCALES))
    for part in _pieces(batches, 1):
        e, n = model.entropies(part.column(1))
        at = np.array([at_of.get(x, -1) for x in part.column(0).to_pylist()], "i8")
        some = (at >= 0) & (n > 0)
        e, at = e[some], at[some]
        gap = e - e.min(1, keepdims=True)
        true = np.arange(len(at))
        fits += [(-x * gap[true, at] - np.log(np.exp(-x * gap).sum(1))).sum() for x in SCALES]
        new = np.column_stack([at, np.rint(e[true, at] / BIN).astype("i8"), np.ones(len(at), "i8")])
        kinds, back = np.unique(np.concatenate([held, new])[:, :2], axis=0, return_inverse=True)
        held = np.column_stack([kinds, np.bincount(back.ravel(), np.concatenate([held, new])[:, 2], len(kinds)).astype("i8")])
    rows = np.concatenate([held, [[-1, 0, 0]]])
    yield pa.RecordBatch.from_arrays([*map(pa.array, rows.T.copy()), pa.array([None] * len(held) + [fits.tolist()], pa.list_(pa.float64()))], names=["at", "bin", "n", "fits"])


def train(docs: DataFrame, lang: str = "lang", text: str = "text") -> Identifier | None:
    """Counts over all rows with a language and a text; None where there is none.

    Grams are counted partition by partition and summed in a shuffle of one row a partition, language and gram.
    The summed table comes to the driver whole: it holds the kinds of four-letter sequences, not the corpus, but no
    bound is set on it, as dropping rare grams would change discounts and continuation counts. Rejection bounds and the score's scale come from
    all these rows as well: a second pass counts them by cross-entropy in bins of BIN nats, and counts and sums alone reach the driver.
    """
    rows = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text"))
    counts = rows.mapInArrow(_count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    counts = staged(counts, "grams")
    got = counts.toArrow()
    if not len(got):
        return None
    names = np.array(got["lang"].to_pylist(), object)
    keys, n = got["gram"].to_numpy().view("u8"), got["n"].to_numpy()
    out = Identifier({x: (keys[names == x], n[names == x]) for x in set(names)})
    sent = docs.sparkSession.sparkContext.broadcast(out)
    sums = F.struct(*[F.sum(F.col("fits")[i]).alias(f"f{i}") for i in range(len(SCALES))])
    got = rows.mapInArrow(lambda batches: _measured(batches, sent.value), "at long, bin long, n long, fits array<double>").groupBy("at", "bin").agg(F.sum("n").alias("n"), sums.alias("fits")).orderBy("at", "bin").toArrow()
    at, bins, n = (got[c].to_numpy() for c in ("at", "bin", "n"))
    out.calibrate([(bins[at == i], n[at == i]) for i in range(len(out.langs))], np.array(list(got["fits"][0].as_py().values())) if len(got) else np.zeros(1))
    del got, keys, n, names, at, bins
    trim()
    return out


ADDED = ("lang_pred", "lang_score", "cross_entropy", "rejected")


def identify(docs: DataFrame, model: Identifier | None, text: str = "text") -> DataFrame:
    """docs and lang_pred, lang_score (0 to 1), cross_entropy (nats a character), rejected.

    The language with the lowest length-normalised cross-entropy wins (ties: the first by name); the score is its
    share of exp(-scale x cross-entropy). A text whose best cross-entropy lies beyond what its language's own texts
    show is rejected, and so is one that is null, empty or without letters: lang_pred `und`, score 0. Without a
    model (nothing to learn from) every text is `und`. Rows, order-free, come back one for one, whatever they hold
    or repeat; the four names are appended, and replace columns of docs that have them.
    """
    rest = [c for c in docs.columns if c not in ADDED]
    if model is None:
        return docs.select(*map(named, rest)).withColumns({"lang_pred": F.lit("und"), "lang_score": F.lit(0.0), "cross_entropy": F.lit(0.0), "rejected": F.lit(True)})
    rows, fields = aside(docs, text, rest)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    out = StructType([*fields, StructField("lang_pred", StringType()), StructField("lang_score", DoubleType()), StructField("cross_entropy", DoubleType()), StructField("rejected", BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for part in _pieces(batches, 0):
            lang, score, own, bad = m.answer(part.column(0))
            yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array([x or "und" for x in lang], pa.string()), pa.array(score), pa.array(own), pa.array(bad)], names=[*rest, *ADDED])

    return rows.mapInArrow(run, out)
