"""Toxic spans by a linear-chain conditional random field; marginals add up to document scores.

Labels are of documents, tags of words are latent: a document counts as toxic as soon as one of its words does. The
field is fitted on the likelihood of the documents' labels under that rule, so no list of toxic words is made or kept,
and a word gets its weight from how it helps to explain labels beside the other words of the same documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

from . import labelled
from .bytescan import Sorted, buffers, claim, lower_az, mix, not_letter, slices, trim, words
from .shared import aside

#: Features of a token: the whole word, and its first so many bytes where it has more.
PREFIXES = (6, 5, 4)
KINDS = 1 + len(PREFIXES)
#: Words of one chain at most; chains also end with a sentence, and together they are the whole text.
CHAIN = 64
SENTENCE_ENDS = (10, 33, 46, 63)
#: How far a label `toxic` is trusted: the odds that such a document has a toxic word at all.
TRUST = 0.98
#: Rounds and step of the fit, and its weight decay.
ROUNDS, RATE, DECAY = 60, 1.0, 0.02
#: Share with which a feature that the fit has not seen counts in the mean of a word's weights.
UNSEEN = 0.1
#: Scores of toxic words at a chain's start or after a clean word, at first and at most; and after a toxic word, at most: its neighbours need weights of their own.
RARE, MOST_RARE, FOLLOW = -6.0, -1.0, -4.0
#: Labelled documents of each class that the field is fitted on.
SAMPLE_DOCS = 1200


def tokens(texts: pa.Array) -> tuple[np.ndarray, ...]:
    """Of all letter runs: start and end byte, document, features (32-bit hashes, one column a kind, 0: none), and whether a chain begins there."""
    data, off = buffers(texts)
    start, end, doc, h = words(data, off, not_letter(), lower_az())
    if not len(start):
        return start, end, doc, np.zeros((0, KINDS), "u4"), np.zeros(0, bool)
    stop = np.zeros(256, bool)
    stop[list(SENTENCE_ENDS)] = True
    seen = np.cumsum(stop[data])
    before = seen[start]
    fresh = np.r_[True, (doc[1:] != doc[:-1]) | (before[1:] != before[:-1])]
    begin = np.flatnonzero(fresh)
    rank = np.arange(len(start)) - np.repeat(begin, np.diff(np.r_[begin, len(start)]))
    feats = np.zeros((len(start), KINDS), "u4")
    feats[:, 0] = h >> np.uint64(32)
    low, size = lower_az(), end - start
    for j, k in enumerate(PREFIXES, 1):
        at = np.flatnonzero(size > k)
        v = np.full(len(at), k << 56, "u8")
        for i in range(k):
            v |= low[data[start[at] + i]].astype("u8") << np.uint64(8 * i)
        feats[at, j] = mix(v) >> np.uint64(32)
    return start, end, doc, feats, rank % CHAIN == 0


def grid(fresh: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Chains as rows, longest first: their first token, their length, and for each step how many chains still run."""
    begin = np.flatnonzero(fresh)
    size = np.diff(np.r_[begin, len(fresh)])
    order = np.argsort(-size, kind="stable")
    begin, size = begin[order], size[order]
    steps = size[0] if len(size) else 0
    running = np.searchsorted(-size, -np.arange(1, steps + 1), side="right")
    return begin, size, running


class Field:
    """Two tags, 0 (clean) and 1 (toxic): a weight for each feature of a token's being toxic, and scores of starts and moves, 0 for those to tag 0.

    A token's weight is the mean weight of its features times KINDS, so short words, which have no prefixes, weigh as
    much as long ones. Features that the fit has not seen count UNSEEN of one in that mean, so a new ending of a known stem keeps
    most of the stem's weight.
    """

    def __init__(self):
        self.index, self.weights = Sorted(np.zeros(0, "u8")), np.zeros(0)
        self.start = RARE
        self.move = np.array([[0.0, RARE], [0.0, FOLLOW]])
        self.curve = (1.0, 0.0)

    def weigh(self, feats: np.ndarray) -> np.ndarray:
        """Each token's weight, from those of its features that the fit has seen."""
        e, known = np.zeros(len(feats)), np.zeros(len(feats), "i8")
        if not self.index.n:
            return e
        for j in range(KINDS):
            at = self.index.find(feats[:, j].astype("u8") << np.uint64(32))
            e += np.where(at >= 0, self.weights[at], 0)
            known += (at >= 0) & (feats[:, j] != 0)
        return e * KINDS / np.maximum(known + UNSEEN * ((feats != 0).sum(1) - known), 1)

    def messages(self, e: np.ndarray, chains: tuple) -> tuple[np.ndarray, ...]:
        """Forward and backward odds of tag 1 of every token, emissions, and each chain's log-partition function.

        The path that tags all words clean has score 0, so the odds of no toxic word in a chain are exp(-logz).
        """
        begin, size, running = chains
        (m00, m01), (m10, m11) = np.exp(self.move)
        g = np.exp(np.clip(e, -30, 30))
        fw, bw, logz = np.empty(len(e)), np.ones(len(e)), np.zeros(len(begin))
        held = None
        for t, k in enumerate(running):
            at = begin[:k] + t
            if t:
                held = held[:k]
                d = m00 + held * m10
                logz[:k] += np.log(d)
                held = (m01 + held * m11) / d * g[at]
            else:
                held = np.exp(self.start) * g[at]
            fw[at] = held
        logz += np.log1p(fw[begin + size - 1])
        for t in range(len(running) - 2, -1, -1):
            at = begin[: running[t + 1]] + t
            on = g[at + 1] * bw[at + 1]
            bw[at] = (m10 + m11 * on) / (m00 + m01 * on)
        return fw, bw, g, logz

    def marginals(self, e: np.ndarray, fresh: np.ndarray) -> np.ndarray:
        """Probability of tag 1 for every token of weight e, by forward-backward over all chains at once."""
        fw, bw, _, _ = self.messages(e, grid(fresh))
        return fw * bw / (1 + fw * bw)

    def fit(self, feats: np.ndarray, fresh: np.ndarray, doc: np.ndarray, y: np.ndarray) -> None:
        """Adaptive gradient ascent on the likelihood of the documents' labels, with the tags summed out.

        A gradient is the counts that are expected given the labels less those expected without: a clean document has
        no toxic word; in a toxic one, tags have their marginals divided by the odds of a toxic word at all.
        """
        used, share = np.unique(feats), KINDS / np.maximum((feats != 0).sum(1), 1)
        back = [np.searchsorted(used, feats[:, j]).astype("i4") for j in range(KINDS)]  # a column at a time: the driver's memory is small
        w, chains = np.zeros(len(used)), grid(fresh)
        begin, inner = chains[0], np.flatnonzero(~fresh)
        seen, seen_moves = np.full(len(used), 1e-2), np.full(3, 1e-2)
        for _ in range(ROUNDS):
            fw, bw, g, logz = self.messages(sum(w[b] for b in back) * share, chains)
            p = fw * bw / (1 + fw * bw)
            some = -np.expm1(-np.bincount(doc[begin], logz, len(y)))  # odds of a toxic word in each document
            given = np.where(y == 1, TRUST / (TRUST * some + (1 - TRUST) * (1 - some)), 0.0) - 1
            pull = p * given[doc] * share
            grad = sum(np.bincount(b, pull, len(used)) for b in back) - DECAY * w
            m, on = np.exp(self.move), g[inner] * bw[inner]
            before = fw[inner - 1]
            total = m[0, 0] + m[0, 1] * on + before * (m[1, 0] + m[1, 1] * on)
            moves = np.array([(p[begin] * given[doc[begin]]).sum(), (m[0, 1] * on / total * given[doc[inner]]).sum(), (before * m[1, 1] * on / total * given[doc[inner]]).sum()])
            seen += grad * grad
            seen_moves += moves * moves
            w += RATE * grad / np.sqrt(seen)
            w[used == 0] = 0
            step = RATE * moves / np.sqrt(seen_moves)
            self.start = min(self.start + step[0], MOST_RARE)
            self.move[0, 1] = min(self.move[0, 1] + step[1], MOST_RARE)
            self.move[1, 1] = min(self.move[1, 1] + step[2], FOLLOW)
        del back
        self.index = Sorted(used.astype("u8") << np.uint64(32))
        self.weights = w[self.index.order]

    @staticmethod
    def totals(p: np.ndarray, word: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Of each of n documents: the evidence, -log of the odds that none of its different words is toxic, and their expected number of toxic ones.

        A word counts with its highest marginal there, however often it comes.
        """
        if not len(p):
            return np.zeros(n), np.zeros(n)
        key = doc.astype("u8") << np.uint64(32) | word
        order = np.argsort(key, kind="stable")
        at = np.flatnonzero(np.r_[True, key[order][1:] != key[order][:-1]])
        most = np.minimum(np.maximum.reduceat(p[order], at), 1 - 1e-12)
        return np.bincount(doc[order[at]], -np.log1p(-most), n), np.bincount(doc[order[at]], most, n)

    def tagged(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """Each text's evidence and expected number of different toxic words, and the byte spans of its toxic tokens."""
        start, end, doc, feats, fresh = tokens(texts)
        off = buffers(texts)[1]
        n = len(texts)
        spans = [np.zeros((0, 2), "i8")] * n
        if not len(start):
            return np.zeros(n), np.zeros(n), spans
        p = self.marginals(self.weigh(feats), fresh)
        bad = np.flatnonzero(p >= 0.5)
        for d in np.unique(doc[bad]):
            own = bad[doc[bad] == d]
            spans[d] = np.stack([start[own], end[own]], 1) - off[d]
        return *self.totals(p, feats[:, 0], doc, n), spans

    def score(self, evidence: np.ndarray) -> np.ndarray:
        a, b = self.curve
        return 1 / (1 + np.exp(-np.clip(a * np.log(evidence + 1e-2) + b, -40, 40)))


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for part in slices(b, 0):
            _, _, doc, feats, fresh = tokens(part.column(0))
            cut = np.cumsum(np.bincount(doc, minlength=len(part)) if len(doc) else np.zeros(len(part), "i8"))[:-1]
            parts = [pa.array([np.ascontiguousarray(x).tobytes() for x in np.split(z, cut)], pa.binary()) for z in (feats, fresh)]
            yield pa.RecordBatch.from_arrays([*parts, part.column(1).cast(pa.int32())], names=["f", "c", "y"])


def train(docs: DataFrame, labels: DataFrame, learn: Column, label: str = "toxic", most: int = SAMPLE_DOCS) -> Field:
    """Fit on about `most` labelled documents of each class among those that `learn` (on doc_id) lets in.

    The sample is bounded in documents and bytes (see labelled.sample); all words of its documents take part. Null
    labels, ids and texts are left out. A fifth of the sample sets the score's curve, weighted as the classes are among
    all labels. With one class or none to learn from, all documents get the same score.
    """
    some, sizes = labelled.sample(docs, labels, label, learn, most)
    got = some.select("text", F.col("y").cast("int").alias("y")).mapInArrow(_tokens, "f binary, c binary, y int").collect()
    got = sorted((bytes(r["f"]), bytes(r["c"]), r["y"]) for r in got)
    order = np.random.default_rng(0).permutation(len(got))
    feats = [np.frombuffer(got[i][0], "u4").reshape(-1, KINDS) for i in order]
    fresh = [np.frombuffer(got[i][1], bool) for i in order]
    y = np.array([got[i][2] for i in order], "i8")
    del got
    field = Field()
    own = np.arange(len(y)) % 5 > 0
    if len(set(y[own])) < 2 or len(set(y[~own])) < 2:
        field.curve = (0.0, -4.0 if not len(y) or y.mean() < 0.5 else 4.0)
        return field
    fit, rest = np.flatnonzero(own), np.flatnonzero(~own)
    joined = lambda at: (np.concatenate([feats[i] for i in at]), np.concatenate([fresh[i] for i in at]), np.repeat(np.arange(len(at)), [len(feats[i]) for i in at]))
    held = joined(rest)
    whole = joined(fit)
    del feats, fresh
    trim()
    field.fit(*whole, y[fit])
    del whole
    f, c, doc = held
    evidence, _ = field.totals(field.marginals(field.weigh(f), c), f[:, 0], doc, len(rest))
    weight = np.array([sizes.get(k, 1) for k in (0, 1)], float) / np.bincount(y[rest], minlength=2)
    field.curve = labelled.platt(np.log(evidence + 1e-2), y[rest], weight[y[rest]] * len(rest) / weight[y[rest]].sum())
    del held, f, c, doc
    trim()
    return field


ADDED = ("toxicity", "toxic_words", "spans")


def tag(docs: DataFrame, model: Field, text: str = "text") -> DataFrame:
    """docs and toxicity (0 to 1, higher: label 1 likelier), toxic_words (expected number of different ones) and spans (character offsets of tokens whose marginal is at least 1/2).

    Every word of every text is in exactly one chain. Null, empty and wordless texts have no spans and the score of
    a text without toxic words. A word that comes again adds nothing to the sum. Rows come back one for one, whatever they repeat; columns of the three names are replaced.
    """
    rest = [c for c in docs.columns if c not in ADDED]
    rows, fields = aside(docs, text, rest)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    span = StructType([StructField("start", IntegerType()), StructField("end", IntegerType())])
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("toxicity")
        m = sent.value
        for b in batches:
            for part in slices(b, 0):
                evidence, count, spans = m.tagged(part.column(0))
                out = []
                for i, s in enumerate(spans):
                    if len(s):
                        raw = np.frombuffer(part.column(0)[i].as_buffer(), "u1")
                        head = np.cumsum(np.r_[0, (raw & 0xC0) != 0x80])
                        out.append([{"start": int(head[a]), "end": int(head[z])} for a, z in s])
                    else:
                        out.append([])
                yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(m.score(evidence), pa.float64()), pa.array(count, pa.float64()), pa.array(out, kind)], names=[*rest, *ADDED])

    return rows.mapInArrow(run, StructType([*fields, StructField("toxicity", DoubleType()), StructField("toxic_words", DoubleType()), StructField("spans", ArrayType(span))]))
