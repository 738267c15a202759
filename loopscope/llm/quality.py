"""Quality classifier: a linear hinge-loss model over n-gram indicators scaled by class log-count ratios."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from . import labelled
from .bytescan import buffers, claim, is_space, lower_az, mix, slices, words
from .shared import aside

#: Hashed n-grams; the last entries hold the share of repeated word n-grams in steps.
BITS = 18
STEPS = 16
DIM = (1 << BITS) + 3 * STEPS
#: Labelled texts of the sample that must hold a feature for it to weigh anything.
LEAST_TEXTS = 3


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Indicators of all texts one after the other and how many each has: byte 3-grams, and steps of how much single words, word pairs and 5-word runs repeat."""
    data, off = buffers(texts)
    n = len(texts)
    k = len(data) - 2
    parts = []
    if k > 0:
        d = data.astype("u4")
        g = (d[:k] << 16) | (d[1 : k + 1] << 8) | d[2:]
        h = (g * np.uint32(2654435761)) >> np.uint32(32 - BITS)
        doc = np.repeat(np.arange(n, dtype="u8"), np.diff(off))
        inside = doc[:k] == doc[2:]
        parts.append(np.unique((doc[:k][inside] << np.uint64(32)) | h[inside].astype("u8")))
    _, _, doc, h = words(data, off, is_space(), lower_az())
    for j, width in enumerate((1, 2, 5)):
        m = len(h) - width + 1
        share = np.zeros(n)
        if m > 0:
            g = h[:m].copy()
            for i in range(1, width):
                g = mix(g) + h[i : i + m]
            same = doc[:m] == doc[width - 1 :]
            key = mix(g[same] ^ mix(doc[:m][same].astype("u8") + np.uint64(1)))
            total = np.bincount(doc[:m][same], minlength=n)
            _, at = np.unique(key, return_index=True)
            kinds = np.bincount(doc[:m][same][at], minlength=n)
            share = 1 - kinds / np.maximum(total, 1)
            share[total == 0] = 0
        step = np.minimum((share * STEPS).astype("u8"), STEPS - 1) + np.uint64((1 << BITS) + j * STEPS)
        parts.append((np.arange(n, dtype="u8") << np.uint64(32)) | step)
    both = np.sort(np.concatenate(parts))
    return (both & np.uint64(0xFFFFFFFF)).astype("i8"), np.bincount((both >> np.uint64(32)).astype("i8"), minlength=n)


def descend(rows: list[np.ndarray], value: list[np.ndarray], y: np.ndarray, cost: np.ndarray, rounds: int = 25, seed: int = 1) -> np.ndarray:
    """Dual coordinate descent for the L2-regularised hinge loss; the last weight is the bias."""
    w = np.zeros(DIM + 1)
    alpha = np.zeros(len(rows))
    norm = np.array([(v**2).sum() + 1 for v in value])
    rng = np.random.default_rng(seed)
    for _ in range(rounds):
        worst = 0.0
        for i in rng.permutation(len(rows)):
            g = y[i] * (w[rows[i]] @ value[i] + w[-1]) - 1
            new = min(max(alpha[i] - g / norm[i], 0.0), cost[i])
            if step := (new - alpha[i]) * y[i]:
                w[rows[i]] += step * value[i]
                w[-1] += step
                worst = max(worst, abs(new - alpha[i]))
                alpha[i] = new
        if worst < 1e-3:
            break
    return w


class Classifier:
    def __init__(self, rows: list[np.ndarray], y: np.ndarray, prior: dict[int, int], cost: float = 0.2):
        own = np.arange(len(rows)) % 5 > 0  # a fifth sets the score's curve
        if len(set(y[own])) < 2 or len(set(y[~own])) < 2:
            self.scale, self.w, self.curve = np.zeros(DIM), np.zeros(DIM + 1), (1.0, 40.0 * (np.mean(y) - 0.5) if len(y) else 0.0)
            return
        ind = [np.zeros(DIM), np.zeros(DIM)]
        for r, c in zip(np.array(rows, object)[own], y[own]):
            ind[c][r] += 1
        p, q = ind[1] + 1, ind[0] + 1
        self.scale = np.log((p / p.sum()) / (q / q.sum()))
        self.scale[(ind[0] + ind[1]) < LEAST_TEXTS] = 0
        value = [self.scale[r] / np.sqrt(len(r)) for r in rows]
        at = np.flatnonzero(own)
        share = np.bincount(y[own], minlength=2) / own.sum()
        self.w = descend([rows[i] for i in at], [value[i] for i in at], 2.0 * y[at] - 1, cost * 0.5 / share[y[at]])
        rest = np.flatnonzero(~own)
        margin = np.array([self.w[rows[i]] @ value[i] + self.w[-1] for i in rest])
        weight = np.array([prior.get(c, 1) for c in (0, 1)], float) / np.bincount(y[rest], minlength=2)
        self.curve = labelled.platt(margin, y[rest], weight[y[rest]] * len(rest) / weight[y[rest]].sum())

    def score(self, texts: pa.Array) -> np.ndarray:
        f, n = features(texts)
        at = np.cumsum(n) - n
        m = np.add.reduceat((self.w[:-1] * self.scale)[f], at) / np.sqrt(n) + self.w[-1] if len(n) else np.zeros(0)
        a, b = self.curve
        return 1 / (1 + np.exp(-np.clip(a * m + b, -40, 40)))


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for part in slices(b, 0):
            f, n = features(part.column(0))
            yield pa.RecordBatch.from_arrays([pa.array([x.astype("u4").tobytes() for x in np.split(f, np.cumsum(n)[:-1])], pa.binary()), part.column(1).cast(pa.int32())], names=["f", "y"])


def train(docs: DataFrame, labels: DataFrame, learn: Column, label: str = "quality", most: int = labelled.SAMPLE_DOCS) -> Classifier:
    """Fit on about `most` labelled documents of each class among those that `learn` (on doc_id) lets in; the priors are all such labels'.

    Features that fewer than LEAST_TEXTS of them hold weigh nothing. Null labels, ids and texts are left out, repeated ids count once
    (`labelled.sample`); with one class or none every score is the same. Other columns of either table are ignored.
    """
    some, sizes = labelled.sample(docs, labels, label, learn, most)
    got = some.select("text", F.col("y").cast("int").alias("y")).mapInArrow(_features, "f binary, y int").collect()
    got = sorted((bytes(r["f"]), r["y"]) for r in got)
    order = np.random.default_rng(0).permutation(len(got))
    return Classifier([np.frombuffer(got[i][0], "u4").astype("i8") for i in order], np.array([got[i][1] for i in order], "i8"), sizes)


def scored(docs: DataFrame, model, name: str = "score", text: str = "text") -> DataFrame:
    """docs and the model's score (0 to 1, higher: label 1 likelier) of every whole text.

    Null, empty and wordless texts get the score of a text without n-grams. Rows come back one for one, whatever they
    repeat; a column of that name is replaced. With one class or none to learn from, scores are the same for all.
    """
    rest = [c for c in docs.columns if c != name]
    rows, fields = aside(docs, text, rest)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("quality")
        m = sent.value
        for b in batches:
            for part in slices(b, 0):
                yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(m.score(part.column(0)), pa.float64())], names=[*rest, name])

    return rows.mapInArrow(run, StructType([*fields, StructField(name, DoubleType())]))
