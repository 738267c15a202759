import random
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from loopscope.llm import labelled, quality, toxicity
from loopscope.llm.shared import fold

CLEAN = "the river runs past a small town where people walk and talk about weather music food and long journeys home".split()
BAD = ["idiot", "scum"]


def corpus(n=400, seed=0):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        words = rng.choices(CLEAN, k=rng.randint(20, 60))
        toxic, good = i % 4 == 0, i % 3 > 0
        if toxic:
            for _ in range(2):
                words.insert(rng.randrange(7), rng.choice([*BAD, "vequ" + rng.choice(["ta", "no", "le", "ri"])]))
        text = " ".join(words) if good else " ".join(w.upper() + "!!" for w in words[:8]) * 3
        rows.append((i, text, "en", "s"))
        labels.append((i, int(good), int(toxic)))
    return rows, labels


def frame(spark, labels):
    return spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_quality_holds_out(spark, docs):
    rows, labels = corpus()
    odd = [(900, None, "en", "s"), (901, "", "en", "s"), (902, "!!", "en", "s"), (903, "word " * 50000, "en", "s"), (None, "the town", "en", "s"), (1, rows[1][1], "en", "s")]
    model = quality.train(docs(rows), frame(spark, [*labels, (2, None, None), (3, 7, 7), (None, 1, 1), labels[5]]), fold("doc_id", 4) != 2)
    got = quality.scored(docs(rows + odd), model).collect()
    assert len(got) == len(rows) + len(odd) and all(0 <= r["score"] <= 1 for r in got)
    truth = {i: q for i, q, _ in labels}
    out = [(r["score"], truth[r["doc_id"]]) for r in got if r["doc_id"] in truth and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]
    assert np.mean([(s >= 0.7) == y for s, y in out]) > 0.95


def test_quality_without_two_classes(spark, docs):
    rows, labels = corpus(30)
    for some in ([], [(i, 1, 0) for i, _, _ in labels]):
        model = quality.train(docs(rows), frame(spark, some), F.lit(True))
        assert len({round(r["score"], 9) for r in quality.scored(docs(rows), model).collect()}) == 1
    assert quality.scored(docs([]), model).collect() == []


def test_descent_separates():
    rows = [np.array([i % 5, 5 + i % 3]) for i in range(60)]
    y = np.array([1 if i % 5 < 2 else -1 for i in range(60)])
    w = quality.descend(rows, [np.ones(2)] * 60, y, np.ones(60))
    assert all(np.sign(w[r].sum() + w[-1]) == t for r, t in zip(rows, y))


def test_forward_backward_against_all_paths():
    rng = np.random.default_rng(0)
    f = toxicity.Field()
    e = rng.standard_normal(7)
    fresh = np.array([1, 0, 0, 0, 1, 0, 1], bool)
    got = f.marginals(e, fresh)
    for a, b in ((0, 4), (4, 6), (6, 7)):
        total, on = 0.0, np.zeros(b - a)
        for path in range(1 << (b - a)):
            t = [(path >> k) & 1 for k in range(b - a)]
            s = f.start * t[0] + sum(f.move[p, q] for p, q in zip(t, t[1:])) + sum(x for x, k in zip(e[a:b], t) if k)
            total += np.exp(s)
            on += np.exp(s) * np.array(t)
        assert np.allclose(got[a:b], on / total)


def test_gradient_of_the_documents_labels():
    """The fit climbs the likelihood of labels: a word of all toxic documents and of no clean one ends up toxic, others clean."""
    rng = random.Random(4)
    y = np.arange(200) % 2
    texts = [" ".join([*rng.choices(CLEAN, k=9), *(["bad"] if t else []), *rng.choices(CLEAN, k=9)]) for t in y]
    _, _, doc, feats, fresh = toxicity.tokens(pa.array(texts))
    f = toxicity.Field()
    f.fit(feats, fresh, doc, y)
    p = f.marginals(f.weigh(feats), fresh)
    words = " ".join(texts).split()
    assert all((x > 0.5) == (w == "bad") for w, x in zip(words, p))


def test_scores_against_all_taggings():
    """Sums of marginals over different words, against every tagging of every chain."""
    rng = np.random.default_rng(2)
    f = toxicity.Field()
    texts = ["Bad day. Bad bad dog!", "", "so it goes", None]
    arr = pa.array(texts).fill_null("")
    start, end, doc, feats, fresh = toxicity.tokens(arr)
    used = np.unique(feats)
    f.index = toxicity.Sorted(used.astype("u8") << np.uint64(32))
    f.weights = rng.standard_normal(len(used))[f.index.order] * 3
    f.start, f.move = -0.5, np.array([[0.0, -0.7], [0.0, 0.4]])
    e, want, none, best = f.weigh(feats), np.zeros(4), np.ones(4), {}
    at = np.r_[np.flatnonzero(fresh), len(fresh)]
    raw = "".join(t or "" for t in texts).lower().encode()
    for a, b in zip(at[:-1], at[1:]):
        total, on = 0.0, np.zeros(b - a)
        for path in range(1 << (b - a)):
            t = [(path >> k) & 1 for k in range(b - a)]
            s = np.exp(f.start * t[0] + sum(f.move[p, q] for p, q in zip(t, t[1:])) + sum(x for x, k in zip(e[a:b], t) if k))
            total, on = total + s, on + s * np.array(t)
        for i, x in zip(range(a, b), on / total):
            key = (doc[i], raw[start[i] : end[i]])
            best[key] = max(best.get(key, 0), x)
    for (d, _), x in best.items():
        want[d] += x
        none[d] *= 1 - x
    evidence, count, _ = f.tagged(arr)
    assert np.allclose(count, want) and np.allclose(np.exp(-evidence), none)


def test_long_tailed_words_and_set_phrases(spark, docs):
    """Toxic words that are each in few toxic documents, and one that always stands after the same word."""
    rng = random.Random(5)
    tail = ["".join(rng.choices("bdfgklmnprstvz", k=1) + rng.choices("aeiou", k=1) + rng.choices("bdfgklmnprstvz", k=3)) for _ in range(60)]
    rows, labels = [], []
    for i in range(1200):
        words = rng.choices(CLEAN, k=30)
        if i % 2:
            bad = ["utter", "swine"] if i % 6 == 1 else [rng.choice(tail)]
            words[9:9] = bad * 2
        elif i % 7 == 0:
            words[3:3] = ["utter"]
        rows.append((i, " ".join(words), "en", "s"))
        labels.append((i, 1, i % 2))
    model = toxicity.train(docs(rows), frame(spark, labels), fold("doc_id", 3) != 1)
    got = {r["doc_id"]: r["toxicity"] >= 0.7 for r in toxicity.tag(docs(rows), model).collect()}
    out = [i for i in got if zlib.crc32(str(i).encode()) % 3 == 1]
    assert np.mean([got[i] for i in out if i % 2]) > 0.97 and np.mean([got[i] for i in out if i % 2 == 0]) < 0.03


def test_clashing_names_and_the_bounded_sample(spark, docs, monkeypatch):
    rows, labels = corpus(200)
    df = docs(rows).withColumns({"_text": F.lit(1), "Text_": F.lit(2), "spans": F.lit("x"), "a.b": F.lit(3)})
    model = toxicity.train(df, frame(spark, labels), F.lit(True))
    got = toxicity.tag(df, model)
    assert got.columns == [c for c in df.columns if c != "spans"] + ["toxicity", "toxic_words", "spans"] and got.count() == 200
    assert quality.scored(df, quality.train(df, frame(spark, labels), F.lit(True))).count() == 200
    monkeypatch.setattr(labelled, "SAMPLE_BYTES", 4000)
    some, sizes = labelled.sample(df.unionAll(df), frame(spark, labels), "toxic", F.lit(True), 3000)
    taken = some.groupBy("y").agg(F.sum(F.length("text")).alias("n"), F.count(F.lit(1)).alias("c")).collect()
    assert sizes == {0: 150, 1: 50} and all(0 < r["n"] <= 4000 and r["c"] < 50 for r in taken)


def test_tokens_cover_the_text_in_bounded_chains():
    t = ["Ab'c d.E!", "x " * 300, "", "été"]
    start, end, doc, feats, fresh = toxicity.tokens(pa.array(t))
    raw = "".join(t).encode()
    assert [raw[a:b].decode() for a, b in zip(start[:4], end[:4])] == ["Ab", "c", "d", "E"]
    assert np.bincount(doc).tolist() == [4, 300, 0, 1] and fresh[:4].tolist() == [True, False, False, True]
    size = np.diff(np.r_[np.flatnonzero(fresh), len(fresh)])
    assert size.max() <= toxicity.CHAIN and fresh[304]


def test_toxicity_spans_and_unseen_suffixes(spark, docs):
    rows, labels = corpus(600, 3)
    model = toxicity.train(docs(rows), frame(spark, labels), fold("doc_id", 3) != 1)
    odd = [(900, None, "en", "s"), (901, "", "en", "s"), (902, "Été: you Vequzzz, you idiot", "en", "s"), (903, "the town " * 20000, "en", "s"), (None, "scum", "en", "s"), (904, "the river town", "en", "s")]
    got = {r["doc_id"]: r for r in toxicity.tag(docs(rows + odd), model).collect()}
    truth = {i: t for i, _, t in labels}
    out = [i for i in truth if zlib.crc32(str(i).encode()) % 3 == 1]
    assert np.mean([(got[i]["toxicity"] >= 0.7) == truth[i] for i in out]) > 0.97
    text = odd[2][1]
    assert [text[s["start"] : s["end"]] for s in got[902]["spans"]] == ["Vequzzz", "idiot"]
    assert got[None]["toxicity"] >= 0.7 and all(got[i]["toxicity"] < 0.3 and not got[i]["spans"] for i in (900, 901, 903, 904))


def test_toxicity_without_labels(spark, docs):
    rows, _ = corpus(20)
    model = toxicity.train(docs(rows), frame(spark, []), F.lit(True))
    assert all(r["toxicity"] < 0.1 for r in toxicity.tag(docs(rows), model).collect())
    assert toxicity.tag(docs([]), model).collect() == []


def test_platt_recovers_a_curve():
    rng = np.random.default_rng(1)
    m = rng.standard_normal(4000)
    y = (rng.random(4000) < 1 / (1 + np.exp(-(2 * m - 1)))).astype(int)
    a, b = labelled.platt(m, y, np.ones(4000))
    assert abs(a - 2) < 0.25 and abs(b + 1) < 0.25


def test_dual_descent_closes_the_gap_and_ratios_are_log_counts():
    rng = np.random.default_rng(3)
    rows = [np.unique(rng.integers(0, 40, 6)) + (20 if i % 2 else 0) for i in range(200)]
    y = np.arange(200) % 2
    model = quality.Classifier(rows, y, {0: 100, 1: 100})
    own = np.arange(200) % 5 > 0
    p, q = np.ones(quality.DIM), np.ones(quality.DIM)
    for r, c in zip(np.array(rows, object)[own], y[own]):
        (p if c else q)[r] += 1
    want = np.log((p / p.sum()) / (q / q.sum()))
    want[p + q - 2 < quality.LEAST_TEXTS] = 0
    assert np.allclose(model.scale, want)
    value = [want[r] / np.sqrt(len(r)) for r in rows]
    sign, cost = 2.0 * y - 1, np.full(200, 0.3)
    w = quality.descend(rows, value, sign, cost, rounds=2000)
    margin = np.array([w[r] @ v + w[-1] for r, v in zip(rows, value)])
    primal = 0.5 * (w @ w) + (cost * np.maximum(0, 1 - sign * margin)).sum()

    def plain(rounds=60_000):  # subgradient descent on the same objective, its best value
        x = np.zeros((200, 62))
        for i, (r, v) in enumerate(zip(rows, value)):
            x[i, r] = v
        x[:, -1] = 1
        u, best = np.zeros(62), np.inf
        for t in range(rounds):
            m = sign * (x @ u)
            best = min(best, 0.5 * u @ u + (cost * np.maximum(0, 1 - m)).sum())
            u = u - (u - x.T @ (cost * sign * (m < 1))) / (t + 10)
        return best

    assert primal <= plain() * 1.001
