"""Loops, longest common subsequences, sentence similarity and cluster-robust errors against plain Python."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from loopscope.functions import vectors
from loopscope.functions import text as T
from loopscope.operators import inference, loop, metrics

WORDS = "river stone Berlin Madrid winter garden music letter window Oslo bridge night".split()


def sentence(t):
    return next((x for x in (s.strip() for s in re.split(r"(?<=[.!?])\s+", t)) if x), "")


def drawn(r, q, runs):
    return min(runs, key=lambda i: hashlib.md5(f"17|{r}|{q}|{i}".encode()).hexdigest())


def tokens(t):
    return set(re.findall("[a-z0-9]+", t.lower()))


def stops(signatures):
    return len(signatures) >= 4 and len({tuple(s) for s in signatures[-4:]}) == 1


def plain_search(store, questions, rounds, k, penalty, names):
    out = []
    for q, text in questions.items():
        docs, sigs = [(d, ai, t) for x, d, ai, t in store if x == q], []
        calls = [text, *list(dict.fromkeys(re.findall("[A-Z][a-z]{3,}", text)))[:names]]
        for r in range(1, rounds + 1):
            best = {}
            for c in calls:
                own = tokens(c)
                scored = sorted(((round(len(own & tokens(t)) / len(own) * (1 - penalty * ai), 9), -d, ai, t) for d, ai, t in docs), key=lambda x: (-x[0], -x[1]))[:k]
                for s, d, ai, t in scored:
                    if -d not in best or s > best[-d][0]:
                        best[-d] = (s, ai, t)
            ctx = sorted(best.items(), key=lambda x: (-x[1][0], x[0]))
            answers = [sentence(ctx[i % len(ctx)][1][2]) for i in range(3)]
            out.append((q, r, round(np.mean([x[1][1] for x in ctx]), 6), len(set(answers)), round(np.mean([x[1][0] for x in ctx]), 6), len(calls)))
            docs.append((-r, 1, answers[drawn(r, q, range(3))]))
            sigs.append(sorted(map(len, answers)))
            if stops(sigs):
                break
    return sorted(out)


@pytest.fixture(scope="module")
def data(spark):
    rng = random.Random(3)
    text = lambda: ". ".join(" ".join(rng.choices(WORDS, k=rng.randint(2, 7))) for _ in range(3)) + "."
    store = [(q, q * 100 + i, int(i % 3 == 0), text()) for q in range(4) for i in range(9)]
    questions = {q: f"Which river in Berlin or Madrid has a {WORDS[q]} and night {q}?" for q in range(4)}
    s = spark.createDataFrame([(q, d, bool(ai), t) for q, d, ai, t in store], "question_id long, doc long, is_ai boolean, text string")
    return store, questions, s, spark.createDataFrame(list(questions.items()), "question_id long, question_text string")


@pytest.mark.parametrize(("penalty", "names"), [(0.0, 0), (0.7, 0), (0.0, 2)])
def test_search_loops(data, penalty, names):
    store, questions, s, q = data
    got = loop.search_rounds(s, q, 6, k=4, penalty=penalty, names=names).collect()
    want = plain_search(store, questions, 6, 4, penalty, names)
    assert len(got) == len(want) and all(tuple(a) == pytest.approx(b, abs=2e-6) for a, b in zip(sorted(map(tuple, got)), want))


@pytest.mark.parametrize(("variant", "num_db"), [("replace_all", 0), ("replace_all", 2), ("replace_one", 0)])
def test_replace_loops(data, variant, num_db):
    store, questions, s, q = data
    context = s.select("question_id", (F.col("doc") % 100).alias("slot"), "is_ai", "text")
    got = sorted(map(tuple, loop.replace_rounds(context, q, 8, variant, num_db=num_db).collect()))
    want = []
    for x in questions:
        docs, sigs = [(ai, t) for y, _, ai, t in store if y == x], []
        refs = docs[:num_db]
        for r in range(8):
            answers = [sentence(docs[i % len(docs)][1]) for i in range(3)]
            want.append((x, r, round(sum(a for a, _ in docs) / len(docs), 6), len(set(answers)), hashlib.md5("\n".join(t for _, t in docs).encode()).hexdigest()))
            if variant == "replace_all":
                docs = [(1, a) for a in answers] + refs
            else:
                docs = [(1, answers[drawn(r, x, range(3))]) if i == r % len(docs) else d for i, d in enumerate(docs)]
            sigs.append(sorted(map(len, answers)))
            if stops(sigs):
                break
    assert got == sorted(want)


def test_longest_common_subsequence():
    rng = random.Random(0)
    for _ in range(60):
        x, y = (rng.choices("abcd", k=rng.randint(0, 12)) for _ in range(2))
        table = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
        for i, a in enumerate(x):
            for j, b in enumerate(y):
                table[i + 1][j + 1] = table[i][j] + 1 if a == b else max(table[i][j + 1], table[i + 1][j])
        assert metrics.lcs_size(x, y) == table[-1][-1]


def test_hashed_embeddings_are_unit_vectors_of_signed_counts(spark):
    df = spark.createDataFrame([("one two two three",), ("",)], "s string").select(T.words(F.col("s")).alias("w"))
    e = [r[0] for r in df.select(vectors.hashed_embedding(F.col("w"), 8)).collect()]
    assert np.linalg.norm(e[0]) == pytest.approx(1) and not any(e[1])
    same = df.select(vectors.hashed_embedding(F.reverse("w"), 8)).first()[0]
    assert same == pytest.approx(e[0])


def test_cluster_robust_errors_against_numpy(spark):
    sf = "/root/testdata/sf0.01"
    x = inference.design(spark, sf).toPandas()
    a, y = x[inference.COLS].to_numpy(float), x["y"].to_numpy(float)
    inv = np.linalg.inv(a.T @ a)
    beta = inv @ (a.T @ y)
    e, meat = y - a @ beta, np.zeros((3, 3))
    for g in x["cluster"].unique():
        s = a[x["cluster"] == g].T @ e[x["cluster"] == g]
        meat += np.outer(s, s)
    got = inference.cluster_robust_ols(spark, sf).toPandas()
    assert np.allclose(got["coefficient"], beta, atol=1e-6) and np.allclose(got["cr0_error"], np.sqrt(np.diag(inv @ meat @ inv)), atol=1e-6)


def test_temporal_similarity_equals_plain(spark):
    sf = "/root/testdata/sf0.001"
    from loopscope.plans import views as V

    cells, seen = {}, {}
    for r in V.runs(spark, sf).collect():
        cells.setdefault((r["question_id"], r["iteration_number"]), []).append([s.strip() for s in re.split(r"(?<=[.!?])\s+", r["answer"]) if s.strip()])
    texts = sorted({s for runs in cells.values() for x in runs for s in x})
    df = spark.createDataFrame([(s,) for s in texts], "s string")
    for r in df.select("s", vectors.hashed_embedding(T.words(F.col("s")), 32).alias("e")).collect():
        seen[r["s"]] = np.array(r["e"])
    want = {}
    for cell, runs in cells.items():
        k = min(map(len, runs))
        scores = [np.mean([seen[a] @ seen[b] for a, b in zip(x[:k], y[:k])]) if k else 0.0 for i, x in enumerate(runs) for y in runs[i + 1 :]]
        want[cell] = (np.mean(scores), np.max(scores), np.min(scores), np.std(scores)) if scores else (0, 0, 0, 0)
    got = {(r["question_id"], r["iteration_number"]): (r["tes_mean"], r["tes_max"], r["tes_min"], r["tes_std"]) for r in metrics.temporal_sentence_similarity(spark, sf).collect()}
    assert set(got) == set(want) and all(got[c] == pytest.approx(want[c], abs=2e-6) for c in want)
