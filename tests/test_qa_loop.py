"""Loops of question answering, the side writer and incremental retrieval against plain Python."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from loopscope.operators import loop, qa_loop

WORDS = "river stone Berlin Madrid winter garden music letter window Oslo bridge night".split()


def sentence(t, at=0):
    found = [s.strip() for s in re.split(r"(?<=[.!?])\s+", t or "") if s.strip()]
    return found[at] if found else ""


def drawn(seed, r, q, runs):
    return min(range(runs), key=lambda i: hashlib.md5(f"{seed}|{r}|{q}|{i}".encode()).hexdigest())


def repetition(t):
    w = [x.lower() for x in re.findall("[A-Za-z0-9']+", t or "")]
    return 1 - len(set(w)) / len(w) if w else 0.0


@pytest.fixture(scope="module")
def data(spark):
    rng = random.Random(8)
    say = lambda: ". ".join(" ".join(rng.choices(WORDS, k=rng.randint(2, 6))) for _ in range(3)) + "."
    corpus = [(q, f"corpus_{q * 100 + i}", say() if i else None, round(0.9 - 0.05 * rng.randint(0, 9), 9)) for q in range(3) for i in range(9)]
    vec = {q: [float(x) for x in np.random.default_rng(q).normal(size=64)] for q in range(3)}
    c = spark.createDataFrame(corpus, "question_id long, doc string, text string, score double")
    return corpus, vec, c, spark.createDataFrame([(q, f"what {q}?", v) for q, v in vec.items()], "question_id long, question_text string, q array<double>")


@pytest.fixture(scope="module")
def embedded(spark):
    held = {}

    def get(t):
        if t not in held:
            held[t] = np.array(spark.createDataFrame([(t,)], "t string").select(qa_loop.embed(F.col("t"))).first()[0])
        return held[t]

    return get


def plain(corpus, vec, embedded, rounds, variant, penalty=None, k=4, runs=3, num_synth=2, num_db=1):
    out = []
    for q in vec:
        cand = sorted([(d, False, t, s) for x, d, t, s in corpus if x == q], key=lambda c: (-c[3], c[0]))

        def best(cand):
            lo, hi = min(c[3] for c in cand), max(c[3] for c in cand)
            norm = lambda s: 1.0 if hi - lo <= 1e-9 else (s - lo) / (hi - lo)
            value = [c[3] if penalty is None else round(norm(c[3]) * (1 - penalty * repetition(c[2])), 9) for c in cand]
            return [cand[i][:3] for i in sorted(range(len(cand)), key=lambda i: (-value[i], i))[:k]]

        docs = best(cand)
        first = docs[:num_db]
        for r in range(rounds):
            answers = [sentence(docs[i % len(docs)][2]) for i in range(runs)]
            out.append((q, r, len(docs), round(sum(d[1] for d in docs) / len(docs), 6), len(set(answers)), hashlib.md5(" ".join(d[0] for d in docs).encode()).hexdigest()))
            one = answers[drawn(41, r, q, runs)]
            if variant == "search":
                cand.append((f"gen_{r + 1}_0", True, one, round(float(np.dot(vec[q], embedded(one))), 9)))
                docs = best(cand)
            elif variant == "hybrid":
                docs = [(f"gen_{r + 1}_{i}", True, a) for i, a in enumerate(answers[:num_synth])] + first
            else:
                docs = [(f"gen_{r + 1}_0", True, one) if i == (r + 1) % len(docs) else d for i, d in enumerate(docs)]
    return sorted(out)


@pytest.mark.parametrize(("variant", "penalty"), [("search", None), ("search", 0.7), ("hybrid", None), ("replace_one", None)])
def test_qa_loops_equal_plain(data, embedded, variant, penalty):
    corpus, vec, c, q = data
    got = sorted(map(tuple, qa_loop.qa_rounds(c, q, 5, variant, k=4, penalty=penalty, runs=3, num_synth=2, num_db=1).collect()))
    assert got == plain(corpus, vec, embedded, 5, variant, penalty)


def test_generated_documents_come_into_contexts(data):
    _, _, c, q = data
    got = qa_loop.qa_rounds(c.withColumn("score", F.lit(-5.0)), q, 3, k=4, runs=2).collect()
    assert max(r["ai_share"] for r in got) == 0.5 and {r["ai_share"] for r in got if r["round"] == 0} == {0.0}


@pytest.mark.parametrize(("variant", "penalty"), [("search", None), ("search", 0.7), ("hybrid", None), ("replace_one", None)])
def test_a_round_is_written_once(data, monkeypatch, variant, penalty):
    _, _, c, q = data
    written, real = [], qa_loop.stored
    monkeypatch.setattr(qa_loop, "stored", lambda df: (written.append(df.columns), real(df))[1])
    assert qa_loop.qa_rounds(c, q, 3, variant, k=4, penalty=penalty, runs=2, num_synth=2, num_db=1).count() == 9
    assert len(written) == 4 and written[-1] == ["question_id", "past"]


def test_candidates_keep_their_order(spark):
    rows = [(1, "a", 0.5), (2, "b", None), (3, "c", float("nan")), (4, "d", 0.5), (5, "a", 0.9), (6, None, 0.1), (7, None, 0.2)]
    items = spark.createDataFrame(rows, "seq long, doc string, score double").select(F.collect_list(F.struct("seq", "doc", F.lit(False).alias("is_ai"), F.lit("").alias("text"), "score", F.lit(0.0).alias("ai"))).alias("items"))
    order = lambda k: [x["seq"] for x in items.select(qa_loop.ranked(F.col("items"), k, None).alias("x")).first()["x"]]
    assert order(9) == [3, 5, 4, 7, 2] and order(2) == [3, 5]


def test_registered_rounds(monkeypatch):
    seen = []
    monkeypatch.setattr(qa_loop, "_searched", lambda *_: (None, None))
    monkeypatch.setattr(qa_loop, "qa_rounds", lambda c, q, rounds, variant="search", **more: seen.append((rounds, variant, more.get("penalty"))))
    for f in (qa_loop.qa_search_loop, qa_loop.qa_rerank_loop, qa_loop.qa_hybrid_loop, qa_loop.qa_replace_one_loop):
        f(None, "")
    assert seen == [(30, "search", None), (30, "search", 0.5), (10, "hybrid", None), (20, "replace_one", None)]


def test_a_side_generator_writes_and_the_main_one_is_measured(spark, data):
    corpus, _, c, q = data
    refs = loop.paraphrased(c.join(q, "question_id"), loop.on_the_question).select("question_id", F.regexp_extract("doc", r"\d+", 0).cast("long").alias("slot"), F.lit(False).alias("is_ai"), "text")
    got = sorted(map(tuple, loop.replace_rounds(refs, q, 4, "replace_all", side=loop.last_words, write=loop.on_the_question).collect()))
    want = []
    for x in range(3):
        put = lambda t: f"On the question what {x}: {t}"  # noqa: E731, B023
        docs, sigs = [(0, t and put(t)) for y, _, t, _ in corpus if y == x], []
        for r in range(4):
            main = [sentence(docs[i % len(docs)][1]) for i in range(3)]
            side = [sentence(docs[-1 - i % len(docs)][1], -1) for i in range(3)]
            want.append((x, r, round(sum(a for a, _ in docs) / len(docs), 6), len(set(main)), hashlib.md5("\n".join(t for _, t in docs if t is not None).encode()).hexdigest()))
            docs = [(1, put(s)) for s in side]
            sigs.append(sorted(map(len, main)))
            if len(sigs) >= 4 and len({tuple(s) for s in sigs[-4:]}) == 1:
                break
    assert got == sorted(want)


def test_a_round_scores_its_new_documents_only(spark, monkeypatch):
    sizes, real = [], loop.scored
    monkeypatch.setattr(loop, "scored", lambda store, q, penalty=0.0: (sizes.append(store.count()), real(store, q, penalty))[1])
    store = spark.createDataFrame([(q, i, False, f"red fox {'and ' * i}{i}. number {i}") for q in (1, 2) for i in range(20)], "question_id long, doc long, is_ai boolean, text string")
    questions = spark.createDataFrame([(1, "red fox"), (2, "red fox 3")], "question_id long, question_text string")
    loop.search_rounds(store, questions, rounds=3, runs=3, generate=loop.extractive).collect()
    assert sizes == [40, 2, 2, 2]
