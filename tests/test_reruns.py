"""Leave-one-out citations against a plain loop, and how often the generator is asked."""

import hashlib
import re

import pytest

from loopscope.operators import attribution, reruns
from loopscope.plans import views as V

SF = "/root/testdata/sf0.001"


def lead(text):
    return re.match("[^.!?]*", text or "").group()


def say(q, run, texts):
    h = lambda *k: hashlib.md5("|".join(map(str, k)).encode()).hexdigest()
    own = [(i, lead(t)) for i, t in enumerate(texts)]
    chosen = sorted(own, key=lambda x: (h(31, q, x[1]), x[0]))[:3] + sorted(own, key=lambda x: (h(37, q, run, x[1]), x[0]))[:1]
    return " ".join(s for _, s in sorted(set(chosen)))


def tokens(text):
    return {t for t in (w.lower() for w in re.findall("[A-Za-z0-9']+", text)) if len(t) >= 4}


def overlap(a, d):
    return len(a & d) / len(a) if a else 0.0


def plain(rounds, m=4, threshold=0.18, most=6):
    """(question, round, run, doc, change) from {(question, round): [(doc, text), ...]}, and the keys that were rerun."""
    out, keys = [], set()
    for (q, it), docs in rounds.items():
        for run in range(10):
            a = tokens(say(q, run, [t for _, t in docs]))
            best = sorted(range(len(docs)), key=lambda i: (-round(overlap(a, tokens(docs[i][1] or "")), 9), i))[:m]
            changes = []
            for i in best:
                rest = [t for d, t in docs if d != docs[i][0]]
                if rest:
                    keys.add((q, it, docs[i][0]))
                if rest and (again := say(q, 0, rest)):
                    changes.append((1 - overlap(a, tokens(again)), docs[i][0]))
            strong = [(c, d) for c, d in changes if c >= threshold][:most]
            out += [(q, it, run, d, round(c, 9)) for c, d in strong or sorted((x for x in changes if x[0] > 0), key=lambda x: -x[0])[:2]]
    return sorted(out), keys


@pytest.fixture(scope="module")
def rounds(spark):
    got = reruns.contexts(spark, SF).collect()
    return {(r["question_id"], r["iteration_number"]): [(d["doc_id"], d["text"]) for d in r["docs"]] for r in got}


@pytest.mark.parametrize(("m", "threshold"), [(4, 0.18), (2, 0.6), (9, 0.95)])
def test_citations_equal_a_plain_loop(spark, rounds, m, threshold):
    got = attribution.citations(spark, SF, threshold=threshold, m=m).collect()
    assert sorted((r["question_id"], r["iteration_number"], r["run_idx"], r["doc_id"], round(r["change"], 9)) for r in got) == plain(rounds, m, threshold)[0]


def test_equal_keys_run_once_and_known_ones_not_at_all(spark, rounds):
    asked = []

    def counting(rows):
        asked.append(rows.count())
        return reruns.grounded(rows)

    cache, keys = reruns.Reruns(spark), plain(rounds)[1]
    first = sorted(map(tuple, attribution.citations(spark, SF, generate=counting, cache=cache).collect()))
    assert asked == [10 * len(rounds), len(keys)] and cache.known().count() == len(keys)
    assert sorted(map(tuple, attribution.citations(spark, SF, generate=counting, cache=cache).collect())) == first
    assert asked[2:] == [10 * len(rounds), 0]
    attribution.citations(spark, SF, m=9, generate=counting, cache=cache)
    assert asked[-1] == len(plain(rounds, m=9)[1] - keys) > 0


def test_a_cache_outlives_its_session_object(spark, tmp_path):
    path = str(tmp_path / "reruns")
    df = spark.createDataFrame([(1, 1, "is a?", [(0, "a", "One. x"), (1, "b", "Two! y"), (2, None, None)])], "question_id long, iteration_number long, question_text string, docs array<struct<slot:int,doc_id:string,text:string>>")
    keys = spark.createDataFrame([(1, 1, "a"), (1, 1, "a"), (1, 1, "zz"), (2, 1, "a")], "question_id long, iteration_number long, doc_id string")
    got = reruns.Reruns(spark, path).ask(df, keys).collect()
    assert sorted((r["doc_id"], r["answer"]) for r in got) == [("a", " ".join(["Two", ""])), ("zz", " ".join(["One", "Two", ""]))]
    assert reruns.Reruns(spark, path).known().count() == 2


def test_no_context_and_no_document_left(spark):
    none = spark.createDataFrame([], "question_id long, iteration_number long, question_text string, docs array<struct<slot:int,doc_id:string,text:string>>")
    keys = spark.createDataFrame([(1, 1, "a")], "question_id long, iteration_number long, doc_id string")
    assert reruns.Reruns(spark).ask(none, keys).collect() == []
    one = spark.createDataFrame([(1, 1, "q", [(0, "a", "One.")])], none.schema)
    assert reruns.Reruns(spark).ask(one, keys).collect() == []
    assert reruns.answers(spark.createDataFrame([(1, 1, "q", [])], none.schema)).first()["answer"] == ""


def test_recorded_answers_are_still_what_views_give(spark):
    assert V.overlaps(spark, SF).select("run_idx").distinct().count() > 1


def test_elicited_documents(spark):
    df = spark.createDataFrame([(1, 1, "is a?", [(0, "a", "One. x"), (3, "b", "Two! y"), (5, "c", "Three")])], "question_id long, iteration_number long, question_text string, docs array<struct<slot:int,doc_id:string,text:string>>")

    def says(rows):
        from pyspark.sql import functions as F

        return rows.withColumn("answer", F.when(F.col("run_idx") == 0, "CITED: [1] no, cited: [3, 2, 3, 9, 0]").when(F.col("run_idx") == 1, "CITED: []").otherwise("none"))

    assert sorted(map(tuple, reruns.elicited(df, says, 3).collect())) == [(1, 1, 0, "b"), (1, 1, 0, "c")]
    own = reruns.answers(df, reruns.citing, 2).collect()
    plain_ = {r["run_idx"]: r["answer"] for r in reruns.answers(df, reruns.grounded, 2).collect()}
    assert all(r["answer"].startswith(plain_[r["run_idx"]] + "\nCITED: [1, 2, 3]") for r in own)
