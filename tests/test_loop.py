from loopscope.operators import loop


def test_a_question_leaves_after_four_equal_rounds(spark):
    store = spark.createDataFrame([(q, i, False, f"red fox number {i}") for q in (1, 2) for i in range(5)], "question_id long, doc long, is_ai boolean, text string")
    questions = spark.createDataFrame([(1, "red fox"), (2, "red fox")], "question_id long, question_text string")

    def generate(rows):
        from pyspark.sql import functions as F

        return rows.withColumn("answer", F.lit("red fox"))

    got = loop.search_rounds(store, questions, rounds=6, generate=generate).collect()
    assert sorted((r["question_id"], r["round"]) for r in got) == [(q, r) for q in (1, 2) for r in range(1, 5)]


def test_registered_loops_run_all_rounds_of_the_search_variant(monkeypatch):
    seen = []
    monkeypatch.setattr(loop, "_start", lambda *_: (None, None))
    monkeypatch.setattr(loop, "search_rounds", lambda *a, rounds, **k: seen.append(rounds))
    loop.search_loop(None, "")
    loop.rerank_loop(None, "")
    assert seen == [30, 30]
