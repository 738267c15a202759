"""Convergence over a stream equals convergence over the whole table, batch by batch and after a restart."""

import random

import pytest
from pyspark.sql import functions as F

from loopscope.streaming import convergence, replays, rounds

SF = "/root/testdata/sf0.001"


def plain(rows):
    out = {}
    for q in {r[0] for r in rows}:
        own = [s for _, _, s in sorted(r for r in rows if r[0] == q)]
        its = sorted(i for x, i, _ in rows if x == q)
        for k in range(3, len(own)):
            if own[k - 3 : k + 1] == [own[k]] * 4:
                out[q] = its[k]
                break
    return out


def write(spark, rows, path):
    spark.createDataFrame(rows, convergence.ROUNDS).coalesce(1).write.mode("append").parquet(path)


@pytest.mark.parametrize("files", [1, 3])
def test_stream_equals_plain(spark, tmp_path, files):
    rng = random.Random(2)
    rows = [(q, r, rng.choice([[1, 2], [1, 2], [1, 2], [3]])) for q in range(12) for r in range(9)] + [(50, r, []) for r in range(4)] + [(51, r, [5]) for r in range(3)]
    path, out, state = (str(tmp_path / x) for x in ("rounds", "out", "state"))
    for r in range(5):
        write(spark, [x for x in rows if x[1] == r], path)
    convergence.replay(spark, path, out, state, files)
    for r in range(5, 9):  # a second run goes on from the state of the first
        write(spark, [x for x in rows if x[1] == r], path)
    convergence.replay(spark, path, out, state, files)
    got = [tuple(r) for r in spark.read.parquet(out).collect()]
    assert dict(got) == plain(rows) and len(got) == len(dict(got)) and 50 in dict(got) and 51 not in dict(got)


def test_no_file_holds_a_round_whole_and_none_splits_a_questions_round(spark, monkeypatch):
    seen, real = [], rounds.answer_stream
    monkeypatch.setattr(rounds, "answer_stream", lambda spark, path, *more: (seen.append(path), real(spark, path, *more))[1])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = replays.streamed_round_metrics(spark, SF).count()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files = spark.read.parquet(seen[0]).withColumn("f", F.input_file_name())
    assert files.where("iteration_number = 1").select("f").distinct().count() > 1
    assert files.select("question_id", "iteration_number", "f").distinct().count() == got


def test_round_metrics_of_blank_null_and_repeated_answers(spark, tmp_path):
    rows = [(1, 1, 0, "a b a"), (1, 1, 1, "B c"), (1, 1, 1, "c"), (1, 2, 0, None), (2, 1, 0, ""), (None, 1, 3, "x")]
    df = spark.createDataFrame(rows, "question_id long, iteration_number long, run_idx long, answer string")
    df.write.parquet(f"{tmp_path}/in")
    rounds.start_round_metrics(rounds.answer_stream(spark, f"{tmp_path}/in", df.schema), f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/out").select("question_id", "iteration_number", "unique_words", "n_runs").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, [(1, 1, 3, 2), (1, 2, 0, 1), (2, 1, 0, 1), (None, 1, 1, 1)]))
