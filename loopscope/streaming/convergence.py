"""Stopping as streaming state: a question's last signatures are kept from batch to batch, and it is reported once, when it has converged."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from loopscope.operators.loop import EQUAL_ROUNDS
from loopscope.plans import views as V
from loopscope.plans.lineage import folder, stored
from loopscope.plans.registry import query

#: What a question's state holds: the last signatures (answer lengths, sorted), and whether it has been reported.
STATE = "signatures array<array<int>>, done boolean"
ROUNDS = "question_id long, iteration_number long, lengths array<int>"


def signatures(answers: DataFrame) -> DataFrame:
    """question_id, iteration_number and the sorted lengths of the answers of each round: what a round's file holds."""
    return answers.groupBy("question_id", "iteration_number").agg(F.array_sort(F.collect_list(F.length("answer"))).alias("lengths"))


def _advance(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    last, done = (list(state.get[0]), state.get[1]) if state.exists else ([], False)
    rows = sorted(((int(i), [int(x) for x in s]) for f in frames for i, s in zip(f["iteration_number"], f["lengths"])), key=lambda r: r[0])
    out = []
    for i, s in rows:
        last = [list(map(int, x)) for x in last][1 - EQUAL_ROUNDS :] + [s]
        if not done and len(last) == EQUAL_ROUNDS and all(x == s for x in last):
            done = True
            out.append((key[0], i))
    state.update((last, done))
    yield pd.DataFrame(out, columns=["question_id", "converged_at"])


def converged(rounds: DataFrame) -> DataFrame:
    """question_id, converged_at: a row for each question of a stream of rounds (ROUNDS), as the round arrives that ends EQUAL_ROUNDS equal signatures.

    The state of a question is EQUAL_ROUNDS signatures and a flag, however many rounds go by. Rounds of one question come in order from batch to
    batch (within a batch in any order), each whole in one row; a round's later row would count as another round.
    """
    return rounds.groupBy("question_id").applyInPandasWithState(_advance, "question_id long, converged_at long", STATE, "append", GroupStateTimeout.NoTimeout)


def replay(spark: SparkSession, rounds: str, out: str, checkpoint: str, files: int = 1) -> None:
    """Read the rounds' files in the order they were written, `files` a batch, and append what converges to `out`; run again, it goes on behind the last batch."""
    stream = spark.readStream.schema(ROUNDS).option("maxFilesPerTrigger", files).parquet(rounds)
    converged(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()


@query(f"WITH {V.RUNS}, s AS (SELECT question_id, iteration_number, list_sort(list(length(answer))) AS sig FROM runs GROUP BY ALL), f AS (SELECT question_id, iteration_number, sig = lag(sig, 1) OVER w AND sig = lag(sig, 2) OVER w AND sig = lag(sig, 3) OVER w AS stop FROM s WINDOW w AS (PARTITION BY question_id ORDER BY iteration_number)) SELECT question_id, min(iteration_number) FILTER (stop) AS converged_at FROM f GROUP BY 1")
def converged_in_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When each question converges, from its rounds replayed as a stream of files in the order of the rounds, a file a batch; null where it does not."""
    base = f"{folder(spark)}/loopscope/stream-{uuid.uuid4().hex}"
    s = stored(signatures(V.runs(spark, sf_dir)))
    for r in [x[0] for x in s.select("iteration_number").distinct().orderBy("iteration_number").collect()]:  # a few rounds
        s.where(F.col("iteration_number") == r).write.mode("append").parquet(f"{base}/rounds")
    replay(spark, f"{base}/rounds", f"{base}/out", f"{base}/state")
    got = spark.read.schema("question_id long, converged_at long").parquet(f"{base}/out")
    return s.select("question_id").distinct().join(got, "question_id", "left")
