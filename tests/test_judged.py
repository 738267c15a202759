"""Judged answers against SQL where the driver's small tables show no difference: letters beyond ASCII beside words, blanks, nulls, braces."""

import duckdb

from loopscope.catalog import ORACLE, QUERIES

ANSWERS = ["éyes ñ", "yesé bb", "bb éno yes", " yes bbbb", "an éa the", "Beta ", "ébeta", "  Beta", " the éBeta", '{"text": "x"}a', '  {"response":"y"}', "", "no way", "Yes", None, "éthe", 'a "q" \\ \u0001']


def test_equals_its_sql(spark, tmp_path):
    rows = [(10 * q, 1, "user", None if q == 1 else f"What éBeta {q}?") for q in range(3)] + [(10 * q + 1, 1, "user", "later beta") for q in range(3)]
    rows += [(10 * q + k % 10, 2 + 2 * (k // 10), "assistant", (" " * q + a) if a else a) for q in range(3) for k, a in enumerate(ANSWERS)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    spark.createDataFrame([(q, "of a Beta") for q in range(3)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    duck = duckdb.connect()
    for t in ("conversations", "benchmark"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    got = QUERIES["judged_answers"](spark, str(tmp_path))
    want = duck.execute(f"SELECT {', '.join(got.columns)} FROM ({ORACLE['judged_answers']})").fetchall()
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want)) and len(want) == 3 * len(ANSWERS)
