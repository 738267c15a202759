"""Readers and sinks round trip through real files."""

import json

from pyspark.sql import functions as F

from loopscope.sources import readers, writers


def test_experiment_round_trip(spark, tmp_path):
    doc = {"doc_id": "ref_1_0", "iteration": 1, "url": "u", "text": "t"}
    run = {"run_id": "1_0", "answer": "a", "citation_ids": [2, 9, 1], "citations": [{"citation_id": 1, "doc_id": "x"}, {"citation_id": 2, "doc_id": "y"}]}
    body = {"questions": [{"question_id": 3, "question_text": "q", "iterations": [{"iteration_number": 1, "documents": [doc, {"document_id": "old"}], "runs": [run]}]}]}
    (tmp_path / "e_f0.3.json").write_text(json.dumps(body, indent=1))
    rounds = readers.experiment(spark, str(tmp_path / "*.json"))
    assert [r["doc_id"] for r in readers.experiment_documents(rounds).orderBy("slot").collect()] == ["ref_1_0", "old"]
    cites = readers.experiment_citations(readers.experiment_runs(rounds)).orderBy("pos").collect()
    assert [c["doc_id"] for c in cites] == ["y", "x"]
    assert readers.arms(rounds).first()["fraction"] == 0.3
    nested = writers.nested(rounds).first()
    assert nested["iterations"][0]["iteration_number"] == 1


def test_dataset_lines_and_filter(spark, tmp_path):
    refs = [{"url": str(i), "text": "t"} for i in range(12)]
    (tmp_path / "d.jsonl").write_text("\n".join(json.dumps({"question": q, "references": refs[:k]}) for q, k in (("a", 12), ("b", 4))) + "\n\n")
    got = readers.with_references(readers.dataset_lines(spark, str(tmp_path / "d.jsonl"))).collect()
    assert [(r["question"], len(r["references"])) for r in got] == [("a", 10)]


def test_ground_truth_both_forms(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"_id": "1", "answer": "x"}]))
    (tmp_path / "b.json").write_text(json.dumps({"2": "y"}))
    for f, want in (("a", ("1", "x")), ("b", ("2", "y"))):
        assert [tuple(r) for r in readers.ground_truth(spark, str(tmp_path / f"{f}.json")).collect()] == [want]


def test_native_documents(spark, tmp_path):
    rec = {"_id": "q", "question": "?", "answer": "a", "type": "bridge", "level": "e", "supporting_facts": [["A", 0]], "context": [["A", ["x", "y"]], ["B", ["z"]]]}
    (tmp_path / "r.json").write_text(json.dumps([rec]))
    d = readers.native_documents(readers.qa_records(spark, str(tmp_path / "r.json"))).orderBy("slot").collect()
    assert [(r["title"], r["text"], r["gold"]) for r in d] == [("A", "x y", True), ("B", "z", False)]


def test_sidecar_and_append(spark, tmp_path):
    (tmp_path / "s.json").write_text(json.dumps({"0": {"1": {"1_0": ["a", "b"]}}}))
    assert readers.sidecar(spark, str(tmp_path / "s.json")).count() == 2
    out = str(tmp_path / "t")
    df = spark.range(3).withColumn("v", F.lit("x"))
    assert writers.append_new(df, out, ["id"]) == 3
    assert writers.append_new(spark.range(5).withColumn("v", F.lit("y")), out, ["id"]) == 2
    assert spark.read.parquet(out).count() == 5


def test_streaming_rounds(spark, tmp_path):
    from loopscope.streaming import rounds

    src = str(tmp_path / "in")
    spark.createDataFrame([(1, 1, 0, "a b"), (1, 1, 1, "b c")], "question_id long, iteration_number long, run_idx long, answer string").write.parquet(src)
    q = rounds.start_round_metrics(rounds.answer_stream(spark, src, "question_id long, iteration_number long, run_idx long, answer string"), str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination(60)
    r = spark.read.parquet(str(tmp_path / "out")).first()
    assert (r["unique_words"], r["n_runs"]) == (3, 2)


def test_json_files_over_several_lines(spark, tmp_path):
    (tmp_path / "list.json").write_text('[\n {"_id": "a",\n  "answer": "x"},\n {"_id": "b", "answer": "y"}\n]\n')
    (tmp_path / "map.json").write_text('{\n "c": "z"\n}')
    got = sorted(map(tuple, readers.ground_truth(spark, str(tmp_path)).collect()))
    assert got == [("a", "x"), ("b", "y"), ("c", "z")]
    (tmp_path / "side").mkdir()
    (tmp_path / "side" / "s.json").write_text('{"1": {\n"2": {"2_0": ["d",\n"e"]}}}')
    assert sorted(map(tuple, readers.sidecar(spark, str(tmp_path / "side")).collect())) == [(1, 2, "2_0", "d"), (1, 2, "2_0", "e")]
