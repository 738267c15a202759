import os

from loopscope.sources import discovery


def put(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        f.write(text if isinstance(text, bytes) else text.encode())


def test_found_takes_the_first_pattern_that_fits(spark, tmp_path):
    for name in ("a/run_f0.3.json", "a/b/old_run.json", "c/notes.txt"):
        put(str(tmp_path / name), "x")
    names = lambda *p: sorted(r["path"].split("/")[-1] for r in discovery.found(spark, str(tmp_path), *p).collect())
    assert names() == ["notes.txt", "old_run.json", "run_f0.3.json"] and names(r"_f[0-9.]+\.json$", r"\.json$") == ["run_f0.3.json"]
    assert names(r"\.xml$", r"\.json$") == ["old_run.json", "run_f0.3.json"] and names(r"\.xml$") == []


def test_ends_read_no_more_than_they_say(spark, tmp_path):
    put(str(tmp_path / "long.json"), "h" * 50 + "m" * 100_000 + "t" * 50)
    put(str(tmp_path / "short.json"), "é}")
    put(str(tmp_path / "empty.json"), "")  # without bytes: not listed
    put(str(tmp_path / "odd.json"), b"\xff\xfe")
    got = {r["path"].split("/")[-1]: r for r in discovery.ends(discovery.found(spark, str(tmp_path)), 10, 5).collect()}
    assert (got["long.json"]["head"], got["long.json"]["tail"], got["long.json"]["bytes_read"]) == ("h" * 10, "t" * 5, 15)
    assert (got["short.json"]["head"], got["short.json"]["tail"]) == ("é}", "é}") and "empty.json" not in got
    assert got["odd.json"]["head"] == "��"
    gone = discovery.found(spark, str(tmp_path)).collect()
    os.remove(tmp_path / "odd.json")
    rows = spark.createDataFrame(gone).where("path like '%odd.json'")
    assert [(r["head"], r["bytes_read"]) for r in discovery.ends(rows).collect()] == [(None, 0)]


def test_problems_of_files(spark, tmp_path):
    def run(rounds, runs, answers, end="}\n"):
        return f'{{"num_iterations": {rounds},\n"num_runs_per_iteration": {runs},\n"question_id": 1,\n' + "".join(f'"answer": "{a}",\n' for a in answers) + end

    put(str(tmp_path / "hotpotqa/search/a.json"), run(30, 10, ["x"] * 10))
    put(str(tmp_path / "replace_all/b.json"), run(9, 3, ["x", ""], "tail"))
    put(str(tmp_path / "other/c.json"), "\n")
    got = {r["path"].split("/")[-1]: r for r in discovery.validated(spark, str(tmp_path), {"search": 30, "replace_all": 10}, 10).collect()}
    assert list(got["a.json"]["problems"]) == [] and got["a.json"]["questions"] == 1 and got["a.json"]["variant"] == "search"
    assert list(got["b.json"]["problems"]) == ["rounds", "runs", "truncated", "empty answers"] and got["b.json"]["empty_rate"] == 0.5
    assert list(got["c.json"]["problems"]) == ["runs", "truncated", "empty answers"] and got["c.json"]["method"] == "misc"


def test_classes_by_path(spark):
    rows = ["/x/HotpotQA/Replace_One_paraphrased.json", "/x/rerank/r.json", "/search/deep/er/z.json", "agentic_rag"]
    got = [tuple(r) for r in discovery.classified(spark.createDataFrame([(r,) for r in rows], "path string")).select("variant", "method", "config", "benchmark").collect()]
    assert got == [("replace_one_paraphrase", "paraphrase", "replace_one", "hotpotqa"), ("rerank", "rerank", None, "other"), ("misc", "misc", None, "other"), ("agentic_rag", "agentic_rag", None, "other")]
