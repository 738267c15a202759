"""Round trips through the file formats: what a sink writes a source reads, over whole tables, in the folder that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loopscope.functions import text as T
from loopscope.operators.attribution import answered, citations
from loopscope.operators.contexts import _REFS, references
from loopscope.plans import views as V
from loopscope.plans.lineage import folder
from loopscope.plans.places import numbered
from loopscope.plans.registry import n, query
from loopscope.sources import discovery, readers, writers

CELL = ["question_id", "iteration_number"]


def _fresh(spark: SparkSession, name: str) -> str:
    return f"{folder(spark)}/loopscope/files/{name}-{uuid.uuid4().hex}"


@query(f"WITH {_REFS}, {V.QUESTIONS} SELECT question_text AS question, count(*) AS n_references, md5(string_agg(md5(text), '' ORDER BY i)) AS digest FROM refs JOIN questions USING (question_id) GROUP BY question_id, question_text")
def dataset_lines_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions with their references as JSON lines; five references at least, ten at most."""
    path = _fresh(spark, "dataset")
    refs = V.table(spark, sf_dir, "pages").groupBy(F.expr("page_id div 12").alias("question_id")).agg(F.array_sort(F.collect_list(F.struct("page_id", "url", F.col("html").alias("text")))).alias("l"))
    out = refs.join(V.questions(spark, sf_dir), "question_id").select(F.col("question_text").alias("question"), F.transform("l", lambda x: F.struct(x["url"].alias("url"), x["text"].alias("text"))).alias("references"))
    writers.write_json(out, path)
    got = readers.with_references(readers.dataset_lines(spark, path))
    return got.select("question", n(F.size("references"), "n_references"), F.md5(F.array_join(F.transform("references", lambda r: F.md5(r["text"])), "")).alias("digest"))


#: Records of a file that is one JSON value.
FILE_RECORDS = 10_000


def _write_arrays(rows: DataFrame, column: str, opening: str, closing: str, path: str) -> None:
    """JSON texts as files of about FILE_RECORDS each, every one a JSON array or map of its own: rows are dealt by hash, and no file grows with the table."""
    files = max(1, -(-rows.count() // FILE_RECORDS))
    shards = rows.groupBy(F.pmod(F.xxhash64(column), F.lit(files)).alias("shard")).agg(F.concat(F.lit(opening), F.array_join(F.collect_list(column), ",\n"), F.lit(closing)).alias("value"))
    shards.select("value", "shard").write.partitionBy("shard").option("lineSep", "\n\n").text(path)


@query(f"WITH {_REFS} SELECT question_id, count(*) AS n_references, md5(string_agg(url, ' ' ORDER BY i)) AS digest FROM refs GROUP BY 1")
def dataset_array_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions as JSON arrays, a file for about FILE_RECORDS of them."""
    path = _fresh(spark, "array")
    q = references(spark, sf_dir).select(F.to_json(F.struct(F.col("question_id").cast("string").alias("question"), "references")).alias("j"))
    _write_arrays(q, "j", "[", "]", path)
    got = readers.with_references(readers.dataset_array(spark, path))
    return got.select(F.col("question").cast("long").alias("question_id"), n(F.size("references"), "n_references"), F.md5(F.array_join(F.transform("references", lambda r: r["url"]), " ")).alias("digest"))


def _write_experiment(spark: SparkSession, sf_dir: str, path: str) -> None:
    d = V.context_docs(spark, sf_dir).groupBy(*CELL).agg(F.array_sort(F.collect_list(F.struct("slot", "doc_id", F.col("iteration_number").alias("iteration"), F.col("source").alias("url"), "text"))).alias("documents"))
    cite = citations(spark, sf_dir).groupBy(*CELL, "run_idx").agg(F.array_sort(F.collect_list(F.struct((F.col("slot") + 1).cast("int").alias("citation_id"), "doc_id"))).alias("citations"))
    r = answered(spark, sf_dir).join(cite, [*CELL, "run_idx"], "left").groupBy(*CELL).agg(F.array_sort(F.collect_list(F.struct("run_idx", F.concat_ws("_", "iteration_number", "run_idx").alias("run_id"), "answer", F.transform("citations", lambda c: c["citation_id"]).alias("citation_ids"), "citations"))).alias("runs"))
    rounds = d.join(r, CELL).join(V.questions(spark, sf_dir), "question_id")
    nested = writers.nested(rounds)
    nested.select(F.array(F.struct("question_id", "question_text", "iterations")).alias("questions")).write.json(path)


@query(f"WITH {V.DOCS}, {V.QUESTIONS} SELECT d.question_id, d.iteration_number, d.doc_id, slot, md5(d.text) AS digest FROM docs d SEMI JOIN questions USING (question_id)")
def experiment_documents_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A whole experiment as nested JSON (questions, rounds, documents, runs), and its documents read back with their slots."""
    path = _fresh(spark, "experiment")
    _write_experiment(spark, sf_dir, path)
    d = readers.experiment_documents(_lines(spark, path))
    return d.select(*[F.col(c).cast("long").alias(c) for c in CELL], "doc_id", n(F.col("slot"), "slot"), F.md5("text").alias("digest"))


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """A question a line, each line an experiment of its own."""
    raw = spark.read.schema(readers.EXPERIMENT).json(path).select(F.explode("questions").alias("q"))
    return raw.select("q.question_id", "q.query_id", "q.question_text", F.explode_outer("q.iterations").alias("i")).select("question_id", "query_id", "question_text", "i.*")


def _loo() -> str:
    from loopscope.operators.attribution import _LOO

    return _LOO


@query(f"WITH {_loo()} SELECT question_id, iteration_number, run_idx, slot + 1 AS citation_id, doc_id FROM cited")
def experiment_citations_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citation ids of the runs, looked up in each run's own index."""
    path = _fresh(spark, "experiment")
    _write_experiment(spark, sf_dir, path)
    runs = readers.experiment_runs(_lines(spark, path))
    c = readers.experiment_citations(runs.withColumn("run_idx", F.element_at(F.split("run_id", "_"), 2).cast("long")))
    return c.select(*[F.col(k).cast("long").alias(k) for k in CELL], "run_idx", n(F.col("citation_id"), "citation_id"), "doc_id")


@query(f"WITH {V.RUNS} SELECT question_id, iteration_number, round(avg(length(answer)), 4) AS answer_length FROM runs GROUP BY 1, 2")
def evaluation_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of every round as an evaluation file, whose question ids are written q0, q1, ..., read back under their numbers."""
    path = _fresh(spark, "evaluation")
    m = V.runs(spark, sf_dir).groupBy(*CELL).agg(F.round(F.avg(F.length("answer")), 4).alias("v"))
    q = m.groupBy("question_id").agg(F.collect_list(F.struct("iteration_number", F.create_map(F.lit("answer_length"), "v").alias("metrics"))).alias("iterations"))
    writers.write_json(q.select(F.array(F.struct(F.concat(F.lit("q"), "question_id").alias("question_id"), "iterations")).alias("questions")), path)
    raw = spark.read.schema(readers.EVALUATION).json(path).select(F.explode("questions").alias("q")).select("q.question_id", F.explode("q.iterations").alias("i"))
    return readers.numbered(raw).select("question_id", F.col("iteration_number").cast("long").alias("iteration_number"), F.col("metrics")["answer_length"].alias("answer_length"))


@query(f"WITH {V.GOLD} SELECT 'list' AS form, CAST(question_id AS VARCHAR) AS query_id, gold AS answer FROM gold UNION ALL SELECT 'map', CAST(question_id AS VARCHAR), gold FROM gold")
def ground_truth_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Right answers in both file formats: a list of records, and one flat map."""
    g = V.gold(spark, sf_dir).select(F.col("question_id").cast("string").alias("_id"), F.col("gold").alias("answer"))
    out = None
    entry = F.concat(F.to_json(F.array("_id")).substr(F.lit(2), F.length(F.to_json(F.array("_id"))) - 2), F.lit(":"), F.to_json(F.array("answer")).substr(F.lit(2), F.length(F.to_json(F.array("answer"))) - 2))
    for form, value, ends in (("list", F.to_json(F.struct("_id", "answer")), "[]"), ("map", entry, "{}")):
        path = _fresh(spark, f"truth-{form}")
        _write_arrays(g.select(value.alias("value")), "value", *ends, path)
        got = readers.ground_truth(spark, path).select(F.lit(form).alias("form"), "query_id", "answer")
        out = got if out is None else out.unionByName(got)
    return out


@query(f"WITH {_loo()} SELECT question_id, CAST(iteration_number AS BIGINT) AS round, iteration_number || '_' || run_idx AS run_id, doc_id FROM cited")
def sidecar_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citations as nested maps (question, round, run), a file a question, read back as rows."""
    path = _fresh(spark, "sidecar")
    c = citations(spark, sf_dir).groupBy(*CELL, "run_idx").agg(F.collect_list("doc_id").alias("ids"))
    entry = lambda k, v: F.map_from_entries(F.collect_list(F.struct(k, v)))
    c = c.groupBy(*CELL).agg(entry(F.concat_ws("_", "iteration_number", "run_idx"), F.col("ids")).alias("m")).groupBy("question_id").agg(entry(F.col("iteration_number").cast("string"), F.col("m")).alias("m"))
    c.select(F.to_json(F.create_map(F.col("question_id").cast("string"), "m")).alias("value"), F.col("question_id").alias("part")).write.partitionBy("part").text(path)
    return readers.sidecar(spark, path).select("question_id", F.col("round").cast("long").alias("round"), "run_id", "doc_id")


@query("WITH k AS (SELECT page_id, regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)), '^www\\.', '') || regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/+$', '') AS key FROM pages WHERE page_id % 2 = 0) SELECT key, arg_max(CASE WHEN page_id % 3 = 0 THEN 'AI' ELSE 'Human' END, page_id) AS label FROM k GROUP BY 1")
def detector_labels_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A detector's table as CSV: either of two url columns, one batch, the last label of a key."""
    path = _fresh(spark, "detector")
    p = V.table(spark, sf_dir, "pages")
    rows = p.select(F.col("page_id").alias("row"), F.when(F.col("page_id") % 2 == 0, "January").otherwise("June").alias("batch"), F.when(F.col("page_id") % 3 == 0, "AI").otherwise("Human").alias("Content type [gptzero]"), F.when(F.col("page_id") % 4 == 0, F.col("url")).alias("URL"), F.when(F.col("page_id") % 4 != 0, F.col("url")).alias("citation_url"))
    writers.write_csv(rows, path)
    return readers.detector_labels(spark, path, "January", order="row")


@query("SELECT source, lang, count(*) AS n FROM documents GROUP BY 1, 2")
def table_sinks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report written as TSV, appended to a table twice (the second time nothing is new), and read back."""
    path, table = _fresh(spark, "report"), _fresh(spark, "table")
    r = V.table(spark, sf_dir, "documents").groupBy("source", "lang").agg(n(F.count(F.lit(1)), "n"))
    writers.write_tsv(r, path)
    got = spark.read.option("header", True).option("sep", "\t").schema("source string, lang string, n long").csv(path)
    writers.append_new(got, table, ["source", "lang"])
    writers.append_new(got, table, ["source", "lang"])
    return spark.read.schema("source string, lang string, n long").parquet(table)


@query("SELECT c_mktsegment AS arm, CASE c_mktsegment WHEN 'BUILDING' THEN 0.3 WHEN 'MACHINERY' THEN 0.5 ELSE 0.0 END AS fraction, count(*) AS n FROM customer GROUP BY 1")
def arms_from_file_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arms of a sweep by the names of their files."""
    base = _fresh(spark, "sweep")
    c = V.table(spark, sf_dir, "customer")
    f = F.when(F.col("c_mktsegment") == "BUILDING", "0.3").when(F.col("c_mktsegment") == "MACHINERY", "0.5").otherwise("0.0")
    c.select(F.col("c_mktsegment").alias("arm"), F.concat(F.lit("run_f"), f, F.lit(".json")).alias("name")).write.partitionBy("name").json(base)
    got = spark.read.schema("arm string, name string").json(base).select("arm", F.concat_ws("/", F.lit("x"), "name").alias("file"))
    return readers.arms(got).groupBy("arm", "fraction").agg(n(F.count(F.lit(1)), "n"))


@query("WITH e AS (SELECT DISTINCT c_nationkey, s.m FROM customer, (SELECT DISTINCT c_mktsegment AS m FROM customer) s), p AS (SELECT DISTINCT c_nationkey, c_mktsegment AS m FROM customer WHERE c_acctbal > 5000) SELECT CAST(c_nationkey AS BIGINT) AS nation, m AS segment FROM e ANTI JOIN p USING (c_nationkey, m)")
def missing_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of the full plan (every nation in every segment) that are not there yet."""
    c = V.table(spark, sf_dir, "customer")
    plan = c.select("c_nationkey").distinct().crossJoin(F.broadcast(c.select("c_mktsegment").distinct()))  # the plan's two short lists
    return readers.missing(plan, c.where("c_acctbal > 5000"), ["c_nationkey", "c_mktsegment"]).select(n(F.col("c_nationkey"), "nation"), F.col("c_mktsegment").alias("segment"))


@query(f"WITH {V.RUNS}, v AS (SELECT question_id, count(DISTINCT iteration_number) AS n_rounds, count(*) AS n_runs, avg(CASE WHEN trim(answer) = '' THEN 1.0 ELSE 0 END) AS empty FROM runs GROUP BY 1) SELECT question_id, n_rounds, n_runs, n_rounds = 4 AND empty <= 0.1 AS valid FROM v")
def validated_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each question's output is whole: its rounds, its runs, and at most a tenth of empty answers."""
    v = V.runs(spark, sf_dir).groupBy("question_id").agg(n(F.countDistinct("iteration_number"), "n_rounds"), n(F.count(F.lit(1)), "n_runs"), F.avg((F.trim("answer") == "").cast("double")).alias("e"))
    return v.select("question_id", "n_rounds", "n_runs", ((F.col("n_rounds") == 4) & (F.col("e") <= 0.1)).alias("valid"))


@query("WITH q AS (SELECT doc_id, lang AS split FROM documents), r AS (SELECT DISTINCT doc_id FROM labels) SELECT split, count(*) AS n_queries FROM q SEMI JOIN r USING (doc_id) GROUP BY 1")
def judged_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries of each split that have judgements."""
    return V.table(spark, sf_dir, "documents").join(V.table(spark, sf_dir, "labels"), "doc_id", "left_semi").groupBy(F.col("lang").alias("split")).agg(n(F.count(F.lit(1)), "n_queries"))


@query("WITH s AS (SELECT row_number() OVER (PARTITION BY doc_id % 4 ORDER BY doc_id) - 1 AS i, doc_id % 4 AS shard, doc_id FROM documents), c AS (SELECT shard, count(*) AS c FROM s GROUP BY 1), o AS (SELECT shard, coalesce(sum(c) OVER (ORDER BY shard ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM c) SELECT doc_id, CAST(i + off AS BIGINT) AS place FROM s JOIN o USING (shard)")
def merged_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four shards one after the other: a row's place by shard and then by document, from range partitions and their sizes, whatever a shard holds."""
    d = V.table(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") % 4).alias("shard"))
    return numbered(d, F.col("shard"), F.col("doc_id")).select("doc_id", n(F.col("place") - 1, "place"))


@query(f"WITH {V.DOCS}, k AS (SELECT question_id, slot, concat_ws('_', 'native', slot) AS doc_id, slot < 2 AS gold, text AS t FROM docs WHERE iteration_number = 1) SELECT question_id, doc_id, slot, gold, md5(t || ' ' || t) AS digest FROM k")
def native_documents_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Native records (positional lists of titles and sentences) as JSON, read back as documents; gold where the title supports the answer."""
    path = _fresh(spark, "native")
    d = V.context_docs(spark, sf_dir).where("iteration_number = 1").withColumn("t", F.col("text"))
    pair = lambda a, b: F.concat(F.lit("["), F.to_json(F.array(a)).substr(F.lit(2), F.length(F.to_json(F.array(a))) - 2), F.lit(","), b, F.lit("]"))
    title = F.concat_ws("_", "source", "slot")
    rows = d.groupBy("question_id").agg(
        F.array_sort(F.collect_list(F.struct("slot", pair(title, F.to_json(F.array("t", "t"))).alias("j")))).alias("c"),
        F.array_sort(F.collect_list(F.when(F.col("slot") < 2, F.struct("slot", pair(title, F.lit("0")).alias("j"))))).alias("s"),
    )
    joined = lambda c: F.concat(F.lit("["), F.array_join(F.transform(c, lambda x: x["j"]), ","), F.lit("]"))
    body = F.concat(F.lit('{"_id":"'), F.col("question_id").cast("string"), F.lit('","type":"bridge","supporting_facts":'), joined("s"), F.lit(',"context":'), joined("c"), F.lit("}"))
    rows.select(body.alias("value")).write.text(path)
    got = readers.native_documents(readers.qa_lines(spark, path))
    return got.select(F.col("query_id").cast("long").alias("question_id"), "doc_id", n(F.col("slot"), "slot"), "gold", F.md5("text").alias("digest"))


@query("SELECT 'c_' || substr(sha256(event_type), 1, 8) AS candidate_id, count(*) AS n_events, round(sum(value), 4) AS total FROM events GROUP BY event_type")
def event_log_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An optimizer's events as JSON lines under their candidates' short ids, read back and summed."""
    path = _fresh(spark, "events")
    e = V.table(spark, sf_dir, "events").select(writers.candidate_id("event_type").alias("candidate_id"), "value", "props")
    writers.write_json(e, path)
    return readers.events(spark, path, "candidate_id string, value double").groupBy("candidate_id").agg(n(F.count(F.lit(1)), "n_events"), F.round(F.sum("value"), 4).alias("total"))


_TREE = "CASE question_id % 5 WHEN 0 THEN 'search_paraphrased_run' WHEN 1 THEN 'run_replace_one' WHEN 2 THEN 'agentic_rag' WHEN 3 THEN 'Search' ELSE 'notes' END"


@query(f"WITH {V.RUNS}, r AS (SELECT {_TREE} AS tree, question_id, answer FROM runs), l AS (SELECT tree, '\"question_id\": ' || question_id || ',' AS s, 1 AS q, 0 AS a, 0 AS e FROM r GROUP BY tree, question_id UNION ALL SELECT tree, CASE WHEN length(answer) % 7 = 0 THEN '\"answer\": \"\"' ELSE '\"answer\": \"' || md5(answer) || '\"' END, 0, 1, CASE WHEN length(answer) % 7 = 0 THEN 1 ELSE 0 END FROM r UNION ALL SELECT DISTINCT tree, unnest(['{{\"experiment_metadata\": {{', '\"num_iterations\": 4,', '\"num_runs_per_iteration\": 10}},']), 0, 0, 0 FROM r UNION ALL SELECT DISTINCT tree, '}}', 0, 0, 0 FROM r WHERE tree <> 'agentic_rag'), g AS (SELECT tree, sum(q) AS questions, sum(a) AS answers, sum(e) AS empty, sum(strlen(s) + 1) AS size FROM l GROUP BY tree) "
    "SELECT CASE tree WHEN 'search_paraphrased_run' THEN 'search_paraphrase' WHEN 'run_replace_one' THEN 'replace_one' WHEN 'agentic_rag' THEN 'agentic_rag' WHEN 'Search' THEN 'search' ELSE 'misc' END AS variant, CASE tree WHEN 'search_paraphrased_run' THEN 'paraphrase' WHEN 'agentic_rag' THEN 'agentic_rag' WHEN 'notes' THEN 'misc' ELSE 'baseline' END AS method, CASE tree WHEN 'search_paraphrased_run' THEN 'search' WHEN 'run_replace_one' THEN 'replace_one' WHEN 'Search' THEN 'search' END AS config, CAST(questions AS BIGINT) AS questions, round(1.0 * empty / answers, 6) AS empty_rate, CAST(least(size, 8192) + least(size, 256) AS BIGINT) AS bytes_read, concat_ws(', ', CASE WHEN tree = 'notes' THEN 'rounds' END, CASE WHEN tree = 'agentic_rag' THEN 'truncated' END, CASE WHEN 1.0 * empty / answers > 0.15 THEN 'empty answers' END) AS problems FROM g")
def discovered_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of runs under one folder: what their paths say, whether they are whole, and how much of them had to be read for that."""
    root = _fresh(spark, "tree")
    r = V.runs(spark, sf_dir).select(F.expr(_TREE).alias("tree"), "question_id", "run_idx", "iteration_number", "answer")
    said = F.when(F.length("answer") % 7 == 0, '"answer": ""').otherwise(F.concat(F.lit('"answer": "'), F.md5("answer"), F.lit('"')))
    line = lambda d, *order: d.select("tree", *[F.lit(o).cast("long") if isinstance(o, int) else F.col(o).cast("long") for o in order], "value").toDF("tree", "a", "b", "c", "d", "value")
    trees = r.select("tree").distinct()
    heads = ['{"experiment_metadata": {', '"num_iterations": 4,', '"num_runs_per_iteration": 10},']
    rows = line(r.select("tree", "question_id").distinct().withColumn("value", F.concat(F.lit('"question_id": '), "question_id", F.lit(","))), 1, "question_id", -1, -1)
    rows = rows.unionByName(line(r.withColumn("value", said), 1, "question_id", "iteration_number", "run_idx"))
    for i, h in enumerate(heads):
        rows = rows.unionByName(line(trees.withColumn("value", F.lit(h)), 0, i, 0, 0))
    rows = rows.unionByName(line(trees.where("tree <> 'agentic_rag'").withColumn("value", F.lit("}")), 2, 0, 0, 0))
    rows.repartition("tree").sortWithinPartitions("tree", "a", "b", "c", "d").drop("a", "b", "c", "d").write.partitionBy("tree").text(root)
    want = {v: 4 for v in ("search_paraphrase", "replace_one", "agentic_rag", "search")}
    got = discovery.validated(spark, root, want, 10, 0.15)
    return got.select("variant", "method", "config", n(F.col("questions"), "questions"), F.round("empty_rate", 6).alias("empty_rate"), "bytes_read", F.array_join("problems", ", ").alias("problems"))


@query(f"WITH {V.RUNS} SELECT question_id, iteration_number, run_idx, md5(CASE WHEN run_idx % 3 = 2 THEN regexp_replace(answer, '^\\s+', '') ELSE answer END) AS digest FROM runs")
def cleaned_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers as model servers leave them (a third spelt in byte letters, a third after their thinking) and cleaned again."""
    r = V.runs(spark, sf_dir)
    kind = F.col("run_idx") % 3
    spelt = F.when(kind == 1, T.as_byte_letters(F.col("answer"))).when(kind == 2, F.concat(F.lit("<think>is it so? </think> so </think>\n"), "answer")).otherwise(F.col("answer"))
    back = T.without_byte_letters(F.col("s"))
    return r.withColumn("s", spelt).select(*CELL, "run_idx", F.md5(F.when(kind == 2, T.cleaned_response(F.col("s"))).otherwise(back)).alias("digest"))
