"""Readers for experiment files: nested JSON, JSON lines, ground truth, QA records, detector tables, sidecars."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed schemas of the files.
DATASET = "question string, references array<struct<url:string,text:string>>"
_DOC = "struct<doc_id:string,document_id:string,iteration:int,url:string,title:string,text:string,gold:boolean,distractor:boolean>"
_RUN = "struct<run_id:string,answer:string,citation_ids:array<int>,citations:array<struct<citation_id:int,doc_id:string,url:string,iteration:int>>,side_answer:string,tool_calls_used:int>"
EXPERIMENT = f"questions array<struct<question_id:long,query_id:string,question_text:string,iterations:array<struct<iteration_number:int,documents:array<{_DOC}>,runs:array<{_RUN}>>>>>"
EVALUATION = "questions array<struct<question_id:string,iterations:array<struct<iteration_number:int,metrics:map<string,double>>>>>"
SIDECAR = "map<string,map<string,map<string,array<string>>>>"
QA = "_id string, question string, answer string, type string, level string, supporting_facts string, context string"


def dataset_lines(spark: SparkSession, path: str) -> DataFrame:
    """One question a line; blank lines are skipped, a malformed one fails the read."""
    return spark.read.schema(DATASET).option("mode", "FAILFAST").json(path)


def dataset_array(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(DATASET).option("multiLine", True).option("mode", "FAILFAST").json(path)


def with_references(df: DataFrame, least: int = 5, most: int = 10) -> DataFrame:
    """Questions with references enough, cut to the first `most`."""
    refs = F.coalesce("references", F.array().cast("array<struct<url:string,text:string>>"))
    return df.where(F.size(refs) >= least).withColumn("references", F.slice(refs, 1, most))


def experiment(spark: SparkSession, path: str) -> DataFrame:
    """One row a question and round, with its documents and runs still nested; files in name order give shard numbers."""
    raw = spark.read.schema(EXPERIMENT).option("multiLine", True).json(path).select(F.explode("questions").alias("q"), F.col("_metadata.file_path").alias("file"))
    return raw.select("file", "q.question_id", "q.query_id", "q.question_text", F.explode_outer("q.iterations").alias("i")).select("file", "question_id", "query_id", "question_text", "i.*")


def experiment_documents(rounds: DataFrame) -> DataFrame:
    """Documents with their slots; older files say document_id."""
    d = rounds.select("question_id", "iteration_number", F.posexplode("documents").alias("slot", "d")).select("question_id", "iteration_number", "slot", "d.*")
    return d.withColumn("doc_id", F.coalesce("doc_id", "document_id")).drop("document_id")


def experiment_runs(rounds: DataFrame) -> DataFrame:
    return rounds.select("question_id", "iteration_number", F.posexplode("runs").alias("run_idx", "r")).select("question_id", "iteration_number", "run_idx", "r.*")


def experiment_citations(runs: DataFrame) -> DataFrame:
    """Cited documents of every run: ids looked up in the run's own index, unknown ones dropped, order kept."""
    index = F.map_from_entries(F.transform(F.col("citations"), lambda c: F.struct(c["citation_id"], c["doc_id"])))
    ids = runs.select("question_id", "iteration_number", "run_idx", F.posexplode("citation_ids").alias("pos", "citation_id"), index.alias("m"))
    return ids.select("question_id", "iteration_number", "run_idx", "pos", "citation_id", F.try_element_at("m", F.col("citation_id")).alias("doc_id")).where("doc_id is not null")


def evaluation(spark: SparkSession, path: str) -> DataFrame:
    """question_id (long), iteration_number, metrics; ids there are written q0, q1, ..."""
    return numbered(spark.read.schema(EVALUATION).option("multiLine", True).json(path).select(F.explode("questions").alias("q")).select("q.question_id", F.explode("q.iterations").alias("i")))


def numbered(q: DataFrame) -> DataFrame:
    return q.select(F.regexp_extract("question_id", r"(\d+)$", 1).cast("long").alias("question_id"), "i.*")


def ground_truth(spark: SparkSession, path: str) -> DataFrame:
    """query_id, answer from a list of {_id, answer} or one flat map."""
    raw = spark.read.text(path, wholetext=True)
    items = F.from_json("value", "array<struct<_id:string,answer:string>>")
    pairs = F.from_json("value", "map<string,string>")
    is_list = F.ltrim("value").startswith("[")
    lists = raw.where(is_list).select(F.explode(items).alias("x")).select(F.col("x._id").alias("query_id"), "x.answer")
    return lists.unionByName(raw.where(~is_list).select(F.explode(pairs).alias("query_id", "answer")))


def qa_records(spark: SparkSession, path: str) -> DataFrame:
    """Native QA records, their positional lists turned into structs."""
    return _structs(spark.read.schema(QA).option("multiLine", True).json(path))


def qa_lines(spark: SparkSession, path: str) -> DataFrame:
    """The same with one record a line."""
    return _structs(spark.read.schema(QA).json(path))


def _structs(raw: DataFrame) -> DataFrame:
    facts = F.transform(F.from_json("supporting_facts", "array<array<string>>"), lambda p: F.struct(p[0].alias("title"), p[1].cast("int").alias("sent_id")))
    titles = F.transform(F.from_json("context", "array<array<string>>"), lambda p: F.struct(p[0].alias("title"), F.from_json(p[1], "array<string>").alias("sentences")))
    return raw.withColumn("supporting_facts", facts).withColumn("context", titles)


def native_documents(records: DataFrame, gold_only: bool = False) -> DataFrame:
    """A record's paragraphs as documents; gold if their title supports the answer."""
    titles = F.transform("supporting_facts", lambda f: f["title"])
    d = records.select(F.col("_id").alias("query_id"), titles.alias("t"), F.posexplode("context").alias("slot", "c"))
    d = d.select("query_id", F.concat(F.lit("native_"), F.col("slot")).alias("doc_id"), "slot", "c.title", F.array_join("c.sentences", " ").alias("text"), F.array_contains("t", F.col("c.title")).alias("gold"))
    return d.where("gold") if gold_only else d


def parallel_lists(df: DataFrame) -> DataFrame:
    """Records whose facts and context are parallel lists, as lists of structs."""
    return df.withColumn("supporting_facts", F.arrays_zip(F.col("supporting_facts.title").alias("title"), F.col("supporting_facts.sent_id").alias("sent_id"))).withColumn("context", F.arrays_zip(F.col("context.title").alias("title"), F.col("context.sentences").alias("sentences")))


def detector_labels(spark: SparkSession, path: str, batch: str | None = None, order: str | None = None) -> DataFrame:
    """Detector table: url (either of two columns) -> label; of several labels of a key the last one by the column `order` (without it, by the lines of the files)."""
    from loopscope.functions.text import url_key

    t = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    place = F.col(order).cast("double") if order else F.monotonically_increasing_id()
    t = t.select("*", place.alias("_place"))
    t = t.where(F.col("batch") == batch) if batch else t
    t = t.select("_place", F.posexplode(F.array("URL", "citation_url")).alias("_pos", "url"), F.col("Content type [gptzero]").alias("label")).where("url is not null")
    return t.groupBy(url_key(F.col("url")).alias("key")).agg(F.max_by("label", F.struct("_place", "_pos")).alias("label"))


def sidecar(spark: SparkSession, path: str) -> DataFrame:
    """question_id, round, run_id, doc_id from nested maps."""
    m = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", SIDECAR)).alias("q", "m"))
    m = m.select("q", F.explode("m").alias("round", "m")).select("q", "round", F.explode("m").alias("run_id", "d"))
    return m.select(F.col("q").cast("long").alias("question_id"), F.col("round").cast("int").alias("round"), "run_id", F.explode("d").alias("doc_id"))


def events(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def arms(df: DataFrame) -> DataFrame:
    """Arm of a sweep from file names ending in _f<fraction>.json or _t<topics>.json."""
    name = F.element_at(F.split("file", "/"), -1)
    return df.withColumn("fraction", F.nullif(F.regexp_extract(name, r"_f([0-9.]+)\.json$", 1), F.lit("")).cast("double")).withColumn("topics", F.nullif(F.regexp_extract(name, r"_t(\d+)\.json$", 1), F.lit("")).cast("int"))


def missing(expected: DataFrame, present: DataFrame, keys: list[str]) -> DataFrame:
    return expected.join(present, keys, "left_anti")
