"""The round loop: retrieve, answer, rewrite, put back; with a pluggable generator in place of a model."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loopscope.functions import stats
from loopscope.functions import text as T
from loopscope.operators.retrieval import top_k
from loopscope.plans import views as V
from loopscope.plans.lineage import folder, release, stored
from loopscope.plans.registry import n, query, r6

#: Rounds of each variant, and documents retrieved.
ROUNDS = {"replace_all": 10, "replace_one": 20, "search": 30, "agentic_rag": 30}
TOP = 5
#: A question whose answers have equal signatures in so many consecutive rounds leaves the loop.
EQUAL_ROUNDS = 4
#: A generator turns (question_id, run_idx, question_text, context array<string>) into the same keys and `answer`.
Generator = Callable[[DataFrame], DataFrame]


def extractive(rows: DataFrame) -> DataFrame:
    """The default generator: the first sentence of a context document chosen by run, so runs differ and reruns agree."""
    pick = F.element_at("context", (F.pmod(F.col("run_idx"), F.greatest(F.size("context"), F.lit(1))) + 1).cast("int"))
    return rows.withColumn("answer", F.when(F.size("context") > 0, F.coalesce(F.try_element_at(T.sentences(pick), F.lit(1)), F.lit(""))).otherwise(F.lit("")))


def calls(text: Column, most: int = 0) -> Column:
    """What a question is looked up by: itself, and for an agent up to `most` names in it as further calls."""
    names = F.slice(F.array_distinct(F.regexp_extract_all(text, F.lit(V.ENTITY), F.lit(0))), 1, most) if most else F.array().cast("array<string>")
    return F.transform(F.concat(F.array(text), names), lambda c: F.array_distinct(T.rouge_tokens(c)))


def scored(store: DataFrame, questions: DataFrame, penalty: float = 0.0) -> DataFrame:
    """Documents of a store by lexical relevance to each call of their question (`calls`), less a penalty for generated ones: an equi-join by question."""
    q = questions.select("*", F.size("calls").alias("n_calls"), F.posexplode("calls").alias("call", "q")).drop("calls")
    return store.join(q, "question_id").withColumn("score", F.round(T.share(F.size(F.array_intersect("q", "d")), F.size("q")) * (1 - penalty * F.col("is_ai").cast("int")), 9))


def together(found: DataFrame) -> DataFrame:
    """What the calls of a question have found: a document counts once, with its best score."""
    best = top_k(found, ["question_id", "doc"], 1, "score", "call").drop("rank")
    return best.withColumn("rank", F.row_number().over(Window.partitionBy("question_id").orderBy(F.desc("score"), "doc")))


def retrieve(store: DataFrame, questions: DataFrame, k: int, penalty: float = 0.0) -> DataFrame:
    """The k best documents of each call of each question."""
    return together(top_k(scored(store, questions, penalty), ["question_id", "call"], k, "score", "doc").drop("rank"))


class Best:
    """The k best documents of each call of each question, texts included, kept while a store grows.

    A new document is scored once and meets the k that are kept: the k best of all are among the k best before and the new
    ones. So a round reads what is new and k rows a call, never the store, which is appended to and never rewritten.
    """

    def __init__(self, store: DataFrame, questions: DataFrame, k: int, penalty: float = 0.0):
        self.k, self.penalty = k, penalty
        self.columns = ["question_id", "question_text", "call", "doc", "is_ai", "text", "score", "n_calls"]
        self.rows = stored(self._top(scored(store, questions, penalty).select(self.columns)))

    def _top(self, rows: DataFrame) -> DataFrame:
        return top_k(rows, ["question_id", "call"], self.k, "score", "doc").drop("rank")

    def add(self, new: DataFrame, questions: DataFrame) -> None:
        """Let new documents in; of questions that are not among these nothing is kept."""
        old = self.rows
        both = old.join(questions.select("question_id"), "question_id", "left_semi").select(self.columns).unionByName(scored(new, questions, self.penalty).select(self.columns))
        self.rows = stored(self._top(both))
        release(old)


class Store:
    """Documents that rounds have added, a folder a round; nothing is rewritten, and a loop never reads it back."""

    def __init__(self, spark: SparkSession):
        self.spark, self.path, self.schema = spark, f"{folder(spark)}/loopscope/store-{uuid.uuid4().hex}", None

    def append(self, new: DataFrame, r: int) -> DataFrame:
        """Write a round's documents and give them back as they were written."""
        at = f"{self.path}/round={r}"
        new.write.parquet(at)
        self.schema = new.schema
        return self.spark.read.schema(new.schema).parquet(at)

    def documents(self) -> DataFrame | None:
        """All that rounds have added, with their round."""
        return self.schema and self.spark.read.schema(self.schema.add("round", "int")).parquet(self.path)


#: A writer turns a question's and an answer's column into the text of a document; by default the answer itself.
Writer = Callable[[Column, Column], Column]


def as_it_is(question: Column, answer: Column) -> Column:
    return answer


def on_the_question(question: Column, answer: Column) -> Column:
    """A deterministic stand-in for a model that writes documents: the answer under its question."""
    return F.concat(F.lit("On the question "), F.regexp_replace(question, r"\?+$", ""), F.lit(": "), answer)


def paraphrased(docs: DataFrame, write: Writer, question: str = "question_text", text: str = "text") -> DataFrame:
    """References in the style of the documents to come: every text that is not blank goes through the writer before round 0; blank and null ones stay."""
    blank = F.coalesce(F.trim(F.regexp_replace(text, r"\s+", " ")) == "", F.lit(True))
    return docs.withColumn(text, F.when(blank, F.col(text)).otherwise(write(F.col(question), F.col(text))))


def ask(contexts: DataFrame, runs: int, generate: Generator, r: int, side: Generator | None = None, write: Writer = as_it_is) -> DataFrame:
    """Answers of a round from contexts (question_id, question_text, context and columns to keep as `kept`): one row a question with the document of the drawn answer, the documents of all, and the answers' signature.

    With a side generator, documents are written from its answers to the same contexts, and the main one's are only
    measured: k and sig are always the main one's.
    """
    rows = generate(contexts.withColumn("run_idx", F.explode(F.sequence(F.lit(0), F.lit(runs - 1)))))
    rows = (side(rows.withColumnRenamed("answer", "main")) if side else rows.withColumn("main", F.col("answer"))).withColumn("answer", write(F.col("question_text"), F.col("answer")))
    drawn = stats.keyed_order(F.lit(17), F.lit(r), F.col("question_id"), F.col("run_idx"))
    return rows.groupBy("question_id").agg(F.min_by("answer", drawn).alias("answer"), F.array_sort(F.collect_list(F.struct("run_idx", "answer"))).alias("answers"), F.countDistinct("main").alias("k"), F.max("kept").alias("kept"), F.array_sort(F.collect_list(F.length("main"))).alias("sig"))


def still_open(questions: DataFrame, per: DataFrame, last: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """Questions without EQUAL_ROUNDS equal signatures in a row, and each one's signature and how often it has come."""
    same = per.select("question_id", "sig").withColumn("times", F.lit(1))
    if last is not None:
        before = last.select("question_id", F.col("sig").alias("old"), F.col("times").alias("had"))
        same = same.join(before, "question_id", "left").select("question_id", "sig", F.when(F.col("sig") == F.col("old"), F.col("had") + 1).otherwise(F.lit(1)).alias("times"))
    last, before = stored(same), last
    release(before)
    return stored(questions.join(last.where(F.col("times") >= EQUAL_ROUNDS).select("question_id"), "question_id", "left_anti")), last


def search_rounds(store: DataFrame, questions: DataFrame, rounds: int, runs: int = 3, k: int = TOP, penalty: float = 0.0, names: int = 0, generate: Generator = extractive, side: Generator | None = None, write: Writer = as_it_is) -> DataFrame:
    """question_id, round, ai_share, n_answers, mean relevance and tool calls of every round.

    Each round retrieves (for an agent by several calls), lets `runs` runs answer, draws one answer by keyed hash, and
    appends it to the store as a generated document. Questions with EQUAL_ROUNDS equal signatures (sorted answer
    lengths) in a row leave the loop. Only a round's new documents are scored; they meet the k best that are kept. What a
    round leaves is written down, so plans stay as long as one round.
    """
    questions = stored(questions.select("question_id", "question_text", calls(F.col("question_text"), names).alias("calls")))
    words = lambda c: F.array_distinct(T.rouge_tokens(F.col(c))).alias("d")
    best = Best(store.select("question_id", "doc", "is_ai", "text", words("text")), questions, k, penalty)
    added, report, last = Store(store.sparkSession), None, None
    for r in range(1, rounds + 1):
        got = together(best.rows)
        ctx = got.groupBy("question_id", "question_text").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda x: x["text"]).alias("context"), F.struct(F.avg(F.col("is_ai").cast("int")).alias("ai"), F.avg("score").alias("rel"), F.max("n_calls").alias("calls")).alias("kept"))
        per = stored(ask(ctx, runs, generate, r, side, write))
        rows = per.select("question_id", F.lit(r).alias("round"), "kept.ai", "k", "kept.rel", "kept.calls")
        report = rows if report is None else report.unionByName(rows)
        new = added.append(per.select("question_id", F.lit(-r).cast("long").alias("doc"), F.lit(True).alias("is_ai"), F.col("answer").alias("text"), words("answer")), r)
        before = questions
        questions, last = still_open(questions, per, last)
        if questions.isEmpty():
            break
        best.add(new, questions)
        release(before)
    return report.select("question_id", n(F.col("round"), "round"), r6("ai", "ai_share"), n(F.col("k"), "n_answers"), r6("rel", "mean_relevance"), n(F.col("calls"), "tool_calls"))


def replace_rounds(context: DataFrame, questions: DataFrame, rounds: int, variant: str, runs: int = 3, num_db: int = 0, generate: Generator = extractive, side: Generator | None = None, write: Writer = as_it_is) -> DataFrame:
    """question_id, round, ai_share, n_answers and a digest of the context of every round, for contexts (question_id, slot, is_ai, text) that change in place.

    replace_all: the next context is every run's answer, and then the first `num_db` references. replace_one: the slot
    numbered round modulo the number of slots (rounds from 0) gets one answer, drawn by keyed hash. Questions with
    EQUAL_ROUNDS equal signatures in a row leave the loop; contexts are written down each round.
    """
    item = F.struct("slot", "is_ai", "text")
    first = context.groupBy("question_id").agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: F.struct(x["is_ai"].alias("is_ai"), x["text"].alias("text"))).alias("docs"))
    now = stored(questions.select("question_id", "question_text").join(first, "question_id").withColumn("refs", F.slice("docs", 1, max(num_db, 0)) if num_db > 0 else F.slice("docs", 1, 0)))
    report, last = None, None
    made = lambda t: F.struct(F.lit(True).alias("is_ai"), t.alias("text"))
    for r in range(rounds):
        ctx = now.select("question_id", "question_text", F.transform("docs", lambda x: x["text"]).alias("context"), F.struct(F.aggregate("docs", F.lit(0), lambda s, x: s + x["is_ai"].cast("int")).alias("ai"), F.size("docs").alias("n"), F.md5(F.array_join(F.transform("docs", lambda x: x["text"]), "\n")).alias("digest")).alias("kept"))
        per = stored(ask(ctx, runs, generate, r, side, write))
        rows = per.select("question_id", F.lit(r).alias("round"), F.try_divide("kept.ai", "kept.n").alias("ai"), "k", "kept.digest")
        report = rows if report is None else report.unionByName(rows)
        if variant == "replace_all":
            docs = F.concat(F.transform("answers", lambda x: made(x["answer"])), "refs")
        else:
            docs = F.transform("docs", lambda x, i: F.when(i == F.pmod(F.lit(r), F.size("docs")), made(F.col("answer"))).otherwise(x))
        now = now.join(per.select("question_id", "answer", "answers"), "question_id").select("question_id", "question_text", docs.alias("docs"), "refs")
        now, last = still_open(now, per, last)
        if now.isEmpty():
            break
    return report.select("question_id", n(F.col("round"), "round"), r6("ai", "ai_share"), n(F.col("k"), "n_answers"), "digest")


def _start(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    store = V.context_docs(spark, sf_dir).select("question_id", F.col("row_id").alias("doc"), "is_ai", "text")
    return store, V.questions(spark, sf_dir)


@query()
def search_loop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search_rounds(*_start(spark, sf_dir), rounds=ROUNDS["search"])


@query()
def rerank_loop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with generated documents penalised in retrieval."""
    return search_rounds(*_start(spark, sf_dir), rounds=ROUNDS["search"], penalty=0.7)


@query()
def agentic_loop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with several lookups for each question."""
    return search_rounds(*_start(spark, sf_dir), rounds=ROUNDS["agentic_rag"], names=2)


def _first_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.context_docs(spark, sf_dir).where("iteration_number = 1").select("question_id", "slot", "is_ai", "text")


@query()
def replace_all_loop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contexts that consist of the last round's answers."""
    return replace_rounds(_first_contexts(spark, sf_dir), V.questions(spark, sf_dir), ROUNDS["replace_all"], "replace_all")


@query()
def replace_one_loop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contexts in which one document a round gives way to an answer."""
    return replace_rounds(_first_contexts(spark, sf_dir), V.questions(spark, sf_dir), ROUNDS["replace_one"], "replace_one")


def last_words(rows: DataFrame) -> DataFrame:
    """Another deterministic generator: the last sentence of a document chosen by run, from the end of the context."""
    pick = F.element_at("context", (-1 - F.pmod(F.col("run_idx"), F.greatest(F.size("context"), F.lit(1)))).cast("int"))
    return rows.withColumn("answer", F.when(F.size("context") > 0, F.coalesce(F.try_element_at(T.sentences(pick), F.lit(-1)), F.lit(""))).otherwise(F.lit("")))


@query()
def side_writer_loop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contexts that consist of another generator's answers to the same contexts, over paraphrased references: the main generator is measured, the side one writes."""
    q = V.questions(spark, sf_dir)
    refs = paraphrased(_first_contexts(spark, sf_dir).join(q, "question_id"), on_the_question).drop("question_text")
    return replace_rounds(refs, q, ROUNDS["replace_all"], "replace_all", side=last_words, write=on_the_question)


@query(f"WITH {V.DOCS}, {V.QUESTIONS} SELECT question_id, row_id, md5(CASE WHEN coalesce(trim(regexp_replace(text, '\\s+', ' ', 'g')) = '', true) THEN text ELSE 'On the question ' || regexp_replace(question_text, '\\?+$', '') || ': ' || text END) AS digest FROM docs JOIN questions USING (question_id) WHERE iteration_number = 1")
def paraphrased_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The references of round 1 as the document writer puts them."""
    d = V.context_docs(spark, sf_dir).where("iteration_number = 1").select("question_id", "row_id", "text").join(V.questions(spark, sf_dir), "question_id")
    return paraphrased(d, on_the_question).select("question_id", "row_id", F.md5("text").alias("digest"))


_TOK = "regexp_extract_all(lower({}), '[a-z0-9]+')"


@query(f"WITH {V.DOCS}, {V.QUESTIONS}, s AS (SELECT question_id, row_id, is_ai, round({V.sql_share('len(list_intersect(list_distinct(' + _TOK.format('question_text') + '), list_distinct(' + _TOK.format('text') + ')))', 'len(list_distinct(' + _TOK.format('question_text') + '))')}, 9) AS score FROM docs JOIN questions USING (question_id)) SELECT question_id, row_id, round(score, 6) AS score, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, row_id) AS rank FROM s QUALIFY rank <= 5")
def lexical_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One retrieval step of the loop."""
    store, questions = _start(spark, sf_dir)
    q = questions.select("question_id", calls(F.col("question_text")).alias("calls"))
    got = retrieve(store.withColumn("d", F.array_distinct(T.rouge_tokens(F.col("text")))), q, 5)
    return got.select("question_id", F.col("doc").alias("row_id"), r6("score", "score"), n(F.col("rank"), "rank"))


@query(f"WITH {V.RUNS}, l AS (SELECT question_id, iteration_number, run_idx, answer, row_number() OVER (PARTITION BY question_id, iteration_number ORDER BY md5(concat_ws('|', 17, question_id, iteration_number, run_idx)), run_idx) AS k FROM runs) SELECT question_id, iteration_number, run_idx, md5(answer) AS digest FROM l WHERE k = 1")
def random_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The answer that becomes a document: one a round, drawn by keyed hash."""
    w = Window.partitionBy("question_id", "iteration_number").orderBy(stats.keyed_order(F.lit(17), F.col("question_id"), F.col("iteration_number"), F.col("run_idx")), "run_idx")
    r = V.runs(spark, sf_dir).withColumn("k", F.row_number().over(w)).where("k = 1")
    return r.select("question_id", "iteration_number", "run_idx", F.md5("answer").alias("digest"))
