"""Documents with ids, selections, and the conversations that generators are asked with."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loopscope.functions import stats
from loopscope.functions import text as T
from loopscope.operators.names import occurring
from loopscope.plans import views as V
from loopscope.plans.registry import n, query, r6

CELL = ["question_id", "iteration_number"]
#: Wording of our own.
RAG_SYSTEM = "Answer from the given contexts alone. Give the answer as plain text."
DOCUMENT_SYSTEM = "Write a short article that states the given answer."
JUDGE_SYSTEM = "Do the two answers say the same? Reply yes or no."
AGENT_SYSTEM = "Look up what the question needs with the retrieve tool, one call for each part, then answer."

#: References of questions: the pages of a dozen neighbours.
_REFS = "pq AS (SELECT page_id // 12 AS question_id, page_id, url, html AS text, row_number() OVER (PARTITION BY page_id // 12 ORDER BY page_id) - 1 AS i, count(*) OVER (PARTITION BY page_id // 12) AS k FROM pages), refs AS (SELECT * FROM pq WHERE k >= 5 AND i < 10)"


def references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """question_id and up to ten references (url, text) of questions that have five or more, in order."""
    p = V.table(spark, sf_dir, "pages").select(F.expr("page_id div 12").alias("question_id"), "page_id", F.struct("url", F.col("html").alias("text")).alias("r"))
    q = p.groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("page_id", "r"))).alias("l"))
    return q.where(F.size("l") >= 5).select("question_id", F.slice(F.transform("l", lambda x: x["r"]), 1, 10).alias("references"))


def reference_documents(refs: DataFrame, iteration: int = 0) -> DataFrame:
    """References as documents: ref_<iteration>_<place>; a missing url or text is empty."""
    d = refs.select("question_id", F.posexplode("references").alias("slot", "r"))
    return d.select("question_id", F.concat_ws("_", F.lit("ref"), F.lit(iteration), "slot").alias("doc_id"), F.lit(iteration).alias("iteration"), n(F.col("slot"), "slot"), F.coalesce("r.url", F.lit("")).alias("url"), F.coalesce("r.text", F.lit("")).alias("text"))


def answer_documents(answers: DataFrame, place: str = "run_idx") -> DataFrame:
    """Answers (question_id, iteration_number, answer) as documents of their round: gen_<round>_<place>, with the url of generated text."""
    i = F.row_number().over(Window.partitionBy(*CELL).orderBy(place)) - 1
    return answers.select("question_id", F.concat_ws("_", F.lit("gen"), "iteration_number", i).alias("doc_id"), F.col("iteration_number").alias("iteration"), n(i, "slot"), F.lit(T.AI_URL).alias("url"), F.col("answer").alias("text"))


@query(f"WITH {_REFS} SELECT question_id, concat_ws('_', 'ref', 0, i) AS doc_id, i AS slot, url, md5(text) AS digest FROM refs")
def documents_from_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reference_documents(references(spark, sf_dir)).select("question_id", "doc_id", "slot", "url", F.md5("text").alias("digest"))


@query(f"WITH {V.RUNS}, o AS (SELECT *, row_number() OVER (PARTITION BY question_id, iteration_number ORDER BY run_idx) - 1 AS i FROM runs) SELECT question_id, concat_ws('_', 'gen', iteration_number, i) AS doc_id, iteration_number AS iteration, i AS slot, 'model_generated' AS url, md5(answer) AS digest FROM o")
def documents_from_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answer_documents(V.runs(spark, sf_dir)).select("question_id", "doc_id", "iteration", "slot", "url", F.md5("text").alias("digest"))


@query(f"WITH {_REFS}, {V.RUNS}, g AS (SELECT question_id, arg_min(answer, (iteration_number, run_idx)) AS t FROM runs GROUP BY 1) SELECT question_id, 1::BIGINT AS n_references, 'model_generated' AS url, md5(t) AS digest, any_value(k) AS n_original FROM (SELECT question_id, count(*) AS k FROM refs GROUP BY 1) JOIN g USING (question_id) GROUP BY ALL")
def injected_example(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A question whose references are replaced by one generated text; the originals are kept beside."""
    g = V.runs(spark, sf_dir).groupBy("question_id").agg(F.min_by("answer", F.struct("iteration_number", "run_idx")).alias("t"))
    e = references(spark, sf_dir).join(g, "question_id").select("question_id", F.array(F.struct(F.lit(T.AI_URL).alias("url"), F.col("t").alias("text"))).alias("references"), F.col("references").alias("original_references"))
    return e.select("question_id", n(F.size("references"), "n_references"), F.col("references")[0]["url"].alias("url"), F.md5(F.col("references")[0]["text"]).alias("digest"), n(F.size("original_references"), "n_original"))


@query(f"WITH {V.DOCS}, r AS (SELECT *, row_number() OVER (PARTITION BY question_id, iteration_number ORDER BY slot) AS a, row_number() OVER (PARTITION BY question_id, iteration_number ORDER BY md5(concat_ws('|', 13, row_id)), row_id) AS b FROM docs) SELECT 'first' AS mode, question_id, iteration_number, row_id FROM r WHERE a <= 3 UNION ALL SELECT 'random', question_id, iteration_number, row_id FROM r WHERE b <= 3")
def selected_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three documents of each context: the first ones, and three at random by a keyed hash."""
    d = V.context_docs(spark, sf_dir).select(*CELL, "slot", "row_id")
    return select_k(d, CELL, 3, "first", "slot").select(F.lit("first").alias("mode"), *CELL, "row_id").union(select_k(d, CELL, 3, "random", "slot").select(F.lit("random"), *CELL, "row_id"))


def select_k(docs: DataFrame, keys: list[str], k: int, mode: str, place: str, seed: int = 13) -> DataFrame:
    """k rows of each key, in order of place or by a keyed hash; none for k of 0 or less."""
    order = [F.col(place)] if mode == "first" else [stats.keyed_order(F.lit(seed), F.col("row_id")), F.col("row_id")]
    return docs.withColumn("k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("k") <= max(k, 0)).drop("k")


@query(f"WITH {V.DOCS}, s AS (SELECT * FROM docs WHERE is_ai), r AS (SELECT * FROM docs WHERE NOT is_ai) SELECT question_id, iteration_number, 0 AS num_db, row_id FROM r UNION ALL SELECT question_id, iteration_number, 2, row_id FROM r QUALIFY row_number() OVER (PARTITION BY question_id, iteration_number ORDER BY slot) <= 2")
def first_round_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Context of the first round: without database documents to come all references, else so many of them."""
    r = V.context_docs(spark, sf_dir).where("not is_ai").select(*CELL, "slot", "row_id")
    start = lambda m: (select_k(r, CELL, m, "first", "slot") if m else r).select(*CELL, F.lit(m).alias("num_db"), "row_id")
    return start(0).union(start(2))


@query("SELECT question_id, md5(question_text) AS digest FROM (SELECT * FROM questions_ ORDER BY question_id LIMIT 3)".replace("questions_", f"(WITH {V.QUESTIONS} SELECT * FROM questions)"))
def question_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three questions."""
    return V.questions(spark, sf_dir).orderBy("question_id").limit(3).select("question_id", F.md5("question_text").alias("digest"))


@query(f"WITH {V.DOCS} SELECT row_id, CAST(length(substring(text, 1, 400)) AS BIGINT) AS n_chars, md5(substring(text, 1, 400)) AS digest FROM docs")
def truncated_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts cut to the 400 characters that a prompt gives each document."""
    t = F.substring("text", 1, 400)
    return V.context_docs(spark, sf_dir).select("row_id", n(F.length(t), "n_chars"), F.md5(t).alias("digest"))


@query(f"WITH {V.RUNS}, {V.DOCS} SELECT r.question_id, r.iteration_number, run_idx, row_id, row_number() OVER (PARTITION BY r.question_id, r.iteration_number, run_idx ORDER BY md5(concat_ws('|', 19, r.question_id, r.iteration_number, run_idx, row_id)), row_id) AS place FROM runs r JOIN docs d ON r.question_id = d.question_id AND r.iteration_number = d.iteration_number")
def shuffled_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each run's own order of its context: a permutation that changes with question, round and run, and not from one call to the next."""
    j = V.runs(spark, sf_dir).select(*CELL, "run_idx").join(V.context_docs(spark, sf_dir).select(*CELL, "row_id"), CELL)
    key = stats.keyed_order(F.lit(19), F.col("question_id"), F.col("iteration_number"), F.col("run_idx"), F.col("row_id"))
    w = Window.partitionBy(*CELL, "run_idx").orderBy(key, "row_id")
    return j.select(*CELL, "run_idx", "row_id", n(F.row_number().over(w), "place"))


def message(role: str, content: Column | str) -> Column:
    return F.struct(F.lit(role).alias("role"), (F.lit(content) if isinstance(content, str) else content).alias("content"))


def numbered(docs: DataFrame, label: Column, separator: str, keys: list[str], chars: int) -> DataFrame:
    """A prompt's contexts as one string: places are counted over all documents, empty texts are left out."""
    d = docs.withColumn("pos", F.row_number().over(Window.partitionBy(*keys).orderBy("slot"))).withColumn("t", F.substring("text", 1, chars))
    parts = F.array_sort(F.collect_list(F.when(F.col("t") != "", F.struct("pos", F.concat(label, F.col("t")).alias("s")))))
    return d.groupBy(*keys).agg(F.array_join(F.transform(parts, lambda x: x["s"]), separator).alias("contexts"))


def rag_conversation(contexts: Column, question: Column) -> Column:
    """What a generator is asked: a system message, and contexts and question."""
    return F.array(message("system", RAG_SYSTEM), message("user", F.concat(F.lit("Contexts:\n"), contexts, F.lit("\n\nQuestion: "), question)))


def flat(conversation: Column) -> Column:
    return F.array_join(F.transform(conversation, lambda m: F.concat(m["role"], F.lit(": "), m["content"])), "\n")


@query(f"WITH {V.DOCS}, {V.QUESTIONS}, o AS (SELECT question_id, iteration_number, row_number() OVER (PARTITION BY question_id, iteration_number ORDER BY slot) AS pos, substring(text, 1, 400) AS t FROM docs), c AS (SELECT question_id, iteration_number, coalesce(string_agg('Context ' || pos || ':' || chr(10) || t, chr(10) || chr(10) ORDER BY pos) FILTER (t <> ''), '') AS c FROM o GROUP BY ALL) SELECT question_id, iteration_number, 2::BIGINT AS n_messages, md5('system: {RAG_SYSTEM}' || chr(10) || 'user: Contexts:' || chr(10) || c || chr(10) || chr(10) || 'Question: ' || question_text) AS digest FROM c JOIN questions USING (question_id)")
def rag_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.concat(F.lit("Context "), F.col("pos").cast("string"), F.lit(":\n"))
    c = numbered(V.context_docs(spark, sf_dir), label, "\n\n", CELL, 400).join(V.questions(spark, sf_dir), "question_id").withColumn("c", rag_conversation(F.col("contexts"), F.col("question_text")))
    return c.select(*CELL, n(F.size("c"), "n_messages"), F.md5(flat(F.col("c"))).alias("digest"))


@query(f"WITH {V.DOCS}, {V.QUESTIONS}, o AS (SELECT question_id, iteration_number, row_number() OVER (PARTITION BY question_id, iteration_number ORDER BY slot) AS pos, substring(text, 1, 300) AS t FROM docs), c AS (SELECT question_id, iteration_number, coalesce(string_agg('[' || pos || '] ' || t, chr(10) ORDER BY pos) FILTER (t <> ''), '') AS c FROM o GROUP BY ALL) SELECT question_id, iteration_number, md5('Sources:' || chr(10) || c || chr(10) || 'Question: ' || question_text || chr(10) || 'End with CITED: [numbers].') AS digest FROM c JOIN questions USING (question_id)")
def elicitation_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbered sources and the request to name those that the answer rests on."""
    label = F.concat(F.lit("["), F.col("pos").cast("string"), F.lit("] "))
    c = numbered(V.context_docs(spark, sf_dir), label, "\n", CELL, 300).join(V.questions(spark, sf_dir), "question_id")
    return c.select(*CELL, F.md5(F.concat(F.lit("Sources:\n"), "contexts", F.lit("\nQuestion: "), "question_text", F.lit("\nEnd with CITED: [numbers]."))).alias("digest"))


@query(f"WITH {V.RUNS}, {V.QUESTIONS}, p AS (SELECT question_id, iteration_number, run_idx, 'system: {DOCUMENT_SYSTEM}' || chr(10) || 'user: Question: ' || question_text || chr(10) || 'Answer: ' || answer AS a, 'system: {AGENT_SYSTEM}' || chr(10) || 'user: Question: ' || question_text AS b FROM runs JOIN questions USING (question_id)) SELECT question_id, iteration_number, run_idx, md5(a) AS document_prompt, md5(b) AS agent_prompt FROM p")
def document_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The conversations that turn an answer into a document, and that start an agent, which is given no documents."""
    q = F.concat(F.lit("Question: "), "question_text")
    r = V.runs(spark, sf_dir).join(V.questions(spark, sf_dir), "question_id")
    doc = F.array(message("system", DOCUMENT_SYSTEM), message("user", F.concat(q, F.lit("\nAnswer: "), F.col("answer"))))
    return r.select(*CELL, "run_idx", F.md5(flat(doc)).alias("document_prompt"), F.md5(flat(F.array(message("system", AGENT_SYSTEM), message("user", q)))).alias("agent_prompt"))


@query(f"WITH {V.RUNS} SELECT a.question_id, a.iteration_number, a.run_idx AS run_a, b.run_idx AS run_b, md5('system: {JUDGE_SYSTEM}' || chr(10) || 'user: A: ' || a.answer || chr(10) || 'B: ' || b.answer) AS digest FROM runs a JOIN runs b ON a.question_id = b.question_id AND a.iteration_number = b.iteration_number AND a.run_idx < b.run_idx")
def judge_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The conversations that ask whether two answers agree."""
    p = V.pairs(V.runs(spark, sf_dir), *CELL)
    c = F.array(message("system", JUDGE_SYSTEM), message("user", F.concat(F.lit("A: "), F.col("answer_a"), F.lit("\nB: "), F.col("answer_b"))))
    return p.select(*CELL, F.col("run_idx_a").alias("run_a"), F.col("run_idx_b").alias("run_b"), F.md5(flat(c)).alias("digest"))


@query(f"WITH {V.RUNS} SELECT question_id, iteration_number, run_idx, CASE WHEN answer IS NULL OR answer = '' THEN 'No answer' ELSE answer END = answer AS given, CASE WHEN iteration_number <= 1 THEN 'early' WHEN iteration_number >= max(iteration_number) OVER (PARTITION BY question_id) - 2 THEN 'late' ELSE 'mid' END AS stratum, CASE WHEN iteration_number <= 1 THEN 'early' WHEN iteration_number >= 27 THEN 'late' ELSE 'mid' END AS scorer_stratum FROM runs")
def round_strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether an answer is given (else metrics read a fixed phrase), and whether its round is early, mid or late, by both rules."""
    last = F.max("iteration_number").over(Window.partitionBy("question_id"))
    r = F.col("iteration_number")
    return V.runs(spark, sf_dir).select(*CELL, "run_idx", (T.answer_or_default(F.col("answer")) == F.col("answer")).alias("given"), T.round_stratum(r, last).alias("stratum"), T.round_stratum(r).alias("scorer_stratum"))


@query(f"WITH {V.RUNS}, {V.QUESTIONS}, {V.GOLD}, k AS (SELECT question_id, CASE WHEN question_id % 3 = 0 THEN 'yes' WHEN question_id % 7 = 1 THEN NULL ELSE gold END AS gold, CASE WHEN question_id % 2 = 0 THEN 'bridge' ELSE 'comparison' END AS kind, CASE WHEN question_id % 4 = 0 THEN 'x' END AS bridge FROM gold) SELECT question_id, CASE WHEN gold IS NULL OR {V.sql_norm('gold')} = '' THEN 'skipped_no_gold' WHEN {V.sql_norm('gold')} IN ('yes', 'no') THEN 'skipped_yes_no' WHEN kind <> 'bridge' THEN 'skipped_not_bridge' WHEN bridge IS NULL THEN 'skipped_no_bridge' ELSE 'eligible' END AS status FROM k")
def injection_eligibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why a question is left out of an injection that targets its bridge entity."""
    q = F.col("question_id")
    k = V.gold(spark, sf_dir).select(q, F.when(q % 3 == 0, "yes").when(q % 7 == 1, F.lit(None)).otherwise(F.col("gold")).alias("gold"), F.when(q % 2 == 0, "bridge").otherwise("comparison").alias("kind"), F.when(q % 4 == 0, "x").alias("bridge"))
    return k.select(q, T.eligibility(F.col("gold"), F.lit("bridge"), F.col("kind"), F.col("bridge")).alias("status"))


# -- entities -----------------------------------------------------------------------------------------------------------

_MENTIONS = (
    f"{V.RUNS}, mn AS (SELECT question_id, iteration_number, run_idx, unnest(list_distinct(regexp_extract_all(answer, '[A-Z][a-z]{{3,}}'))) AS m FROM runs), "
    "canon AS (SELECT question_id, lower(m) AS k, upper(max(m)) AS c FROM mn WHERE iteration_number <= 2 GROUP BY 1, 2), "
    "ce AS (SELECT DISTINCT question_id, iteration_number, run_idx, coalesce(c, m) AS e FROM mn LEFT JOIN canon ON canon.question_id = mn.question_id AND k = lower(m)), "
    "ce2 AS (SELECT question_id, iteration_number, run_idx, e FROM (SELECT mn.question_id, mn.iteration_number, mn.run_idx, coalesce(c, m) AS e FROM mn LEFT JOIN canon ON canon.question_id = mn.question_id AND k = lower(m)) GROUP BY ALL)"
)


def mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Capitalised words of four letters or more stand in for the entities that a judge extracts from each answer."""
    m = F.array_distinct(F.regexp_extract_all("answer", F.lit(V.ENTITY), F.lit(0)))
    return V.runs(spark, sf_dir).select(*CELL, "run_idx", F.explode(m).alias("m"))


def canonical_map(m: DataFrame) -> DataFrame:
    """A question's mentions and their canonical names, by lower-cased mention; of several surface forms the last one counts. Learned in the first two rounds."""
    return m.where("iteration_number <= 2").groupBy("question_id", F.lower("m").alias("k")).agg(F.upper(F.max("m")).alias("c"))


def canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical entities of every run; a mention that the map lacks keeps its own form."""
    m = mentions(spark, sf_dir)
    return m.withColumn("k", F.lower("m")).join(canonical_map(m), ["question_id", "k"], "left").select(*CELL, "run_idx", F.coalesce("c", "m").alias("e")).distinct()


@query(f"WITH {_MENTIONS} SELECT question_id, iteration_number, run_idx, count(*) AS n_entities, md5(string_agg(e, '|' ORDER BY e)) AS digest FROM ce2 GROUP BY 1, 2, 3")
def canonical_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canonical(spark, sf_dir).groupBy(*CELL, "run_idx").agg(n(F.count(F.lit(1)), "n_entities"), F.md5(F.array_join(F.array_sort(F.collect_list("e")), "|")).alias("digest"))


@query(f"WITH {_MENTIONS}, names AS (SELECT DISTINCT question_id, c FROM canon) SELECT r.question_id, r.iteration_number, r.run_idx, count(*) AS n_recovered, md5(string_agg(c, '|' ORDER BY c)) AS digest FROM runs r JOIN names x ON x.question_id = r.question_id AND contains(lower(r.answer), lower(c)) LEFT JOIN ce2 ON ce2.question_id = r.question_id AND ce2.iteration_number = r.iteration_number AND ce2.run_idx = r.run_idx AND ce2.e = c WHERE ce2.e IS NULL GROUP BY 1, 2, 3")
def recovered_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical names that stand in an answer, in any case, though the run's entities lack them: a question's names are one automaton."""
    names = canonical_map(mentions(spark, sf_dir)).select("question_id", F.col("c").alias("e")).distinct()
    found = occurring(V.runs(spark, sf_dir).select(*CELL, "run_idx", "answer"), names)
    found = found.join(canonical(spark, sf_dir), [*CELL, "run_idx", "e"], "left_anti")
    return found.groupBy(*CELL, "run_idx").agg(n(F.count(F.lit(1)), "n_recovered"), F.md5(F.array_join(F.array_sort(F.collect_list("e")), "|")).alias("digest"))


@query(f"WITH {_MENTIONS}, u AS (SELECT question_id, iteration_number, count(DISTINCT e) AS u FROM ce2 GROUP BY 1, 2), p AS (SELECT u, row_number() OVER (PARTITION BY question_id ORDER BY iteration_number) AS position FROM u) SELECT position, round(avg(u), 6) AS mean_entities, count(*) AS n FROM p GROUP BY 1")
def mean_entities_by_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean number of entities by the position of the round in its question; rounds that a question lacks are left out."""
    u = canonical(spark, sf_dir).groupBy(*CELL).agg(F.countDistinct("e").alias("u")).withColumn("position", F.row_number().over(Window.partitionBy("question_id").orderBy("iteration_number")))
    return u.groupBy(n(F.col("position"), "position")).agg(r6(F.avg("u"), "mean_entities"), n(F.count(F.lit(1)), "n"))


@query(f"WITH {_MENTIONS}, rnd AS (SELECT question_id, iteration_number, list(DISTINCT e) AS s FROM ce2 GROUP BY 1, 2), p AS (SELECT a.question_id, coalesce(len(list_intersect(a.s, b.s)) / nullif(sqrt(1.0 * len(a.s) * len(b.s)), 0), 0) AS sim FROM rnd a JOIN rnd b ON a.question_id = b.question_id AND a.iteration_number < b.iteration_number), x AS (SELECT question_id, avg(sim) AS sim FROM p GROUP BY 1), uq AS (SELECT question_id, count(DISTINCT e) AS u FROM ce2 GROUP BY 1), sc AS (SELECT question_id, CASE WHEN sim IS NULL THEN 1.0 ELSE 1 - sim END AS ac, CASE WHEN sim IS NULL THEN 0 ELSE u END AS u FROM uq LEFT JOIN x USING (question_id)) SELECT question_id, round(ac, 6) AS anti_collapse, u AS unique_entities, CASE WHEN ac < 0.3 THEN 'lacks diversity' ELSE 'acceptable' END AS diagnosis FROM sc")
def anti_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """1 less the mean similarity of the rounds' entity sets (1 and no entities with fewer than two rounds), and what it says of a prompt."""
    c = canonical(spark, sf_dir)
    r = c.groupBy(*CELL).agg(F.collect_set("e").alias("s"))
    x = V.pairs(r, "question_id", by="iteration_number").groupBy("question_id").agg(F.avg(T.set_cosine(F.col("s_a"), F.col("s_b"))).alias("sim"))
    u = c.groupBy("question_id").agg(F.countDistinct("e").alias("u")).join(x, "question_id", "left")
    ac = F.when(F.col("sim").isNull(), 1.0).otherwise(1 - F.col("sim"))
    return u.select("question_id", r6(ac, "anti_collapse"), n(F.when(F.col("sim").isNull(), 0).otherwise(F.col("u")), "unique_entities"), F.when(ac < 0.3, "lacks diversity").otherwise("acceptable").alias("diagnosis"))


@query("WITH s AS (SELECT event_id, event_type AS candidate, CASE WHEN event_id % 11 = 0 THEN NULL ELSE (event_id % 10) / 10.0 END AS f, (user_id % 10) / 10.0 AS r FROM events), q AS (SELECT candidate, coalesce(0.6 * f + 0.4 * r, 0.5) AS q FROM s) SELECT candidate, round(avg(q), 6) AS quality, concat_ws(', ', CASE WHEN avg(q) < 0.5 THEN 'drifts from its sources' END, CASE WHEN avg(q) >= 0.5 THEN 'acceptable' END) AS diagnosis FROM q GROUP BY 1")
def quality_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """0.6 faithfulness + 0.4 relevance, 0.5 where the judge failed; mean by candidate prompt, and what it says."""
    e = V.table(spark, sf_dir, "events")
    f = F.when(F.col("event_id") % 11 == 0, F.lit(None)).otherwise((F.col("event_id") % 10) / 10.0)
    q = F.avg(F.coalesce(0.6 * f + 0.4 * ((F.col("user_id") % 10) / 10.0), F.lit(0.5)))
    g = e.groupBy(F.col("event_type").alias("candidate")).agg(q.alias("q"))
    return g.select("candidate", r6("q", "quality"), F.concat_ws(", ", F.when(F.col("q") < 0.5, "drifts from its sources"), F.when(F.col("q") >= 0.5, "acceptable")).alias("diagnosis"))
