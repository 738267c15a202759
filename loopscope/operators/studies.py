"""Joins and tables of studies: annotation items and scores, aligned series, manifests, detector errors, agents' lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loopscope.functions import stats
from loopscope.functions import text as T
from loopscope.operators import reruns
from loopscope.operators.attribution import _LOO, ranked
from loopscope.operators.retrieval import top_k
from loopscope.plans import views as V
from loopscope.plans.lineage import stored
from loopscope.plans.registry import n, query, r6

CELL = ["question_id", "iteration_number"]


@query(f"WITH {V.ENTS} SELECT r.question_id, r.iteration_number, r.run_idx, CAST(len(ents) AS BIGINT) AS n_entities, md5(answer) AS digest FROM runs r JOIN ents e USING (question_id, iteration_number, run_idx) WHERE answer <> '' AND r.iteration_number > 0 AND len(ents) > 0")
def annotation_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers with the entities that were found in them, by question, round and run; empty answers, round 0 and answers without entities are left out."""
    e = V.entities(spark, sf_dir).where(F.size("ents") > 0)
    r = V.runs(spark, sf_dir).where("answer <> '' and iteration_number > 0")
    return r.join(e, [*CELL, "run_idx"]).select(*CELL, "run_idx", n(F.size("ents"), "n_entities"), F.md5("answer").alias("digest"))


_ITEMS = "it AS (SELECT doc_id, n_chars % 4 AS ok, doc_id % 3 AS bad, doc_id % 2 AS missed, source, CASE WHEN (doc_id // 10) % 4 = 0 THEN 'early' WHEN (doc_id // 10) % 4 = 3 THEN 'late' ELSE 'mid' END AS stratum FROM documents JOIN labels USING (doc_id)), pr AS (SELECT *, CASE WHEN ok + bad > 0 THEN 1.0 * ok / (ok + bad) ELSE 1 END AS p, CASE WHEN ok + missed > 0 THEN 1.0 * ok / (ok + missed) ELSE 1 END AS r FROM it WHERE ok + bad + missed > 0)"


@query(f"WITH {_ITEMS} SELECT CASE WHEN source IS NOT NULL THEN source WHEN stratum IS NOT NULL THEN stratum ELSE 'all' END AS grp, round(avg(p), 6) AS macro_precision, round(avg(r), 6) AS macro_recall, round(1.0 * sum(ok) / nullif(sum(ok + bad), 0), 6) AS micro_precision, round(1.0 * sum(ok) / nullif(sum(ok + missed), 0), 6) AS micro_recall, round(avg(CASE WHEN bad = 0 AND missed = 0 THEN 1.0 ELSE 0 END), 6) AS exact_rate, count(*) AS n FROM pr GROUP BY GROUPING SETS ((source), (stratum), ())")
def annotation_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precision and recall of marked items, by item and pooled: for all, each source and each stratum. Items without marks are left out."""
    d = V.table(spark, sf_dir, "documents").join(V.table(spark, sf_dir, "labels").select("doc_id"), "doc_id")
    place = F.expr("(doc_id div 10) % 4")
    i = d.select((F.col("n_chars") % 4).alias("ok"), (F.col("doc_id") % 3).alias("bad"), (F.col("doc_id") % 2).alias("missed"), "source", F.when(place == 0, "early").when(place == 3, "late").otherwise("mid").alias("stratum")).where("ok + bad + missed > 0")
    q = lambda a, b: F.try_divide(F.col(a).cast("double"), F.col(a) + F.col(b))
    i = i.withColumns({"p": F.coalesce(q("ok", "bad"), F.lit(1.0)), "r": F.coalesce(q("ok", "missed"), F.lit(1.0))})
    s = lambda a, b: F.try_divide(F.sum(a).cast("double"), F.sum(F.col(a) + F.col(b)))
    g = i.groupingSets([["source"], ["stratum"], []], "source", "stratum").agg(r6(F.avg("p"), "macro_precision"), r6(F.avg("r"), "macro_recall"), r6(s("ok", "bad"), "micro_precision"), r6(s("ok", "missed"), "micro_recall"), r6(F.avg(((F.col("bad") == 0) & (F.col("missed") == 0)).cast("double")), "exact_rate"), n(F.count(F.lit(1)), "n"))
    return g.select(F.coalesce("source", "stratum", F.lit("all")).alias("grp"), *g.columns[2:])


@query("WITH a AS (SELECT doc_id AS item, quality AS mark FROM labels WHERE doc_id % 2 = 0), b AS (SELECT doc_id AS item, CASE WHEN toxic = 1 THEN 0 ELSE quality END AS mark FROM labels WHERE doc_id % 3 <> 1), j AS (SELECT a.mark AS x, b.mark AS y FROM a JOIN b USING (item)), k AS (SELECT count(*) * 1.0::DOUBLE AS n, count(*) FILTER (x = y) AS po, sum(x) AS xa, sum(y) AS ya FROM j) SELECT CAST(n AS BIGINT) AS n, round(po / n, 6) AS agreement, round(CASE WHEN (xa / n) * (ya / n) + (1 - xa / n) * (1 - ya / n) = 1 THEN 1 ELSE (po / n - ((xa / n) * (ya / n) + (1 - xa / n) * (1 - ya / n))) / (1 - ((xa / n) * (ya / n) + (1 - xa / n) * (1 - ya / n))) END, 6) AS kappa FROM k")
def annotator_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two annotators over the items that both marked: observed agreement and kappa."""
    m = V.table(spark, sf_dir, "labels")
    a = m.where("doc_id % 2 = 0").select("doc_id", F.col("quality").alias("x"))
    b = m.where("doc_id % 3 <> 1").select("doc_id", F.when(F.col("toxic") == 1, 0).otherwise(F.col("quality")).alias("y"))
    k = a.join(b, "doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("x") == F.col("y")).cast("int")).alias("po"), F.sum("x").alias("xa"), F.sum("y").alias("ya"))
    return k.select(n(F.col("n"), "n"), r6(F.col("po") / F.col("n"), "agreement"), r6(stats.kappa(F.col("po"), F.col("xa"), F.col("ya"), F.col("n")), "kappa"))


@query(f"WITH {V.RUNS}, {V.DOCS}, a AS (SELECT iteration_number, avg(CAST(is_ai AS INT)) AS s FROM docs GROUP BY 1), b AS (SELECT iteration_number, count(DISTINCT w) AS u FROM (SELECT iteration_number, unnest({V.sql_words('answer')}) AS w FROM runs) GROUP BY 1), c AS (SELECT iteration_number, avg(length(answer)) AS l FROM runs GROUP BY 1) SELECT iteration_number, round(s, 6) AS ai_share, u AS unique_words, round(l, 6) AS answer_length FROM a JOIN b USING (iteration_number) JOIN c USING (iteration_number)")
def aligned_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three series over the rounds that all of them have."""
    r, i = V.runs(spark, sf_dir), "iteration_number"
    a = V.context_docs(spark, sf_dir).groupBy(i).agg(r6(F.avg(F.col("is_ai").cast("int")), "ai_share"))
    b = r.select(i, F.explode(T.words(F.col("answer"))).alias("w")).groupBy(i).agg(n(F.countDistinct("w"), "unique_words"))
    return a.join(b, i).join(r.groupBy(i).agg(r6(F.avg(F.length("answer")), "answer_length")), i)


@query(f"WITH {V.RUNS}, c AS (SELECT iteration_number, CASE WHEN run_idx % 3 = 0 THEN NULL ELSE length(answer) - length(replace(answer, ',', '')) END AS calls FROM runs) SELECT iteration_number, round(avg(coalesce(calls, 0)), 6) AS mean_tool_calls FROM c GROUP BY 1")
def mean_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean number of lookups by round (commas stand in for them); a missing number is 0."""
    calls = F.when(F.col("run_idx") % 3 != 0, F.length("answer") - F.length(F.replace("answer", F.lit(","), F.lit(""))))
    return V.runs(spark, sf_dir).groupBy("iteration_number").agg(r6(F.avg(F.coalesce(calls, F.lit(0))), "mean_tool_calls"))


@query(f"WITH {V.RUNS} SELECT CASE WHEN run_idx % 2 = 0 THEN 'main' ELSE 'side' END AS writer, CASE WHEN question_id % 2 = 0 THEN 'search' ELSE 'replace_one' END AS variant, iteration_number, round(avg(len({V.sql_tokens('answer')})), 6) AS mean_tokens, count(*) AS n FROM runs GROUP BY 1, 2, 3")
def writer_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One metric by who writes the documents, variant and round."""
    w = F.when(F.col("run_idx") % 2 == 0, "main").otherwise("side").alias("writer")
    v = F.when(F.col("question_id") % 2 == 0, "search").otherwise("replace_one").alias("variant")
    return V.runs(spark, sf_dir).groupBy(w, v, "iteration_number").agg(r6(F.avg(F.size(T.token_set(F.col("answer")))), "mean_tokens"), n(F.count(F.lit(1)), "n"))


@query(f"WITH {V.RUNS} SELECT question_id, iteration_number + 1 AS iteration, md5(arg_min(answer, md5(concat_ws('|', 29, question_id, iteration_number, run_idx)))) AS digest FROM runs WHERE run_idx % 2 = 1 GROUP BY question_id, iteration_number")
def cross_model_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next round's document where a side model (here the odd runs) writes documents and the main one is measured: one of its answers, drawn by keyed hash."""
    key = stats.keyed_order(F.lit(29), F.col("question_id"), F.col("iteration_number"), F.col("run_idx"))
    return V.runs(spark, sf_dir).where("run_idx % 2 = 1").groupBy(*CELL).agg(F.min_by("answer", key).alias("a")).select("question_id", (F.col("iteration_number") + 1).alias("iteration"), F.md5("a").alias("digest"))


@query(f"WITH {_LOO}, r AS (SELECT iteration_number, count(*) AS n_requests FROM ranked WHERE k <= 4 GROUP BY 1), u AS (SELECT iteration_number, count(*) AS n_reruns, sum(length(x.answer)) AS n_chars FROM said x SEMI JOIN (SELECT * FROM ranked WHERE k <= 4) k ON k.question_id = x.question_id AND k.iteration_number = x.iteration_number AND k.doc_id = x.removed GROUP BY 1) SELECT iteration_number, n_requests, n_reruns, CAST(n_chars AS BIGINT) AS n_chars, 0 AS n_again FROM r JOIN u USING (iteration_number)")
def rerun_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reruns without one candidate that leave-one-out asks for, how many and how long the answers in the cache are then (equal keys run once), and how many more a second pass brings."""
    rounds = stored(reruns.contexts(spark, sf_dir))
    r = stored(ranked(spark, sf_dir, reruns.answers(rounds)).where("k <= 4").select(*CELL, "doc_id"))
    cache = reruns.Reruns(spark)
    once = cache.ask(rounds, r).groupBy("iteration_number").agg(n(F.count(F.lit(1)), "n_reruns"), n(F.sum(F.length("answer")), "n_chars"))
    once = stored(once)
    twice = cache.ask(rounds, r).groupBy("iteration_number").agg(n(F.count(F.lit(1)), "n"))
    out = r.groupBy("iteration_number").agg(n(F.count(F.lit(1)), "n_requests")).join(once, "iteration_number").join(twice, "iteration_number")
    return out.select("iteration_number", "n_requests", "n_reruns", "n_chars", (F.col("n") - F.col("n_reruns")).alias("n_again"))


_LEX = "list_distinct(regexp_extract_all(lower({}), '[a-z0-9]+'))"


@query(f"WITH {V.RUNS}, {V.DOCS}, {V.QUESTIONS}, cq AS (SELECT question_id, iteration_number, run_idx, 0 AS call, question_text AS q FROM runs JOIN questions USING (question_id) UNION ALL SELECT question_id, iteration_number, run_idx, i, s FROM (SELECT question_id, iteration_number, run_idx, unnest(regexp_extract_all(answer, '[A-Z][a-z]{{3,}}')[1:2]) AS s, unnest(range(1, 1 + len(regexp_extract_all(answer, '[A-Z][a-z]{{3,}}')[1:2]))) AS i FROM runs)), sc AS (SELECT c.*, row_id, round({V.sql_share('len(list_intersect(' + _LEX.format('q') + ', ' + _LEX.format('text') + '))', 'len(' + _LEX.format('q') + ')')}, 9) AS score FROM cq c JOIN docs d ON d.question_id = c.question_id AND d.iteration_number = c.iteration_number), h AS (SELECT *, row_number() OVER (PARTITION BY question_id, iteration_number, run_idx, call ORDER BY score DESC, row_id) AS k FROM sc) SELECT question_id, iteration_number, run_idx, count(DISTINCT call) AS tool_calls, count(DISTINCT row_id) AS n_retrieved FROM h WHERE k <= 3 GROUP BY 1, 2, 3")
def agentic_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several lookups a run (the question, then up to two names): the three best documents of each, gathered for later citation, and the number of calls."""
    r = V.runs(spark, sf_dir)
    names = F.slice(F.regexp_extract_all("answer", F.lit(V.ENTITY), F.lit(0)), 1, 2)
    calls = r.join(V.questions(spark, sf_dir), "question_id").select(*CELL, "run_idx", F.posexplode(F.concat(F.array("question_text"), names)).alias("call", "query")).withColumn("q", F.array_distinct(T.rouge_tokens(F.col("query"))))
    d = V.context_docs(spark, sf_dir).select(*CELL, "row_id", F.array_distinct(T.rouge_tokens(F.col("text"))).alias("d"))
    s = calls.join(d, CELL).withColumn("score", F.round(T.share(F.size(F.array_intersect("q", "d")), F.size("q")), 9))
    return top_k(s, [*CELL, "run_idx", "call"], 3, "score", "row_id").groupBy(*CELL, "run_idx").agg(n(F.countDistinct("call"), "tool_calls"), n(F.countDistinct("row_id"), "n_retrieved"))


@query(f"WITH {V.QUESTIONS}, {V.RUNS} SELECT question_id FROM questions EXCEPT SELECT question_id FROM runs WHERE iteration_number >= 2")
def uncovered_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions that no later round uses."""
    return V.questions(spark, sf_dir).select("question_id").exceptAll(V.runs(spark, sf_dir).where("iteration_number >= 2").select("question_id").distinct())


@query("SELECT DISTINCT doc_id // 40 AS cluster FROM labels WHERE toxic = 1 UNION SELECT doc_id // 40 FROM labels WHERE quality = 1")
def bootstrap_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions that either of two groups has."""
    m = V.table(spark, sf_dir, "labels").withColumn("cluster", F.expr("doc_id div 40"))
    return m.where("toxic = 1").select("cluster").union(m.where("quality = 1").select("cluster")).distinct()


@query("WITH f AS (SELECT doc_id, CASE WHEN contains(lower(source), 'web') THEN 'web' WHEN contains(lower(source), 'wiki') THEN 'wiki' WHEN contains(lower(source), 'forum') THEN 'forum' ELSE 'other' END AS dataset, lang AS method, count(*) OVER (PARTITION BY md5(text)) AS copies FROM documents) SELECT dataset, method, count(*) AS n_files, count(*) FILTER (copies > 1) AS n_duplicate, count(*) FILTER (copies = 1) AS n_unique FROM f GROUP BY 1, 2")
def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files by what their names say (first match wins) and by method, with how many share their contents with another."""
    d = V.table(spark, sf_dir, "documents").select(F.lower("source").alias("s"), F.col("lang").alias("method"), F.md5("text").alias("h"))
    kind = F.when(F.contains("s", F.lit("web")), "web").when(F.contains("s", F.lit("wiki")), "wiki").when(F.contains("s", F.lit("forum")), "forum").otherwise("other")
    per = d.groupBy("h", kind.alias("dataset"), "method").agg(F.count(F.lit(1)).alias("c"))  # copies meet as counts
    per = per.withColumn("copies", F.sum("c").over(Window.partitionBy("h")))
    some = lambda c: F.coalesce(F.sum(F.when(c, F.col("c"))), F.lit(0))
    return per.groupBy("dataset", "method").agg(n(F.sum("c"), "n_files"), n(some(F.col("copies") > 1), "n_duplicate"), n(some(F.col("copies") == 1), "n_unique"))


_DET = "p AS (SELECT doc_id, toxic, round(least(n_chars / 4000.0, 1), 6) AS score FROM documents JOIN labels USING (doc_id))"


@query(f"WITH {_DET}, e AS (SELECT 'false positive' AS kind, doc_id, score, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM p WHERE toxic = 0 AND score >= 0.9 UNION ALL SELECT 'missed', doc_id, score, row_number() OVER (ORDER BY score, doc_id) FROM p WHERE toxic = 1 AND score <= 0.2) SELECT * FROM e WHERE rank <= 20")
def detector_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty most confident false alarms and misses of a detector."""
    p = V.table(spark, sf_dir, "documents").select("doc_id", "n_chars").join(V.table(spark, sf_dir, "labels"), "doc_id").select("doc_id", "toxic", F.round(F.least(F.col("n_chars") / 4000.0, F.lit(1.0)), 6).alias("score"))
    top = lambda rows, kind, order: rows.orderBy(order, "doc_id").limit(20).select(F.lit(kind).alias("kind"), "doc_id", "score", F.row_number().over(Window.orderBy(order, "doc_id")).cast("long").alias("rank"))  # noqa: E731  twenty rows at most
    return top(p.where("toxic = 0 and score >= 0.9"), "false positive", F.desc("score")).union(top(p.where("toxic = 1 and score <= 0.2"), "missed", F.asc("score")))


@query(f"WITH {_DET}, c AS (SELECT toxic AS label, count(*) FILTER (score >= 0.5) AS hi, count(*) FILTER (score < 0.5) AS lo FROM p GROUP BY 1), t AS (SELECT sum(hi) AS hi, sum(lo) AS lo FROM c) SELECT CAST(label AS BIGINT) AS label, round(1.0 * CASE WHEN label = 1 THEN c.hi ELSE c.lo END / nullif(CASE WHEN label = 1 THEN t.hi ELSE t.lo END, 0), 6) AS precision, round(1.0 * CASE WHEN label = 1 THEN c.hi ELSE c.lo END / (c.hi + c.lo), 6) AS recall, c.hi + c.lo AS support FROM c, t")
def detector_report_by_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precision, recall and support of a thresholded detector for each class."""
    p = V.table(spark, sf_dir, "documents").select("doc_id", "n_chars").join(V.table(spark, sf_dir, "labels"), "doc_id").select("toxic", (F.round(F.least(F.col("n_chars") / 4000.0, F.lit(1.0)), 6) >= 0.5).alias("hi"))
    c = p.groupBy("toxic").agg(F.count_if("hi").alias("hi"), F.count_if(~F.col("hi")).alias("lo"))
    right = F.when(F.col("toxic") == 1, F.col("hi")).otherwise(F.col("lo"))
    every = Window.partitionBy()  # two rows
    called = F.when(F.col("toxic") == 1, F.sum("hi").over(every)).otherwise(F.sum("lo").over(every))
    return c.select(n(F.col("toxic"), "label"), r6(F.try_divide(right.cast("double"), called), "precision"), r6(right / (F.col("hi") + F.col("lo")), "recall"), n(F.col("hi") + F.col("lo"), "support"))


@query(f"WITH {V.QUESTIONS} SELECT question_id, row_number() OVER (ORDER BY md5(concat_ws('|', 31, question_id)), question_id) AS place FROM questions QUALIFY place <= 4")
def random_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four questions in an order drawn by keyed hash."""
    q = V.questions(spark, sf_dir).select("question_id").withColumn("h", stats.keyed_order(F.lit(31), F.col("question_id")))
    return q.orderBy("h", "question_id").limit(4).select("question_id", n(F.row_number().over(Window.orderBy("h", "question_id")), "place"))


@query("SELECT o_orderpriority AS candidate, round(avg(o_totalprice), 4) AS avg_anti_collapse, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) >= 5 ORDER BY avg(o_totalprice) DESC, 1 LIMIT 1")
def best_candidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The leader of the board."""
    g = V.table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("candidate")).agg(F.avg("o_totalprice").alias("a"), n(F.count(F.lit(1)), "n")).where("n >= 5")
    return g.orderBy(F.desc("a"), "candidate").limit(1).select("candidate", F.round("a", 4).alias("avg_anti_collapse"), "n")


@query("WITH s AS (SELECT o_clerkless AS prompt, variant, avg(v) AS s FROM (SELECT o_orderpriority AS o_clerkless, o_orderstatus AS variant, o_totalprice AS v FROM orders) GROUP BY 1, 2) SELECT 'c_' || substr(sha256(prompt), 1, 8) AS candidate_id, count(*) AS n_variants, round(avg(s), 4) AS score FROM s GROUP BY prompt")
def candidate_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates by the short id of their prompt: the mean over variants of each variant's mean score."""
    from loopscope.sources.writers import candidate_id

    s = V.table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("prompt"), "o_orderstatus").agg(F.avg("o_totalprice").alias("s"))
    return s.groupBy("prompt").agg(n(F.count(F.lit(1)), "n_variants"), F.round(F.avg("s"), 4).alias("score")).select(candidate_id("prompt").alias("candidate_id"), "n_variants", "score")


@query(f"WITH {V.DOCS} SELECT row_id, CASE WHEN trim(text) = '' THEN 0.0 WHEN is_ai OR source = 'model_generated' THEN 1.0 ELSE 0.0 END AS p_ai FROM docs")
def detector_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P(AI) of documents: a plug-in's score, here what ids and urls say; blank texts are 0."""
    d = V.context_docs(spark, sf_dir)
    return d.select("row_id", F.when(F.trim("text") == "", 0.0).when(T.is_ai(F.col("doc_id"), F.col("source"), F.lit(0)), 1.0).otherwise(0.0).alias("p_ai"))
