"""Influence and its placebos, citation rates by provenance, and the tables that quality scoring starts from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loopscope.functions import stats
from loopscope.functions import text as T
from loopscope.functions import vectors
from loopscope.operators import reruns
from loopscope.operators.attribution import answered, citations
from loopscope.plans import views as V
from loopscope.plans.registry import n, query, r6

CELL = ["question_id", "iteration_number"]
#: An answer rests on a document from this overlap on.
TAU = 0.2
_N = "(SELECT max(question_id) + 1 FROM questions)"


def other_question(q: Column, k: Column, n_questions: Column) -> Column:
    """A question that is never q itself, the same in every engine: (q + 1 + (7 q + k) mod (n - 1)) mod n."""
    return F.pmod(q + 1 + F.pmod(7 * q + k, F.greatest(n_questions - 1, F.lit(1))), n_questions)


def _count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return F.broadcast(V.questions(spark, sf_dir).agg((F.max("question_id") + 1).alias("nq")))  # one row


_NOVEL = (
    f"{V.RUNS}, {V.QUESTIONS}, {V.DOCS}, t AS (SELECT question_id, iteration_number, run_idx, {V.sql_tokens('answer')} AS t FROM runs), "
    f"dt AS (SELECT question_id, iteration_number, slot, is_ai, {V.sql_tokens('text')} AS d, min(CASE WHEN is_ai THEN slot END) OVER (PARTITION BY question_id, iteration_number) AS own FROM docs), "
    "w AS (SELECT question_id, iteration_number, unnest(d) AS w FROM dt WHERE is_ai AND slot = own), o AS (SELECT DISTINCT question_id, iteration_number, unnest(d) AS w FROM dt WHERE own IS NULL OR slot <> own), "
    f"b AS (SELECT DISTINCT question_id, iteration_number + 1 AS iteration_number, unnest(t) AS w FROM t), q AS (SELECT DISTINCT question_id, unnest({V.sql_tokens('question_text')}) AS w FROM questions), had AS (SELECT DISTINCT question_id, iteration_number + 1 AS iteration_number FROM t), "
    "nv AS (SELECT w.question_id, w.iteration_number, list(w.w) AS novel FROM w SEMI JOIN had USING (question_id, iteration_number) ANTI JOIN o USING (question_id, iteration_number, w) ANTI JOIN b USING (question_id, iteration_number, w) ANTI JOIN q USING (question_id, w) GROUP BY 1, 2)"
)


def novel_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that a round's first generated document brings: not in the answers of the round before, in other documents of the round, or in the question."""
    d = V.context_docs(spark, sf_dir).select(*CELL, "slot", "is_ai", T.token_set(F.col("text")).alias("d"))
    d = d.withColumn("own", F.min(F.when(F.col("is_ai"), F.col("slot"))).over(Window.partitionBy(*CELL)))
    own = F.col("is_ai") & F.coalesce(F.col("slot") == F.col("own"), F.lit(False))
    before = V.runs(spark, sf_dir).select("question_id", (F.col("iteration_number") + 1).alias("iteration_number"), T.token_set(F.col("answer")).alias("t"))
    w = d.where(own).select(*CELL, F.explode("d").alias("w")).join(before.select(*CELL).distinct(), CELL, "left_semi")
    w = w.join(d.where(~own).select(*CELL, F.explode("d").alias("w")), [*CELL, "w"], "left_anti").join(before.select(*CELL, F.explode("t").alias("w")), [*CELL, "w"], "left_anti")
    q = V.questions(spark, sf_dir).select("question_id", F.explode(T.token_set(F.col("question_text"))).alias("w"))
    return w.join(q, ["question_id", "w"], "left_anti").groupBy(*CELL).agg(F.collect_list("w").alias("novel"))


@query(f"WITH {_NOVEL} SELECT question_id, iteration_number, CAST(len(novel) AS BIGINT) AS n_novel, md5(array_to_string(list_sort(novel), ' ')) AS digest FROM nv")
def novel_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return novel_words(spark, sf_dir).select(*CELL, n(F.size("novel"), "n_novel"), F.md5(F.array_join(F.array_sort("novel"), " ")).alias("digest"))


@query(
    f"WITH {_NOVEL}, ad AS (SELECT nv.question_id, nv.iteration_number, t.question_id AS at, avg(1.0 * len(list_intersect(novel, t)) / len(novel)) AS v FROM nv JOIN t ON nv.iteration_number = t.iteration_number AND (t.question_id = nv.question_id OR t.question_id = (nv.question_id + 1 + (7 * nv.question_id + nv.iteration_number) % greatest({_N} - 1, 1)) % {_N}) GROUP BY ALL), "
    "p AS (SELECT nv.question_id, nv.iteration_number, len(novel) AS size, s.v AS same, c.v AS crossed FROM nv JOIN ad s ON s.question_id = nv.question_id AND s.iteration_number = nv.iteration_number AND s.at = nv.question_id LEFT JOIN ad c ON c.question_id = nv.question_id AND c.iteration_number = nv.iteration_number AND c.at <> nv.question_id) "
    "SELECT coalesce(CAST(iteration_number AS VARCHAR), 'pooled') AS round, count(*) AS n_pairs, round(avg(size), 6) AS mean_novel, round(avg(same), 6) AS same_question, round(avg(crossed), 6) AS cross_question, round(avg(same) - avg(crossed), 6) AS influence FROM p GROUP BY GROUPING SETS ((iteration_number), ())"
)
def novelty_adoption(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of a document's novel words the same question's answers take up, less what another question's answers hold of them by chance; by round and pooled."""
    nv = novel_words(spark, sf_dir).crossJoin(_count(spark, sf_dir)).withColumn("other", other_question(F.col("question_id"), F.col("iteration_number"), F.col("nq")))
    t = V.runs(spark, sf_dir).select(F.col("question_id").alias("at"), "iteration_number", T.token_set(F.col("answer")).alias("t"))
    sides = nv.select(*CELL, "novel", F.explode(F.array(F.struct(F.lit("s").alias("side"), F.col("question_id").alias("at")), F.struct(F.lit("c").alias("side"), F.col("other").alias("at")))).alias("x")).select(*CELL, "novel", "x.side", "x.at")
    ad = sides.join(t, ["at", "iteration_number"]).groupBy(*CELL, "side").agg(F.avg(T.overlap(F.col("novel"), F.col("t"))).alias("v"), F.max(F.size("novel")).alias("size"))
    p = ad.where("side = 's'").select(*CELL, "size", F.col("v").alias("same")).join(ad.where("side = 'c'").select(*CELL, F.col("v").alias("crossed")), CELL, "left")
    g = p.groupingSets([["iteration_number"], []], "iteration_number").agg(n(F.count(F.lit(1)), "n_pairs"), F.avg("size").alias("z"), F.avg("same").alias("s"), F.avg("crossed").alias("c"))
    return g.select(F.coalesce(F.col("iteration_number").cast("string"), F.lit("pooled")).alias("round"), "n_pairs", r6("z", "mean_novel"), r6("s", "same_question"), r6("c", "cross_question"), r6(F.col("s") - F.col("c"), "influence"))


_ENT = "list_distinct(list_transform(regexp_extract_all({}, '[A-Z][a-z]{{3,}}'), lambda x: lower(x)))"


@query(f"WITH {V.DOCS}, {V.RUNS}, e AS (SELECT question_id, iteration_number, row_id, unnest({_ENT.format('text')}) AS e FROM docs WHERE is_ai), a AS (SELECT DISTINCT question_id, iteration_number, unnest({_ENT.format('answer')}) AS e FROM runs), o AS (SELECT DISTINCT question_id, iteration_number, unnest({_ENT.format('text')}) AS e FROM docs WHERE NOT is_ai) SELECT row_id, count(*) AS n_novel, md5(string_agg(e, ' ' ORDER BY e)) AS digest FROM e ANTI JOIN a USING (question_id, iteration_number, e) ANTI JOIN o USING (question_id, iteration_number, e) GROUP BY 1")
def novel_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities that a generated document has beyond those of its source answers and of the round's references."""
    names = lambda c: F.explode(F.array_distinct(F.transform(F.regexp_extract_all(c, F.lit(V.ENTITY), F.lit(0)), F.lower))).alias("e")
    d = V.context_docs(spark, sf_dir)
    e = d.where("is_ai").select(*CELL, "row_id", names("text"))
    e = e.join(V.runs(spark, sf_dir).select(*CELL, names("answer")), [*CELL, "e"], "left_anti").join(d.where("not is_ai").select(*CELL, names("text")), [*CELL, "e"], "left_anti")
    return e.groupBy("row_id").agg(n(F.count(F.lit(1)), "n_novel"), F.md5(F.array_join(F.array_sort(F.collect_list("e")), " ")).alias("digest"))


@query(
    f"WITH {V.RUNS}, {V.QUESTIONS}, {V.DOCS}, a AS (SELECT question_id, iteration_number, run_idx, {V.sql_tokens('answer')} AS a FROM runs), d AS (SELECT question_id, iteration_number, slot, doc_id, is_ai, {V.sql_tokens('text')} AS d FROM docs), "
    "later AS (SELECT d.* FROM d WHERE is_ai AND iteration_number > 1 AND NOT EXISTS (SELECT 1 FROM d c WHERE c.question_id = d.question_id AND c.iteration_number = 1 AND c.doc_id = d.doc_id)), "
    f"p AS (SELECT 'descendant' AS kind, {V.sql_overlap('a', 'd')} AS o FROM a JOIN later l ON a.question_id = l.question_id WHERE a.iteration_number = 1 "
    f"UNION ALL SELECT CASE WHEN is_ai THEN 'cross_self' ELSE 'cross_human' END, {V.sql_overlap('a', 'd')} FROM (SELECT *, unnest([0, 1, 2]) AS j FROM a WHERE iteration_number = 1) a JOIN d ON d.iteration_number = 1 AND d.question_id = (a.question_id + 1 + (7 * a.question_id + j) % greatest({_N} - 1, 1)) % {_N} AND d.slot = (3 * run_idx + j) % 10 AND d.question_id <> a.question_id) "
    f"SELECT kind, round(avg(CASE WHEN o >= {TAU} THEN 1.0 ELSE 0 END), 6) AS hit_rate, count(*) AS n FROM p GROUP BY 1"
)
def descendant_placebo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often round-1 answers seem to rest on documents that they cannot have seen: generated ones of later rounds that are not in their context, and three documents each of other questions."""
    a = V.runs(spark, sf_dir).where("iteration_number = 1").select("question_id", "run_idx", T.token_set(F.col("answer")).alias("a"))
    d = V.context_docs(spark, sf_dir).select(*CELL, "slot", "doc_id", "is_ai", T.token_set(F.col("text")).alias("d"))
    later = d.where("is_ai and iteration_number > 1").join(d.where("iteration_number = 1").select("question_id", "doc_id"), ["question_id", "doc_id"], "left_anti")
    seen = a.join(later.select("question_id", "d"), "question_id").select(F.lit("descendant").alias("kind"), "a", "d")
    draws = a.crossJoin(_count(spark, sf_dir)).withColumn("j", F.explode(F.array(*map(F.lit, range(3)))))
    draws = draws.select(F.col("question_id").alias("own"), "a", other_question(F.col("question_id"), F.col("j"), F.col("nq")).alias("question_id"), ((3 * F.col("run_idx") + F.col("j")) % 10).alias("slot"))
    crossed = draws.join(d.where("iteration_number = 1").select("question_id", "slot", "is_ai", "d"), ["question_id", "slot"]).where("question_id <> own").select(F.when(F.col("is_ai"), "cross_self").otherwise("cross_human").alias("kind"), "a", "d")
    o = seen.unionByName(crossed).withColumn("o", T.overlap(F.col("a"), F.col("d")))
    return o.groupBy("kind").agg(r6(F.avg((F.col("o") >= TAU).cast("double")), "hit_rate"), n(F.count(F.lit(1)), "n"))


@query(f"WITH {V.RUNS}, l AS (SELECT len({V.sql_tokens('answer')}) AS l FROM runs WHERE iteration_number > 0), r AS (SELECT l, row_number() OVER (ORDER BY l) - 1 AS k, count(*) OVER () AS n FROM l) SELECT CAST(l AS BIGINT) AS median_tokens, n FROM r WHERE k = n // 2")
def median_answer_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Upper median of the answers' token counts: from the counts of each length, not from a sort of all answers."""
    c = V.runs(spark, sf_dir).where("iteration_number > 0").groupBy(F.size(T.token_set(F.col("answer"))).alias("l")).agg(F.count(F.lit(1)).alias("c"))
    up = Window.orderBy("l").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    c = c.withColumns({"upto": F.sum("c").over(up), "n": F.sum("c").over(Window.partitionBy())})
    return c.where("upto > n div 2 and upto - c <= n div 2").select(n(F.col("l"), "median_tokens"), n(F.col("n"), "n"))


# -- citation rates ---------------------------------------------------------------------------------------------------

_RATES = (
    "cc AS (SELECT question_id, iteration_number, doc_id, count(*) AS c FROM cited GROUP BY ALL), tot AS (SELECT question_id, iteration_number, count(*) AS total FROM cited GROUP BY ALL), "
    "rates AS (SELECT d.question_id, d.iteration_number, d.doc_id, d.row_id, d.is_ai, d.text, coalesce(c, 0) AS citations, total, coalesce(c, 0) * 1.0 / total AS rate FROM docs d JOIN tot USING (question_id, iteration_number) LEFT JOIN cc USING (question_id, iteration_number, doc_id))"
)


def _with_rates() -> str:
    from loopscope.operators.attribution import _LOO

    return f"{_LOO}, {V.RUNS}, {_RATES}"


def citation_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document of each round with its citations, the round's and their quotient; rounds without citations are left out."""
    cited = citations(spark, sf_dir).select(*CELL, "doc_id")
    cc, total = cited.groupBy(*CELL, "doc_id").agg(F.count(F.lit(1)).alias("citations")), cited.groupBy(*CELL).agg(F.count(F.lit(1)).alias("total"))
    d = V.context_docs(spark, sf_dir).join(total, CELL).join(cc, [*CELL, "doc_id"], "left").withColumn("citations", F.coalesce("citations", F.lit(0)))
    return d.withColumn("rate", F.col("citations") / F.col("total"))


@query(f"WITH {_with_rates()} SELECT row_id, question_id, doc_id, CAST(is_ai AS BIGINT) AS is_ai, citations, total AS total_citations, round(rate, 6) AS citation_rate, md5(text) AS text_md5 FROM rates WHERE iteration_number = 1")
def scoring_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a quality judge is given: round-1 documents with their citation rates."""
    r = citation_rates(spark, sf_dir).where("iteration_number = 1")
    return r.select("row_id", "question_id", "doc_id", n(F.col("is_ai").cast("int"), "is_ai"), n(F.col("citations"), "citations"), n(F.col("total"), "total_citations"), r6("rate", "citation_rate"), F.md5("text").alias("text_md5"))


@query(f"WITH {_with_rates()}, g AS (SELECT coalesce(CAST(iteration_number AS VARCHAR), 'pooled') AS round, avg(rate) FILTER (is_ai) AS s, avg(rate) FILTER (NOT is_ai) AS o, count(*) FILTER (is_ai) AS n_self, count(*) FILTER (NOT is_ai) AS n_original FROM rates GROUP BY GROUPING SETS ((iteration_number), ())) SELECT round, round(s, 6) AS self_rate, round(o, 6) AS original_rate, round(s / nullif(o, 0), 6) AS ratio, n_self, n_original FROM g")
def self_and_original_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean citation rate of generated and of original documents, by round and pooled, and their ratio."""
    ai = F.col("is_ai")
    g = citation_rates(spark, sf_dir).groupingSets([["iteration_number"], []], "iteration_number").agg(F.avg(F.when(ai, F.col("rate"))).alias("s"), F.avg(F.when(~ai, F.col("rate"))).alias("o"), n(F.count(F.when(ai, 1)), "n_self"), n(F.count(F.when(~ai, 1)), "n_original"))
    return g.select(F.coalesce(F.col("iteration_number").cast("string"), F.lit("pooled")).alias("round"), r6("s", "self_rate"), r6("o", "original_rate"), r6(F.try_divide("s", "o"), "ratio"), "n_self", "n_original")


_PROVENANCE = "pr AS (SELECT r.*, quality, CASE WHEN is_ai THEN 'answer_derived' WHEN toxic = 1 THEN 'ai_original' WHEN toxic = 0 THEN 'human_original' ELSE 'unlabeled' END AS provenance FROM rates r LEFT JOIN labels l ON l.doc_id = r.row_id)"


def with_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with rates, a judge's quality, and where they come from: answers, or originals that a detector (here a label) calls AI, human or neither."""
    labels = V.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("row_id"), "quality", "toxic")
    kind = F.when(F.col("is_ai"), "answer_derived").when(F.col("toxic") == 1, "ai_original").when(F.col("toxic") == 0, "human_original").otherwise("unlabeled")
    return citation_rates(spark, sf_dir).join(labels, "row_id", "left").withColumn("provenance", kind)


@query(f"WITH {_with_rates()}, {_PROVENANCE} SELECT provenance, round(avg(rate), 6) AS citation_rate, round(avg(quality), 6) AS mean_quality, count(*) AS n FROM pr GROUP BY 1")
def rate_by_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean citation rate and quality by provenance."""
    return with_provenance(spark, sf_dir).groupBy("provenance").agg(r6(F.avg("rate"), "citation_rate"), r6(F.avg("quality"), "mean_quality"), n(F.count(F.lit(1)), "n"))


_KINDS = ["answer_derived", "ai_original", "human_original"]


@query(f"WITH {_with_rates()}, {_PROVENANCE} SELECT iteration_number, " + ", ".join(f"count(*) FILTER (provenance = '{k}') AS n_{k}, round(coalesce(sum(citations) FILTER (provenance = '{k}') * 1.0 / nullif(sum(citations), 0), 0), 6) AS cited_{k}" for k in _KINDS) + " FROM pr GROUP BY 1")
def availability_by_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By round: how many documents of each provenance there are, and their share of the citations."""
    is_ = lambda k: F.col("provenance") == k
    aggs = [c for k in _KINDS for c in (n(F.count(F.when(is_(k), 1)), f"n_{k}"), r6(T.share(F.coalesce(F.sum(F.when(is_(k), F.col("citations"))), F.lit(0)), F.sum("citations")), f"cited_{k}"))]
    return with_provenance(spark, sf_dir).groupBy("iteration_number").agg(*aggs)


@query(f"WITH {_with_rates()}, {_PROVENANCE}, h AS (SELECT CASE WHEN provenance = 'answer_derived' THEN rate END AS d, CASE WHEN provenance <> 'answer_derived' THEN rate END AS o FROM pr WHERE provenance <> 'unlabeled' AND quality = 1) SELECT round(avg(d), 6) AS derived_rate, round(avg(o), 6) AS original_rate, count(d) AS n_derived, count(o) AS n_original, round(avg(d) / nullif(avg(o), 0), 6) AS gap FROM h")
def high_quality_contrast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citation rates of derived and original documents among those of the best quality."""
    h = with_provenance(spark, sf_dir).where("provenance <> 'unlabeled' and quality = 1")
    d, o = (F.when(c, F.col("rate")) for c in (F.col("provenance") == "answer_derived", F.col("provenance") != "answer_derived"))
    return h.agg(r6(F.avg(d), "derived_rate"), r6(F.avg(o), "original_rate"), n(F.count(d), "n_derived"), n(F.count(o), "n_original"), r6(F.try_divide(F.avg(d), F.avg(o)), "gap"))


@query(f"WITH {_with_rates()}, avail AS (SELECT iteration_number, avg(CAST(is_ai AS INT)) AS ref FROM docs GROUP BY 1), s AS (SELECT iteration_number, 100.0 * avg(CAST(is_ai AS INT)) AS pct FROM cited GROUP BY 1), f AS (SELECT iteration_number, CASE WHEN ref <= 1 THEN ref ELSE ref / 100 END AS rf, CASE WHEN pct > 1 THEN pct / 100 ELSE pct END AS cf FROM avail JOIN s USING (iteration_number)) SELECT iteration_number, round(rf, 6) AS available, round(cf, 6) AS cited, round(cf / nullif(rf, 0), 6) AS observed_to_expected FROM f")
def observed_to_expected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of AI documents cited (kept in percent) over the share available (kept as a fraction), units made alike first."""
    ref = V.context_docs(spark, sf_dir).groupBy("iteration_number").agg(F.avg(F.col("is_ai").cast("int")).alias("ref"))
    pct = citations(spark, sf_dir).groupBy("iteration_number").agg((100.0 * F.avg(F.col("is_ai").cast("int"))).alias("pct"))
    f = ref.join(pct, "iteration_number").select("iteration_number", F.when(F.col("ref") <= 1, F.col("ref")).otherwise(F.col("ref") / 100).alias("rf"), F.when(F.col("pct") > 1, F.col("pct") / 100).otherwise(F.col("pct")).alias("cf"))
    return f.select("iteration_number", r6("rf", "available"), r6("cf", "cited"), r6(F.try_divide("cf", "rf"), "observed_to_expected"))


@query(f"WITH {_with_rates()}, u AS (SELECT iteration_number, count(DISTINCT w) AS words FROM (SELECT iteration_number, unnest({V.sql_words('answer')}) AS w FROM runs) GROUP BY 1), g AS (SELECT iteration_number, avg(CAST(is_ai AS INT)) AS share FROM docs GROUP BY 1) SELECT round(max(share) FILTER (iteration_number = 1), 6) AS share_r1, round(max(share) FILTER (iteration_number = 4), 6) AS share_r4, max(words) FILTER (iteration_number = 1) AS words_r1, max(words) FILTER (iteration_number = 4) AS words_r4 FROM g LEFT JOIN u USING (iteration_number)")
def diversity_before_saturation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of AI documents and distinct words in the first and the last round."""
    u = V.runs(spark, sf_dir).select("iteration_number", F.explode(T.words(F.col("answer"))).alias("w")).groupBy("iteration_number").agg(F.countDistinct("w").alias("words"))
    g = V.context_docs(spark, sf_dir).groupBy("iteration_number").agg(F.avg(F.col("is_ai").cast("int")).alias("share")).join(u, "iteration_number", "left")
    at = lambda c, k: F.max(F.when(F.col("iteration_number") == k, F.col(c)))
    return g.agg(r6(at("share", 1), "share_r1"), r6(at("share", 4), "share_r4"), n(at("words", 1), "words_r1"), n(at("words", 4), "words_r4"))


# -- direct elicitation against leave-one-out -------------------------------------------------------------------------

_NAMED = f"(SELECT DISTINCT question_id, iteration_number, run_idx, l.doc_id FROM picked p JOIN lead l USING (question_id, iteration_number, slot) WHERE removed IS NULL AND (k <= {reruns.SHARED} OR own = 1))"
_DIRECT = f"dir AS (SELECT question_id, iteration_number, list(DISTINCT doc_id) AS d FROM {_NAMED} GROUP BY ALL), loo AS (SELECT question_id, iteration_number, list(DISTINCT doc_id) AS l FROM cited GROUP BY ALL)"


@query(f"WITH {_with_rates()}, {_DIRECT}, j AS (SELECT question_id, iteration_number, len(list_intersect(d, l)) AS shared, len(d) AS nd, len(l) AS nl FROM dir JOIN loo USING (question_id, iteration_number)) SELECT question_id, iteration_number, round(1.0 * shared / nullif(nd + nl - shared, 0), 6) AS jaccard, round(1.0 * shared / nullif(nd, 0), 6) AS precision, round(1.0 * shared / nullif(nl, 0), 6) AS recall FROM j")
def direct_against_loo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that a round's answers name themselves against those that leaving one out finds: agreement of the two sets."""
    d = reruns.elicited(reruns.contexts(spark, sf_dir)).groupBy(*CELL).agg(F.collect_set("doc_id").alias("d"))
    j = citations(spark, sf_dir).groupBy(*CELL).agg(F.collect_set("doc_id").alias("l")).join(d, CELL)
    both = F.size(F.array_intersect("d", "l")).cast("double")
    return j.select(*CELL, r6(T.jaccard(F.col("d"), F.col("l")), "jaccard"), r6(F.try_divide(both, F.size("d")), "precision"), r6(F.try_divide(both, F.size("l")), "recall"))


@query(f"WITH {V.DOCS}, {V.QUESTIONS}, {reruns.SAID} SELECT question_id, iteration_number, run_idx, doc_id FROM {_NAMED}")
def cited_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last CITED list of each answer as documents: 1-based places in the round's context, unknown ones dropped."""
    return reruns.elicited(reruns.contexts(spark, sf_dir))


# -- statistics of attribution ----------------------------------------------------------------------------------------

_SIM = "v AS (SELECT vec_id // 10 AS g, vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings), q AS (SELECT g, arg_min(e, vec_id) AS qe FROM v GROUP BY 1)"


@query(f"WITH {_SIM}, r AS (SELECT a.vec_id, avg(list_inner_product(a.e, b.e)) AS red FROM v a JOIN v b ON a.g = b.g AND a.vec_id <> b.vec_id GROUP BY 1) SELECT v.vec_id, round(list_inner_product(e, qe), 6) AS question_cosine, round(coalesce(red, 0), 6) AS redundancy FROM v JOIN q USING (g) LEFT JOIN r USING (vec_id)")
def redundancy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cosine of each document with its question, and its mean cosine with the other documents of the context (0 where it is alone)."""
    v = V.table(spark, sf_dir, "embeddings").selectExpr("vec_id div 10 as g", "vec_id", "embedding as e")
    q = v.groupBy("g").agg(F.min_by("e", "vec_id").alias("qe"))
    b = v.select("g", F.col("vec_id").alias("other"), F.col("e").alias("f"))
    r = v.join(b, "g").where("vec_id <> other").groupBy("vec_id").agg(F.avg(vectors.dot(F.col("e"), F.col("f"))).alias("red"))
    return v.join(q, "g").join(r, "vec_id", "left").select("vec_id", r6(vectors.dot(F.col("e"), F.col("qe")), "question_cosine"), r6(F.coalesce("red", F.lit(0.0)), "redundancy"))


@query(f"WITH {_with_rates()}, x AS (SELECT rate AS y, CAST(is_ai AS DOUBLE) AS s, ln(1.0 + length(text)) AS z FROM rates), m AS (SELECT covar_pop(s, y) AS sy, covar_pop(z, y) AS zy, covar_pop(s, z) AS sz, var_pop(s) AS ss, var_pop(z) AS zz, count(*) AS n FROM x), b AS (SELECT CASE WHEN ss > 0 THEN sy / ss END AS a, CASE WHEN ss > 0 THEN (sy * zz - zy * sz) / nullif(ss * zz - sz * sz, 0) END AS b, n FROM m) SELECT round(a, 6) AS alone, round(b, 6) AS controlled, round(100 * (1 - b / nullif(a, 0)), 4) AS attenuation, n FROM b")
def attenuation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By how many percent a control (length) lessens the coefficient of `generated` in a regression of citation rates; null where nothing varies."""
    x = citation_rates(spark, sf_dir).select(F.col("rate").alias("y"), F.col("is_ai").cast("double").alias("s"), F.ln(1.0 + F.length("text")).alias("z"))
    m = x.agg(F.covar_pop("s", "y").alias("sy"), F.covar_pop("z", "y").alias("zy"), F.covar_pop("s", "z").alias("sz"), F.var_pop("s").alias("ss"), F.var_pop("z").alias("zz"), F.count(F.lit(1)).alias("n"))
    some = F.col("ss") > 0
    b = m.select(F.when(some, F.try_divide("sy", "ss")).alias("a"), F.when(some, F.try_divide(F.expr("sy * zz - zy * sz"), F.expr("ss * zz - sz * sz"))).alias("b"), "n")
    return b.select(r6("a", "alone"), r6("b", "controlled"), F.round(100 * (1 - F.try_divide("b", "a")), 4).alias("attenuation"), n(F.col("n"), "n"))


@query(f"WITH {_with_rates()}, m AS (SELECT avg(rate) AS mu, stddev_pop(rate) AS sd FROM rates), p AS (SELECT row_id, rate, row_number() OVER (PARTITION BY question_id, iteration_number ORDER BY doc_id) - 1 AS pos, count(*) OVER (PARTITION BY question_id, iteration_number) AS k FROM rates) SELECT row_id, round((rate - mu) / (sd + 1e-9), 5) + 0.0 AS z, round(1.0 * pos / greatest(k - 1, 1), 6) AS position FROM p, m")
def standard_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """z-scores by the population deviation (never a negative zero), and a document's place in its context from 0 to 1."""
    r = citation_rates(spark, sf_dir).select(*CELL, "row_id", "doc_id", "rate")
    m = F.broadcast(r.agg(F.avg("rate").alias("mu"), F.stddev_pop("rate").alias("sd")))  # one row
    w = Window.partitionBy(*CELL)
    p = r.withColumns({"pos": F.row_number().over(w.orderBy("doc_id")) - 1, "k": F.count(F.lit(1)).over(w)}).crossJoin(m)
    return p.select("row_id", (F.round((F.col("rate") - F.col("mu")) / (F.col("sd") + 1e-9), 5) + 0.0).alias("z"), r6(F.col("pos") / F.greatest(F.col("k") - 1, F.lit(1)), "position"))


_WEIGHT = "list_sum([CASE WHEN u > c THEN 1 ELSE 0 END for c in [{}]])".format(", ".join(f"{c:.12f}" for c in stats.POISSON))


@query(f"WITH {V.RUNS}, v AS (SELECT question_id, avg(len({V.sql_tokens('answer')})) AS y FROM runs GROUP BY 1), r AS (SELECT question_id, y, unnest(range(1, 1001)) AS rep FROM v), u AS (SELECT *, (CAST('0x' || substr(md5(concat_ws('|', 21, question_id, rep)), 1, 7) AS BIGINT) + 0.5) / 268435456.0 AS u FROM r), m AS (SELECT rep, sum(y * w) / nullif(sum(w), 0) AS m FROM (SELECT rep, y, {_WEIGHT} AS w FROM u) GROUP BY 1) SELECT (SELECT round(avg(y), 6) FROM v) AS mean, round(quantile_cont(m, 0.025), 6) AS lo, round(quantile_cont(m, 0.975), 6) AS hi, (SELECT count(*) FROM v) AS n FROM m")
def mean_bootstrap_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean over questions with a bootstrap interval: replicates weigh each value Poisson(1) times by a keyed hash that every engine has."""
    v = V.runs(spark, sf_dir).groupBy("question_id").agg(F.avg(F.size(T.token_set(F.col("answer")))).alias("y"))
    r = v.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(1000)))).withColumn("w", stats.poisson_weight(F.lit(21), F.col("question_id"), F.col("rep")))
    m = r.groupBy("rep").agg(F.try_divide(F.sum(F.col("y") * F.col("w")), F.sum("w")).alias("m")).agg(F.percentile("m", 0.025).alias("lo"), F.percentile("m", 0.975).alias("hi"))
    return v.agg(r6(F.avg("y"), "mean"), n(F.count(F.lit(1)), "n")).crossJoin(F.broadcast(m)).select("mean", r6("lo", "lo"), r6("hi", "hi"), "n")


_OF = "CASE WHEN question_id % 2 = 0 THEN 'search' ELSE 'replace_one' END AS variant"
_BY = "CASE WHEN run_idx % 2 = 0 THEN 'main' ELSE 'side' END AS model"


@query(
    f"WITH {_with_rates()}, ctx AS (SELECT {_OF}, iteration_number, avg(CAST(is_ai AS INT)) AS available FROM docs SEMI JOIN questions USING (question_id) GROUP BY ALL), cit AS (SELECT {_OF}, {_BY}, iteration_number, avg(CAST(is_ai AS INT)) AS share, count(*) AS n FROM cited GROUP BY ALL), "
    f"ans AS (SELECT {_OF}, {_BY}, iteration_number, count(DISTINCT w) AS words FROM (SELECT question_id, run_idx, iteration_number, unnest({V.sql_words('answer')}) AS w FROM said WHERE removed IS NULL) GROUP BY ALL) "
    "SELECT model, variant, iteration_number, round(available, 6) AS available, round(share, 6) AS cited, round(share / nullif(available, 0), 6) AS observed_to_expected, n AS n_citations, words AS unique_words FROM cit JOIN ctx USING (variant, iteration_number) LEFT JOIN ans USING (variant, model, iteration_number)"
)
def citation_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observed over expected citations of generated documents, and the answers' different words, by model, variant and round."""
    of = F.when(F.col("question_id") % 2 == 0, "search").otherwise("replace_one").alias("variant")
    by = F.when(F.col("run_idx") % 2 == 0, "main").otherwise("side").alias("model")
    docs = V.context_docs(spark, sf_dir).join(V.questions(spark, sf_dir), "question_id", "left_semi")
    ctx = docs.groupBy(of, "iteration_number").agg(F.avg(F.col("is_ai").cast("int")).alias("a"))
    cit = citations(spark, sf_dir).groupBy(of, by, "iteration_number").agg(F.avg(F.col("is_ai").cast("int")).alias("s"), n(F.count(F.lit(1)), "n_citations"))
    w = answered(spark, sf_dir).select(of, by, "iteration_number", F.explode(T.words(F.col("answer"))).alias("w")).groupBy("variant", "model", "iteration_number").agg(n(F.countDistinct("w"), "unique_words"))
    out = cit.join(ctx, ["variant", "iteration_number"]).join(w, ["variant", "model", "iteration_number"], "left")
    return out.select("model", "variant", "iteration_number", r6("a", "available"), r6("s", "cited"), r6(F.try_divide("s", "a"), "observed_to_expected"), "n_citations", "unique_words")
