"""Arms of a misinformation experiment: how the chosen slots of a context are corrupted, and the records that are kept of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loopscope.functions import stats
from loopscope.functions import text as T
from loopscope.operators.perturb import _AVOID, _SLOTS, distractor_slots, ranked_substitutes, topics
from loopscope.operators.qa import matches, targets
from loopscope.plans import views as V
from loopscope.plans.lineage import stored
from loopscope.plans.registry import n, query

CELL = ["question_id", "iteration_number"]
_DOC = "SELECT question_id, iteration_number, slot, row_id, text FROM docs"
#: Substitutes with their rank and a question's number of them; slots of a fraction with their place j and number.
_BASE = f"{V.TARGETS}, {_SLOTS.replace(V.GOLD + ', ', '')}, total AS (SELECT question_id, count(*) AS m FROM sub GROUP BY 1)"
_BASE_AVOID = f"{V.TARGETS}, {_AVOID.replace(V.GOLD + ', ', '')}, total AS (SELECT question_id, count(*) AS m FROM sub GROUP BY 1)"


def _chosen(fraction: float, by: str = "s", pick: str = "pick") -> str:
    return f"ch AS (SELECT question_id, iteration_number, slot, row_id, row_number() OVER (PARTITION BY question_id, iteration_number ORDER BY slot) - 1 AS j, count(*) OVER (PARTITION BY question_id, iteration_number) AS c FROM {by} WHERE {pick} <= round_even({fraction} * k, 0))"


def chosen(slots: DataFrame) -> DataFrame:
    """Chosen slots with their place j in slot order and their number c."""
    w = Window.partitionBy(*CELL)
    return slots.select(*CELL, "slot", "row_id").withColumns({"j": F.row_number().over(w.orderBy("slot")) - 1, "c": F.count(F.lit(1)).over(w)})


def with_substitute(slots: DataFrame, subs: DataFrame, at: Column) -> DataFrame:
    """slots and the substitute whose rank is at + 1 modulo the number of substitutes (at most as many as slots, `c`); questions without any are left out."""
    total = subs.groupBy("question_id").agg(F.count(F.lit(1)).alias("m"))
    s = slots.join(total, "question_id").withColumn("rank", (F.pmod(at, F.least("m", "c")) + 1).cast("int"))
    return s.join(subs.select("question_id", "rank", F.col("candidate").alias("sub")), ["question_id", "rank"])


def planted(text: Column, gold: Column, sub: Column) -> tuple[Column, Column]:
    """The text with gold replaced by the substitute, or else with a sentence that names the substitute; and how many were replaced."""
    changed, k = T.substitute(text, gold, sub)
    added = F.regexp_replace(F.concat(text, F.lit(" In fact, the answer is "), sub, F.lit(".")), r"^\s+|\s+$", "")
    return F.when(k == 0, added).otherwise(changed), k


def _sql_planted(text: str, gold: str, sub: str) -> tuple[str, str]:
    k = f"len(regexp_extract_all({text}, '(?i)\\b' || {gold} || '\\b'))"
    return f"CASE WHEN {k} = 0 THEN regexp_replace({text} || ' In fact, the answer is ' || {sub} || '.', '^\\s+|\\s+$', '', 'g') ELSE regexp_replace({text}, '(?i)\\b' || {gold} || '\\b', {sub}, 'g') END", k


_NEW, _K = _sql_planted("d.text", "g.gold", "x.candidate")
_SUBSTITUTION = "SELECT ch.question_id, ch.iteration_number, ch.slot, ch.row_id, x.candidate AS injected, CASE WHEN {k} = 0 THEN 'appended' ELSE 'ok' END AS status, md5({new}) AS digest FROM ch JOIN total t ON t.question_id = ch.question_id JOIN sub x ON x.question_id = ch.question_id AND x.rank = ch.j % least(t.m, ch.c) + 1 JOIN gold g ON g.question_id = ch.question_id JOIN docs d ON d.row_id = ch.row_id".format(k=_K, new=_NEW)


def substitution(spark: SparkSession, sf_dir: str, fraction: float) -> DataFrame:
    s = with_substitute(chosen(distractor_slots(spark, sf_dir, fraction)), ranked_substitutes(spark, sf_dir), F.col("j"))
    s = s.join(V.gold(spark, sf_dir), "question_id").join(V.context_docs(spark, sf_dir).select("row_id", "text"), "row_id")
    new, k = planted(F.col("text"), F.col("gold"), F.col("sub"))
    return s.select(*CELL, "slot", "row_id", F.col("sub").alias("injected"), F.when(k == 0, "appended").otherwise("ok").alias("status"), new.alias("text"))


@query(f"WITH {_BASE}, {_chosen(0.3)} {_SUBSTITUTION}")
def substitution_arm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A wrong answer in place of the right one in each chosen document, another one for each as long as there are some."""
    return substitution(spark, sf_dir, 0.3).withColumn("digest", F.md5("text")).drop("text")


def seen(text: Column, gold: Column, wrong: Column, question: Column) -> tuple[Column, Column]:
    """A generated document if it states the wrong answer and not the gold one, else a template that does; and the status."""
    fails = (F.trim(text) == "") | F.coalesce(T.contains_entity(text, gold), F.lit(False)) | ~T.contains_entity(text, wrong)
    return F.when(fails, T.fallback_paragraph(question, wrong)).otherwise(F.trim(text)), F.when(fails, "fallback_template").otherwise(T.realized_status(text, gold, wrong))


def _generated(slot: Column, wrong: Column, gold: Column) -> Column:
    """Stands in for a model: most documents state the wrong answer; some are refusals, some state the right one too."""
    states = F.concat(F.lit("Records name "), wrong, F.lit(" for it."))
    return F.when(slot % 4 == 3, "").when(slot % 4 == 2, F.concat(states, F.lit(" Others say "), gold, F.lit("."))).otherwise(states)


_GEN = "CASE WHEN ch.slot % 4 = 3 THEN '' WHEN ch.slot % 4 = 2 THEN 'Records name ' || x.candidate || ' for it. Others say ' || g.gold || '.' ELSE 'Records name ' || x.candidate || ' for it.' END"
_FALLBACK = "'Asked ' || regexp_replace(lower(substring(q.question_text, 1, 1)) || substring(q.question_text, 2), '\\?+$', '') || ', sources agree on ' || wrong || '.'"


def _guarded(rank: str, extra: str = "") -> str:
    fails = f"(gen = '' OR coalesce({V.sql_contains('gen', 'gold')}, false) OR NOT {V.sql_contains('gen', 'wrong')})"
    return (
        f"w AS (SELECT ch.question_id, ch.iteration_number, ch.slot, x.candidate AS wrong, g.gold, {_GEN} AS gen{extra} FROM ch JOIN total t ON t.question_id = ch.question_id JOIN sub x ON x.question_id = ch.question_id AND x.rank = {rank} + 1 JOIN gold g ON g.question_id = ch.question_id) "
        f"SELECT w.question_id, iteration_number, slot, wrong AS injected, CASE WHEN {fails} THEN 'fallback_template' ELSE 'ok' END AS status, md5(CASE WHEN {fails} THEN {_FALLBACK} ELSE gen END) AS digest FROM w JOIN questions q ON q.question_id = w.question_id"
    )


def synthesized(spark: SparkSession, sf_dir: str, slots: DataFrame, at: Column) -> DataFrame:
    s = with_substitute(slots, ranked_substitutes(spark, sf_dir), at).join(V.gold(spark, sf_dir), "question_id").join(V.questions(spark, sf_dir), "question_id")
    new, status = seen(_generated(F.col("slot"), F.col("sub"), F.col("gold")), F.col("gold"), F.col("sub"), F.col("question_text"))
    return s.select(*CELL, "slot", F.col("sub").alias("injected"), status.alias("status"), F.md5(new).alias("digest"))


@query(f"WITH {_BASE_AVOID}, {_chosen(0.5, 'av', 'pick2')}, {_guarded('ch.j % least(t.m, ch.c)')}")
def diverse_synthesis_arm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A generated document for each chosen slot, each with a wrong answer of its own; refusals and documents with the right answer give way to a template."""
    return synthesized(spark, sf_dir, chosen(distractor_slots(spark, sf_dir, 0.5, avoid_gold=True)), F.col("j"))


@query(f"WITH {_BASE_AVOID}, ch0 AS (SELECT question_id, iteration_number, slot, row_id, row_number() OVER (PARTITION BY question_id, iteration_number ORDER BY slot) - 1 AS j, count(*) OVER (PARTITION BY question_id, iteration_number) // 2 AS c FROM av WHERE pick2 <= round_even(0.8 * k, 0)), ch AS (SELECT * FROM ch0 WHERE j < c * 2), {_guarded('(ch.j // 2) % least(t.m, ch.c)')}")
def equal_topics_arm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fewer wrong answers, each stated by two generated documents."""
    s = topics(distractor_slots(spark, sf_dir, 0.8, avoid_gold=True)).select(*CELL, "slot", "row_id", F.col("i").alias("j"), F.expr("t div 2").alias("c"))
    return synthesized(spark, sf_dir, s, F.expr("j div 2"))


#: Substitutes that are proposed for a question, and that a judge knows.
PROPOSED = 10


def rewrite(text: Column, gold: Column, wrong: Column, seed: Column) -> Column:
    """A deterministic stand-in for a model that rewrites a passage towards a wrong answer: a third of the passages state one, a third name the right answer after all, the rest come back as they are."""
    kind = F.pmod(seed, F.lit(3))
    return F.when((kind == 0) & wrong.isNotNull(), planted(text, gold, wrong)[0]).when(kind == 1, F.concat(text, F.lit(" Some hold that it is "), gold, F.lit("."))).otherwise(text)


def asserted(docs: DataFrame, proposals: DataFrame, keys: list[str], text: str = "new") -> DataFrame:
    """keys (question_id among them) and `asserted`: the first proposal (question_id, rank, candidate) of the question that stands in the text as whole words; a stand-in for the judge that discovers claims. Texts without one give no row."""
    d = docs.select(*keys, F.concat(F.lit(" "), T.normalize(F.col(text)), F.lit(" ")).alias("_n"))
    j = d.join(proposals, "question_id").where(F.contains("_n", F.concat(F.lit(" "), T.normalize(F.col("candidate")), F.lit(" "))) & (T.normalize(F.col("candidate")) != ""))
    return j.groupBy(*keys).agg(F.min_by("candidate", "rank").alias("asserted"))


_SEED = "CAST('0x' || substr(md5(concat_ws('|', 47, ch.row_id)), 1, 7) AS BIGINT)"
_REW, _RK = _sql_planted("text", "gold", "wrong")
_FALL, _FK = _sql_planted("new", "gold", "candidate")


@query(
    f"WITH {_BASE}, {_chosen(0.5)}, prop AS (SELECT question_id, candidate, rank FROM sub WHERE rank <= {PROPOSED}), many AS (SELECT question_id, count(*) AS m FROM prop GROUP BY 1), "
    f"r0 AS (SELECT ch.*, g.gold, d.text, {_SEED} % 3 AS kind, {_SEED} // 3 % m + 1 AS at FROM ch JOIN gold g USING (question_id) JOIN docs d ON d.row_id = ch.row_id LEFT JOIN many ON many.question_id = ch.question_id WHERE g.gold <> ''), "
    f"r1 AS (SELECT r0.*, p.candidate AS wrong FROM r0 LEFT JOIN prop p ON p.question_id = r0.question_id AND p.rank = r0.at), r AS (SELECT *, CASE WHEN kind = 0 AND wrong IS NOT NULL THEN {_REW} WHEN kind = 1 THEN text || ' Some hold that it is ' || gold || '.' ELSE text END AS new FROM r1), "
    f"nm AS (SELECT question_id, iteration_number, slot, ' ' || {V.sql_norm('new')} || ' ' AS t FROM r), said AS (SELECT nm.question_id, iteration_number, slot, arg_min(candidate, rank) AS asserted FROM nm JOIN prop p ON p.question_id = nm.question_id AND contains(t, ' ' || {V.sql_norm('candidate')} || ' ') AND {V.sql_norm('candidate')} <> '' GROUP BY ALL), "
    "z AS (SELECT r.*, asserted FROM r LEFT JOIN said USING (question_id, iteration_number, slot)), pend AS (SELECT question_id, iteration_number, slot, row_number() OVER (PARTITION BY question_id, iteration_number ORDER BY slot) AS place FROM z WHERE asserted IS NULL), "
    "free AS (SELECT question_id, iteration_number, candidate, row_number() OVER (PARTITION BY question_id, iteration_number ORDER BY rank) AS place FROM (SELECT DISTINCT question_id, iteration_number FROM z) JOIN prop USING (question_id) ANTI JOIN (SELECT question_id, iteration_number, asserted AS candidate FROM z WHERE asserted IS NOT NULL) USING (question_id, iteration_number, candidate)), "
    "x AS (SELECT z.*, candidate FROM z LEFT JOIN pend USING (question_id, iteration_number, slot) LEFT JOIN free USING (question_id, iteration_number, place)) "
    f"SELECT question_id, iteration_number, slot, coalesce(asserted, candidate, '') AS injected, CASE WHEN asserted IS NOT NULL THEN 'ok' WHEN candidate IS NULL THEN 'no_error_produced' WHEN {_FK} = 0 THEN 'fallback_appended' ELSE 'fallback_substitution' END AS status, md5(CASE WHEN asserted IS NOT NULL OR candidate IS NULL THEN new ELSE {_FALL} END) AS digest FROM x"
)
def rewrite_arm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chosen documents are rewritten, and a judge looks for the wrong answer that each now states.

    Those that state one are kept with it. The others (the right answer, or none) get, slot by slot, a proposed substitute
    that no kept one of the round states; where these run out, they stay as they were rewritten.
    """
    proposals = ranked_substitutes(spark, sf_dir).where(F.col("rank") <= PROPOSED).select("question_id", "rank", "candidate")
    many = proposals.groupBy("question_id").agg(F.count(F.lit(1)).alias("m"))
    s = chosen(distractor_slots(spark, sf_dir, 0.5)).join(targets(spark, sf_dir).select("question_id", "gold"), "question_id").join(V.context_docs(spark, sf_dir).select("row_id", "text"), "row_id").join(many, "question_id", "left")
    s = s.withColumn("seed", F.conv(F.substring(stats.keyed_order(F.lit(47), F.col("row_id")), 1, 7), 16, 10).cast("long"))
    s = s.withColumn("rank", (F.expr("seed div 3") % F.col("m") + 1).cast("int")).join(proposals.withColumnRenamed("candidate", "wrong"), ["question_id", "rank"], "left").drop("rank")
    s = stored(s.select(*CELL, "slot", "gold", rewrite(F.col("text"), F.col("gold"), F.col("wrong"), F.col("seed")).alias("new")))
    z = s.join(asserted(s, proposals, [*CELL, "slot"]), [*CELL, "slot"], "left")
    kept = z.where("asserted is not null").select(*CELL, F.col("asserted").alias("candidate"))
    free = z.select(*CELL).distinct().join(proposals, "question_id").join(kept, [*CELL, "candidate"], "left_anti")
    w = Window.partitionBy(*CELL)
    free = free.withColumn("place", F.row_number().over(w.orderBy("rank"))).select(*CELL, "place", F.col("candidate").alias("sub"))
    z = z.withColumn("place", F.when(F.col("asserted").isNull(), F.sum(F.col("asserted").isNull().cast("int")).over(w.orderBy("slot").rowsBetween(Window.unboundedPreceding, Window.currentRow))))
    z = z.join(free, [*CELL, "place"], "left")
    fallback, k = planted(F.col("new"), F.col("gold"), F.col("sub"))
    ok, none = F.col("asserted").isNotNull(), F.col("sub").isNull()
    status = F.when(ok, "ok").when(none, "no_error_produced").when(k == 0, "fallback_appended").otherwise("fallback_substitution")
    return z.select(*CELL, "slot", F.coalesce("asserted", "sub", F.lit("")).alias("injected"), status.alias("status"), F.md5(F.when(ok | none, F.col("new")).otherwise(fallback)).alias("digest"))


@query(f"WITH {_BASE}, {_chosen(0.3)}, noise AS (SELECT question_id, row_id AS noise_id, row_number() OVER (PARTITION BY question_id ORDER BY md5(concat_ws('|', 23, question_id, row_id)), row_id) - 1 AS i, count(*) OVER (PARTITION BY question_id) AS m FROM docs WHERE iteration_number = 4 AND NOT is_ai) SELECT ch.question_id, ch.iteration_number, slot, noise_id, 'native' AS status FROM ch JOIN noise ON noise.question_id = ch.question_id AND i = j % m")
def native_noise_arm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs that support no answer in the chosen slots, shuffled by question and used again in turn."""
    w = Window.partitionBy("question_id")
    d = V.context_docs(spark, sf_dir).where("iteration_number = 4 and not is_ai").select("question_id", F.col("row_id").alias("noise_id"))
    noise = d.withColumns({"i": F.row_number().over(w.orderBy(stats.keyed_order(F.lit(23), F.col("question_id"), F.col("noise_id")), "noise_id")) - 1, "m": F.count(F.lit(1)).over(w)})
    return chosen(distractor_slots(spark, sf_dir, 0.3)).join(noise, "question_id").where("i = j % m").select(*CELL, "slot", "noise_id", F.lit("native").alias("status"))


@query(f"WITH {_BASE}, {_chosen(0.5)}, pool AS ({_SUBSTITUTION}), want AS (SELECT question_id, iteration_number, row_id FROM s WHERE pick <= round_even(0.3 * k, 0)), j AS (SELECT w.question_id, w.iteration_number, p.row_id IS NOT NULL AND p.row_id % 5 <> 0 AS hit FROM want w LEFT JOIN pool p ON p.row_id = w.row_id) SELECT question_id, iteration_number, count(*) FILTER (hit) AS n_corrupted, count(*) FILTER (NOT hit) AS n_missing, CASE WHEN count(*) FILTER (hit) > 0 THEN 'ok' ELSE 'no_docs_in_cache' END AS status FROM j GROUP BY 1, 2")
def prebuilt_pool_arm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corrupted documents of a smaller arm taken from the pool that a larger one made; slots that the pool lacks are counted."""
    pool = substitution(spark, sf_dir, 0.5).where("row_id % 5 <> 0").select("row_id", F.lit(1).alias("hit"))
    j = distractor_slots(spark, sf_dir, 0.3).select(*CELL, "row_id").join(pool, "row_id", "left")
    g = j.groupBy(*CELL).agg(n(F.count("hit"), "n_corrupted"), n(F.count_if(F.col("hit").isNull()), "n_missing"))
    return g.withColumn("status", F.when(F.col("n_corrupted") > 0, "ok").otherwise("no_docs_in_cache"))


@query(f"WITH {V.DOCS}, {V.GOLD}, t AS (SELECT question_id, slot, concat_ws('_', source, slot) AS title, {V.sql_contains('text', 'gold')} AS has FROM docs JOIN gold USING (question_id) WHERE iteration_number = 1 AND slot < 3 AND question_id % 2 = 0) SELECT question_id, arg_min(title, slot) AS bridge FROM t WHERE NOT has GROUP BY 1")
def bridge_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first supporting title whose paragraph lacks the gold answer, of bridge questions (here the even ones, with three supporting paragraphs)."""
    d = V.context_docs(spark, sf_dir).where("iteration_number = 1 and slot < 3 and question_id % 2 = 0").join(V.gold(spark, sf_dir), "question_id")
    return d.where(~T.contains_entity(F.col("text"), F.col("gold"))).groupBy("question_id").agg(F.min_by(F.concat_ws("_", "source", "slot"), "slot").alias("bridge"))


_CF, _CK = _sql_planted("answer", "gold", "target")


@query(f"WITH {V.TARGETS} SELECT question_id, iteration_number, run_idx, CASE WHEN len(regexp_extract_all(answer, '(?i)\\b' || gold || '\\b')) = 0 THEN 'gold_absent' ELSE 'substituted' END AS note, md5(regexp_replace(answer, '(?i)\\b' || gold || '\\b', target, 'g')) AS digest FROM runs JOIN injected USING (question_id) WHERE target IS NOT NULL AND iteration_number = 2")
def counterfactual_answers(spark: SparkSession, sf_dir: str, inject_round: int = 2, every_round: bool = False) -> DataFrame:
    """Answers of the injection round with the gold answer replaced; one without it stays as it is, with a note."""
    r = V.runs(spark, sf_dir).where(F.lit(every_round) | (F.col("iteration_number") == inject_round)).join(targets(spark, sf_dir).where("target is not null"), "question_id")
    new, k = T.substitute(F.col("answer"), F.col("gold"), F.col("target"))
    return r.select(*CELL, "run_idx", F.when(k == 0, "gold_absent").otherwise("substituted").alias("note"), F.md5(new).alias("digest"))


_STATUS = "CASE WHEN a = '' THEN 'gold_absent_in_answer' WHEN t AND NOT g THEN 'ok' WHEN t AND g THEN 'leaky_gold' ELSE 'not_realized' END"


@query(f"WITH {V.TARGETS}, c AS (SELECT question_id, iteration_number, run_idx, {V.sql_norm('answer')} AS a, {V.sql_contains('answer', 'target')} AS t, {V.sql_contains('answer', 'gold')} AS g FROM runs JOIN injected USING (question_id) WHERE target IS NOT NULL), st AS (SELECT question_id, iteration_number, {_STATUS} AS s FROM c WHERE run_idx = 0) SELECT question_id, CASE WHEN count(*) FILTER (s = 'ok') > 0 THEN 'ok' WHEN count(*) FILTER (s = 'leaky_gold') > 0 THEN 'leaky_gold' ELSE arg_max(s, iteration_number) END AS status FROM st GROUP BY 1")
def injection_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record's status over the rounds, folded in order: `ok` stays, a leak gives way to `ok` alone, weaker ones to whatever comes."""
    t, g = F.col("t"), F.col("g")
    s = F.when(F.col("a") == "", "gold_absent_in_answer").when(t & ~g, "ok").when(t & g, "leaky_gold").otherwise("not_realized")
    m = matches(spark, sf_dir).where("run_idx = 0 and t is not null").select(*CELL, s.alias("s")).groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("iteration_number", "s"))).alias("l"))
    weak = lambda x: x.isin("pending", "not_realized", "gold_absent_in_answer")
    return m.select("question_id", F.aggregate("l", F.lit("pending"), lambda now, x: F.when(weak(now) | (x["s"] == "ok"), x["s"]).otherwise(now)).alias("status"))


@query(f"WITH {_BASE}, {_chosen(0.3)}, a AS ({_SUBSTITUTION}), f AS (SELECT question_id, injected, min(iteration_number * 100 + slot) AS o FROM a GROUP BY 1, 2) SELECT question_id, count(*) AS n_entities, string_agg(injected, '|' ORDER BY o, injected) AS entities FROM f GROUP BY 1")
def seeded_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Different wrong answers that a question was seeded with, in order of their first slot."""
    a = substitution(spark, sf_dir, 0.3).groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct((F.col("iteration_number") * 100 + F.col("slot")).alias("o"), "injected"))).alias("l"))
    e = F.array_distinct(F.transform("l", lambda x: x["injected"]))
    return a.select("question_id", n(F.size(e), "n_entities"), F.array_join(e, "|").alias("entities"))


@query(f"WITH {_BASE}, {_chosen(0.3)}, a AS ({_SUBSTITUTION}), r AS (SELECT question_id, count(*) AS n_corrupted FROM a GROUP BY 1), o AS (SELECT question_id, count(DISTINCT iteration_number) AS n_rounds FROM runs GROUP BY 1) SELECT question_id, n_rounds, coalesce(n_corrupted, 0) AS n_corrupted, CASE WHEN n_corrupted IS NULL THEN 'none' ELSE 'ok' END AS status, 0.3 AS fraction, 'substitution' AS mode FROM o LEFT JOIN r USING (question_id)")
def attached_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every question of an experiment with the record of its corruption, if it has one, and the run's metadata."""
    r = substitution(spark, sf_dir, 0.3).groupBy("question_id").agg(F.count(F.lit(1)).alias("c"))
    o = V.runs(spark, sf_dir).groupBy("question_id").agg(n(F.countDistinct("iteration_number"), "n_rounds")).join(r, "question_id", "left")
    return o.select("question_id", "n_rounds", n(F.coalesce("c", F.lit(0)), "n_corrupted"), F.when(F.col("c").isNull(), "none").otherwise("ok").alias("status"), F.lit(0.3).alias("fraction"), F.lit("substitution").alias("mode"))


# -- sweeps over arms ---------------------------------------------------------------------------------------------------

_SWEEP = (
    f"{V.TARGETS}, arm AS (SELECT r.*, CASE run_idx % 3 WHEN 0 THEN '0' WHEN 1 THEN '0.3' ELSE '0.5' END AS arm FROM runs r), "
    "seeded AS (SELECT '0.3' AS arm, question_id, list(candidate) AS es FROM sub WHERE rank <= 1 GROUP BY 2 UNION ALL SELECT '0.5', question_id, list(candidate) FROM sub WHERE rank <= 2 GROUP BY 2), "
    "cohort AS (SELECT question_id FROM seeded GROUP BY 1 HAVING count(DISTINCT arm) = 2), "
    f"mt AS (SELECT a.arm, a.question_id, iteration_number, {V.sql_norm('answer')} AS a, coalesce({V.sql_contains('answer', 'gold')}, false) AS g, len(list_filter(coalesce(es, []), lambda e: contains(' ' || {V.sql_norm('answer')} || ' ', ' ' || e || ' '))) > 0 AS d FROM arm a JOIN cohort USING (question_id) LEFT JOIN gold USING (question_id) LEFT JOIN seeded s ON s.arm = a.arm AND s.question_id = a.question_id), "
    "pq AS (SELECT arm, question_id, iteration_number, avg(CAST(g AS DOUBLE)) AS gm, avg(CAST(d AS DOUBLE)) AS da, avg(CASE WHEN a <> '' AND NOT g AND NOT d THEN 1.0 ELSE 0 END) AS off, count(DISTINCT CASE WHEN a <> '' THEN a END) AS dist FROM mt GROUP BY 1, 2, 3), "
    "pr AS (SELECT arm, iteration_number, avg(gm) AS gm, avg(da) AS da, avg(off) AS off, avg(dist) AS dist, count(*) AS nq FROM pq GROUP BY 1, 2)"
)


def sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arm and round: mean over the shared cohort of gold matches, adoption of the arm's own seeds, off-target answers and different answers.

    Runs are dealt to three arms; the one without seeds does not limit the cohort.
    """
    subs = ranked_substitutes(spark, sf_dir)
    seeds = lambda arm, m: subs.where(F.col("rank") <= m).groupBy("question_id").agg(F.collect_list("candidate").alias("es")).withColumn("arm", F.lit(arm))
    seeded = seeds("0.3", 1).unionByName(seeds("0.5", 2))
    cohort = seeded.groupBy("question_id").agg(F.countDistinct("arm").alias("c")).where("c = 2").select("question_id")
    arm = F.when(F.col("run_idx") % 3 == 0, "0").when(F.col("run_idx") % 3 == 1, "0.3").otherwise("0.5")
    r = V.runs(spark, sf_dir).withColumn("arm", arm).join(cohort, "question_id", "left_semi").join(V.gold(spark, sf_dir), "question_id", "left").join(seeded, ["arm", "question_id"], "left")
    a = F.concat(F.lit(" "), F.col("a"), F.lit(" "))
    m = r.withColumn("a", T.normalize(F.col("answer"))).withColumns({"g": F.coalesce(T.contains_entity(F.col("answer"), F.col("gold")), F.lit(False)), "d": F.coalesce(F.exists("es", lambda e: F.contains(a, F.concat(F.lit(" "), e, F.lit(" ")))), F.lit(False))})
    off = ((F.col("a") != "") & ~F.col("g") & ~F.col("d")).cast("double")
    q = m.groupBy("arm", *CELL).agg(F.avg(F.col("g").cast("double")).alias("gm"), F.avg(F.col("d").cast("double")).alias("da"), F.avg(off).alias("off"), F.countDistinct(F.when(F.col("a") != "", F.col("a"))).alias("dist"))
    return q.groupBy("arm", "iteration_number").agg(*[F.avg(c).alias(c) for c in ("gm", "da", "off", "dist")], F.count(F.lit(1)).alias("nq"))


_R6 = lambda c, name: F.round(c, 6).alias(name)


@query(f"WITH {_SWEEP} SELECT arm, iteration_number, round(gm, 6) AS gold_match, round(da, 6) AS distractor_adoption, round(off, 6) AS offtarget, round(dist, 6) AS distinct_answers, nq AS n_questions FROM pr")
def sweep_by_round(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sweep(spark, sf_dir).select("arm", "iteration_number", _R6("gm", "gold_match"), _R6("da", "distractor_adoption"), _R6("off", "offtarget"), _R6("dist", "distinct_answers"), n(F.col("nq"), "n_questions"))


@query(f"WITH {_SWEEP}, e AS (SELECT arm, arg_min(gm, iteration_number) AS g0, arg_max(gm, iteration_number) AS gf, arg_min(dist, iteration_number) AS d0, arg_max(dist, iteration_number) AS df, arg_max(da, iteration_number) AS af FROM pr GROUP BY 1) SELECT arm, round(g0, 6) AS first_gold, round(gf, 6) AS final_gold, round(coalesce(gf - (SELECT gf FROM e WHERE arm = '0'), 0), 6) AS against_none, round(d0, 6) AS first_distinct, round(df, 6) AS final_distinct, round(af, 6) AS final_adoption FROM e")
def sweep_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First and final round of each arm, and its final gold matches less those of the arm without distractors."""
    i = "iteration_number"
    e = sweep(spark, sf_dir).groupBy("arm").agg(F.min_by("gm", i).alias("g0"), F.max_by("gm", i).alias("gf"), F.min_by("dist", i).alias("d0"), F.max_by("dist", i).alias("df"), F.max_by("da", i).alias("af"))
    base = F.max(F.when(F.col("arm") == "0", F.col("gf"))).over(Window.partitionBy())  # a row an arm
    return e.select("arm", _R6("g0", "first_gold"), _R6("gf", "final_gold"), _R6(F.coalesce(F.col("gf") - base, F.lit(0.0)), "against_none"), _R6("d0", "first_distinct"), _R6("df", "final_distinct"), _R6("af", "final_adoption"))


@query(f"WITH {V.RUNS}, {V.GOLD}, m AS (SELECT CASE WHEN run_idx % 2 = 0 THEN 'gold_only' ELSE 'all' END AS arm, question_id, iteration_number, {V.sql_norm('answer')} AS a, {V.sql_norm('gold')} AS g FROM runs LEFT JOIN gold USING (question_id)), c AS (SELECT question_id FROM m GROUP BY 1 HAVING count(DISTINCT arm) = 2), q AS (SELECT arm, question_id, iteration_number, avg(CASE WHEN a = coalesce(g, '') THEN 1.0 ELSE 0 END) AS gm, count(DISTINCT a) AS dist FROM m SEMI JOIN c USING (question_id) GROUP BY 1, 2, 3) SELECT arm, iteration_number, round(avg(gm), 6) AS gold_match, round(avg(dist), 6) AS distinct_answers, count(*) AS n_questions FROM q GROUP BY 1, 2")
def native_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arms over the questions that all have: answers that equal gold, and different answers, empty ones included."""
    m = V.runs(spark, sf_dir).join(V.gold(spark, sf_dir), "question_id", "left").select(F.when(F.col("run_idx") % 2 == 0, "gold_only").otherwise("all").alias("arm"), *CELL, T.normalize(F.col("answer")).alias("a"), F.coalesce(T.normalize(F.col("gold")), F.lit("")).alias("g"))
    c = m.groupBy("question_id").agg(F.countDistinct("arm").alias("k")).where("k = 2").select("question_id")
    q = m.join(c, "question_id", "left_semi").groupBy("arm", *CELL).agg(F.avg((F.col("a") == F.col("g")).cast("double")).alias("gm"), F.countDistinct("a").alias("dist"))
    return q.groupBy("arm", "iteration_number").agg(_R6(F.avg("gm"), "gold_match"), _R6(F.avg("dist"), "distinct_answers"), n(F.count(F.lit(1)), "n_questions"))
