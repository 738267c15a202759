"""Rounds of question answering over a corpus that is searched once: cached candidates, generated documents that are embedded and judged once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loopscope.functions import stats, vectors
from loopscope.functions import text as T
from loopscope.operators import lists
from loopscope.operators.loop import Generator, Writer, as_it_is, extractive
from loopscope.operators.retrieval import within
from loopscope.plans import views as V
from loopscope.plans.lineage import release, stored
from loopscope.plans.registry import n, query, r6

#: Rounds of each variant; documents of a context; candidates of the corpus that are cached; runs; the re-ranker's penalty.
ROUNDS = {"search": 30, "hybrid": 10, "replace_one": 20}
TOP, FETCHED, RUNS, PENALTY = 10, 20, 10, 0.5
#: What is put before a text that is embedded to be found, and before one that is embedded to search.
PASSAGE, QUERY = "passage: ", "query: "


def embed(text: Column, prefix: str = PASSAGE, dims: int = 64) -> Column:
    """A text's vector of unit length under its prefix; the stand-in for a model's."""
    return vectors.hashed_embedding(T.words(F.concat(F.lit(prefix), F.coalesce(text, F.lit("")))), dims)


def repetition(text: Column) -> Column:
    """A deterministic stand-in for a detector of generated texts: the share of words that have come before; 0 without words."""
    w = T.words(F.coalesce(text, F.lit("")))
    return F.coalesce(1 - F.try_divide(F.size(F.array_distinct(w)).cast("double"), F.size(w)), F.lit(0.0))


#: A candidate of a question: where it comes among equal ones, what it is, its score and a detector's share.
ITEM = ["seq", "doc", "is_ai", "text", "score", "ai"]


def ranked(items: Column, k: int, penalty: float | None) -> Column:
    """The k best of a question's candidates (array of ITEM), best first; with a penalty by scores between 0 and 1 over all of them, less the share that a detector takes. Equal ones as they came, a document once."""
    once = lambda c, f: F.transform(F.array(c), f)[0]  # noqa: E731  as in vectors: a lambda's variable is evaluated once
    scores = lambda xs: F.transform(xs, lambda x: x["score"])
    value = lambda x, a: x["score"] if penalty is None else F.round(within(x["score"], a["lo"], a["hi"], x["ai"], penalty), 9)
    keyed = lambda x, a: once(value(x, a), lambda v: F.struct(v.isNull().alias("none"), (~F.isnan(v)).alias("number"), (-v).alias("value"), x["seq"].alias("seq"), x.alias("item")))  # noqa: E731  nulls last, NaN first
    name = lambda x: F.coalesce(F.concat(F.lit("="), x["doc"]), F.lit(""))
    ends = once(items, lambda xs: F.struct(xs.alias("xs"), F.array_min(scores(xs)).alias("lo"), F.array_max(scores(xs)).alias("hi")))
    order = once(ends, lambda a: F.transform(F.array_sort(F.transform(a["xs"], lambda x: keyed(x, a))), lambda y: y["item"]))
    both = once(order, lambda xs: F.struct(xs.alias("xs"), F.transform(xs, name).alias("names")))
    return F.slice(once(both, lambda a: F.filter(a["xs"], lambda x, i: F.array_position(a["names"], name(x)) == i + 1)), 1, k)


def candidates(corpus: DataFrame, detect: Callable[[Column], Column]) -> DataFrame:
    """question_id and items, what the corpus gave (array of ITEM), each judged once."""
    w = Window.partitionBy("question_id").orderBy(F.desc("score"), "doc")
    rows = corpus.withColumns({"seq": F.row_number().over(w).cast("long"), "is_ai": F.lit(False), "ai": detect(F.col("text"))})
    return rows.groupBy("question_id").agg(F.collect_list(F.struct(ITEM)).alias("items"))


def _asked(runs: int, generate: Generator, write: Writer) -> Callable[[DataFrame], DataFrame]:
    """Of rows (question_id, question_text, docs, round): what the context was (round, n_docs, ai, digest), how many answers, all of them and the drawn one as documents."""
    n_ai = F.size(F.filter("docs", lambda d: d["is_ai"])).cast("double")
    kept = F.struct("round", F.size("docs").alias("n_docs"), F.try_divide(n_ai, F.size("docs")).alias("ai"), F.md5(F.array_join(F.transform("docs", lambda d: d["doc"]), " ")).alias("digest"))
    given = ["question_id", "question_text", F.transform("docs", lambda d: d["text"]).alias("context"), kept.alias("kept")]
    every = F.explode(F.sequence(F.lit(0), F.lit(runs - 1)))
    drawn = stats.keyed_order(F.lit(41), F.col("kept.round"), F.col("question_id"), F.col("run_idx"))
    told = [F.max("kept").alias("kept"), F.countDistinct("answer").alias("k"), F.min_by("made", drawn).alias("one"), F.transform(F.array_sort(F.collect_list(F.struct("run_idx", "made"))), lambda x: x["made"]).alias("made")]
    document = write(F.col("question_text"), F.col("answer"))
    return lambda now: generate(now.select(given).withColumn("run_idx", every)).withColumn("made", document).groupBy("question_id").agg(*told)


def qa_rounds(corpus: DataFrame, questions: DataFrame, rounds: int, variant: str = "search", k: int = TOP, penalty: float | None = None, runs: int = RUNS, num_synth: int = 10, num_db: int = 0, generate: Generator = extractive, write: Writer = as_it_is, detect: Callable[[Column], Column] = repetition) -> DataFrame:
    """question_id, round (from 0), n_docs, ai_share, n_answers, digest of the context's documents, of every round and every question.

    corpus: question_id, doc, text, score, the candidates that one search found; questions: question_id, question_text, q (vector).
    search: each round adds a document of the drawn answer and takes the k best of all; with a penalty a detector's
    share counts against a document. hybrid: the next context is the documents of the first num_synth answers and the
    first num_db of the corpus. replace_one: the slot numbered by the round, modulo the slots, gets the drawn answer's document. No
    question leaves before the last round, after which nothing is written. Questions without candidates have no rounds;
    null texts are documents that say nothing.

    A question is a row: its candidates, each embedded once and, where a penalty asks for it, judged once, and the rounds that it has seen. A round is one job that reads these rows
    and writes the next ones. Without a penalty the k best are kept and only what is new meets them. With one, scores are compared
    within the range of all of a question's candidates, which a new one can widen; so all are kept, the corpus's few and one a round.
    """
    bare = lambda x: F.struct(x["doc"].alias("doc"), x["is_ai"].alias("is_ai"), x["text"].alias("text"))
    items, one, at = F.col("items"), F.col("one"), F.size("past")
    made = lambda t, i: F.struct(F.concat(F.lit("gen_"), (at + 1).cast("string"), F.lit("_"), i.cast("string")).alias("doc"), F.lit(True).alias("is_ai"), t.alias("text"))
    best, docs, refs = ranked(items, k, penalty), items, []
    judge = detect if penalty is not None else lambda _: F.lit(None).cast("double")  # nothing else asks for it
    if variant == "search":
        score = F.round(vectors.dot(F.col("q"), embed(one)), 9)
        new = made(one, F.lit(0))
        new = F.struct((at + 1_000_001).cast("long").alias("seq"), *[new[x].alias(x) for x in ("doc", "is_ai", "text")], score.alias("score"), judge(one).alias("ai"))
        grown = F.concat(items, F.array(new))
        kept, docs, then = (best, items, ranked(grown, k, None)) if penalty is None else (items, best, grown)
    elif variant == "hybrid":
        refs = [F.slice(items, 1, max(0, num_db)).alias("refs")]
        kept, then = F.transform(best, bare), F.concat(F.transform(F.slice("made", 1, num_synth), made), "refs")
    else:
        kept, then = F.transform(best, bare), F.transform(items, lambda d, i: F.when(i == F.pmod(at + 1, F.size(items)), made(one, F.lit(0))).otherwise(bare(d)))
    row = "array<struct<round: int, n_docs: int, ai: double, k: bigint, digest: string>>"
    past = F.concat("past", F.array(F.struct("kept.round", "kept.n_docs", "kept.ai", "k", "kept.digest")).cast(row)).alias("past")
    asked, context = _asked(runs, generate, write), ["question_id", "question_text", F.transform(docs, bare).alias("docs"), at.alias("round")]
    following = ["question_id", "question_text", "q", then.alias("items"), *["refs" for _ in refs], past]  # expressions are made once, not a round
    now = candidates(corpus, judge).join(questions.select("question_id", "question_text", "q"), "question_id").withColumn("items", kept)
    now = stored(now.select("*", *refs, F.array().cast(row).alias("past")))
    for r in range(rounds):
        both = now.join(asked(now.select(context)), "question_id")
        old, now = now, stored(both.select(following if r < rounds - 1 else ["question_id", past]))
        release(old)
    report = now.select("question_id", F.inline("past"))
    return report.select("question_id", n(F.col("round"), "round"), n(F.col("n_docs"), "n_docs"), r6("ai", "ai_share"), n(F.col("k"), "n_answers"), "digest")


def _searched(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The corpus is all vectors, whose texts are the documents of the same number; a question's vector is the smallest of its hundred."""
    v = V.vectors(spark, sf_dir)
    index, centroids = lists.build(v.select("vec_id", "embedding"))
    own = v.groupBy("question_id").agg(F.min("vec_id").alias("query_id"), F.min_by("embedding", "vec_id").alias("q"))
    own = stored(own.join(V.questions(spark, sf_dir), "question_id"))
    got = lists.search(index, centroids, own.select(F.col("query_id").alias("vec_id"), F.col("q").alias("embedding")), FETCHED)
    texts = V.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id"), "text")
    corpus = got.join(own.select("question_id", "query_id"), "query_id").join(texts, "vec_id").select("question_id", F.concat(F.lit("corpus_"), F.col("vec_id").cast("string")).alias("doc"), "text", "score")
    return corpus, own.select("question_id", "question_text", "q")


@query()
def qa_search_loop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thirty rounds over cached candidates and what rounds add."""
    return qa_rounds(*_searched(spark, sf_dir), ROUNDS["search"])


@query()
def qa_rerank_loop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with a detector's share against each document."""
    return qa_rounds(*_searched(spark, sf_dir), ROUNDS["search"], penalty=PENALTY)


@query()
def qa_hybrid_loop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten rounds in contexts of five generated documents and three of the corpus."""
    return qa_rounds(*_searched(spark, sf_dir), ROUNDS["hybrid"], "hybrid", num_synth=5, num_db=3)


@query()
def qa_replace_one_loop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty rounds in which one document of the context gives way each time."""
    return qa_rounds(*_searched(spark, sf_dir), ROUNDS["replace_one"], "replace_one")
