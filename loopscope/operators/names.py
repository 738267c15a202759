"""Names in answers: those that a list holds are found by an automaton, and variants of one name meet by edit distance."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from loopscope.plans import views as V
from loopscope.plans.components import components
from loopscope.plans.lineage import stored
from loopscope.plans.registry import n, query

#: Letters of a gram; names of LONG letters or more may differ by two edits, shorter ones by one.
GRAM, LONG = 2, 8


@lru_cache(64)
def _automaton(names: tuple[str, ...]):
    import ahocorasick

    a = ahocorasick.Automaton()
    for i, x in enumerate(names):
        if x:
            a.add_word(x, i)
    a.make_automaton()
    return a


def occurring(texts: DataFrame, names: DataFrame, key: str = "question_id", text: str = "answer", name: str = "e") -> DataFrame:
    """The columns of texts but the text, and every name of the row's key that occurs in it, in any case, once.

    A key's names become one automaton, which a task builds once and reads each text through once: the cost is linear in the texts,
    not texts times names. Both sides are lower-cased by Spark. Empty and null names occur nowhere, null texts hold none; names
    that differ in case alone are found together. Rows without names, and names without rows, give nothing.
    """
    low = names.where(F.col(name).isNotNull()).groupBy(key, F.lower(name).alias("_low")).agg(F.sort_array(F.collect_set(name)).alias("_forms"))
    lists = low.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("_low", "_forms"))).alias("_names"))
    rest = [c for c in texts.columns if c != text]
    rows = texts.join(lists, key).where(F.col(text).isNotNull()).select(*rest, F.lower(text).alias("_text"), F.transform("_names", lambda x: x["_low"]).alias("_low"), F.transform("_names", lambda x: x["_forms"]).alias("_forms"))
    schema = StructType([f for f in rows.schema.fields[: len(rest)]] + [StructField(name, StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            of, found = [], []
            text, low, forms = (b.column(len(rest) + i) for i in range(3))
            for i in range(len(b)):
                a = _automaton(tuple(low[i].as_py()))
                hits = {k for _, k in a.iter(text[i].as_py())} if len(a) else ()
                for k in sorted(hits):
                    own = forms[i][k].as_py()
                    of += [i] * len(own)
                    found += own
            at = pa.array(of, pa.int64())
            yield pa.RecordBatch.from_arrays([c.take(at) for c in b.columns[: len(rest)]] + [pa.array(found, pa.string())], names=schema.names)

    return rows.mapInArrow(run, schema)


def edits(a: Column, b: Column) -> Column:
    """How many edits two names may differ by."""
    return F.when(F.least(F.length(a), F.length(b)) < LONG, 1).otherwise(2)


def similar(names: DataFrame, key: str = "question_id", name: str = "m") -> DataFrame:
    """key, a, b: pairs of a key's distinct names, a before b, that differ by few edits (`edits`).

    An edit undoes GRAM grams at most, so names within d edits share one of the GRAM x d + 1 rarest grams of each: an equi-join on those, then
    Levenshtein's distance. Grams that a name repeats are told apart. Names too short to be sure of a shared gram (of up
    to GRAM + 1 letters) meet by their key alone.
    """
    d = names.where(F.col(name).isNotNull()).select(key, F.col(name).alias("m")).distinct()
    size = F.length("m")
    grams = F.transform(F.sequence(F.lit(1), F.greatest(size - GRAM + 1, F.lit(1))), lambda i: F.substring("m", i, F.lit(GRAM)))
    g = d.select(key, "m", F.posexplode(grams).alias("at", "g"))
    g = g.withColumn("again", F.row_number().over(Window.partitionBy(key, "m", "g").orderBy("at")))
    often = g.groupBy(key, "g", "again").agg(F.count(F.lit(1)).alias("c"))
    g = g.join(often, [key, "g", "again"]).withColumn("k", F.row_number().over(Window.partitionBy(key, "m").orderBy("c", "g", "again")))
    g = g.where(F.col("k") <= F.when(size < LONG, GRAM + 1).otherwise(2 * GRAM + 1)).select(key, "m", "g", "again")
    short = d.where(size <= GRAM + 1).select(key, "m")
    by = [key, "g", "again"]
    met = g.select(*by, F.col("m").alias("a")).join(g.select(*by, F.col("m").alias("b")), by).select(key, "a", "b")
    near = short.select(key, F.col("m").alias("a")).join(d.where(size <= GRAM + 2).select(key, F.col("m").alias("b")), key)
    both = met.unionByName(near).unionByName(near.select(key, F.col("b").alias("a"), F.col("a").alias("b")))
    return both.where("a < b").distinct().where(F.levenshtein("a", "b") <= edits(F.col("a"), F.col("b")))


def clusters(names: DataFrame, key: str = "question_id", name: str = "m") -> DataFrame:
    """key, m, canonical, size: each key's distinct names, the most frequent one of the names that it is linked with (equal ones: the first), and how many those are.

    Names that are alike are linked (`similar`), and links of links belong together. Null names are left out.
    """
    own = names.where(F.col(name).isNotNull()).groupBy(key, F.col(name).alias("m")).agg(F.count(F.lit(1)).alias("c"))
    own = stored(own.withColumn("id", F.concat_ws("|", F.col(key).cast("string"), "m")))
    node = lambda c: F.concat_ws("|", F.col(key).cast("string"), c)
    links = similar(own, key, "m").select(node("a").alias("a"), node("b").alias("b"))
    g = own.join(components(links), "id", "left").withColumn("root", F.coalesce("component", "id"))
    best = g.groupBy("root").agg(F.min_by("m", F.struct(-F.col("c"), F.col("m"))).alias("canonical"), F.count(F.lit(1)).alias("size"))
    return g.join(best, "root").select(key, "m", "canonical", "size")


_NAMES = "m AS (SELECT question_id, lower(unnest(regexp_extract_all(answer, '[A-Z][a-z]{3,}'))) AS m FROM runs), own AS (SELECT question_id, m, count(*) AS c FROM m GROUP BY ALL), link AS (SELECT a.question_id, a.m AS a, b.m AS b FROM own a JOIN own b ON a.question_id = b.question_id AND a.m <> b.m AND abs(length(a.m) - length(b.m)) <= 2 WHERE levenshtein(a.m, b.m) <= CASE WHEN least(length(a.m), length(b.m)) < 8 THEN 1 ELSE 2 END)"


@query(f"WITH RECURSIVE {V.RUNS}, {_NAMES}, reach AS (SELECT question_id, m AS a, m AS b FROM own UNION SELECT r.question_id, r.a, l.b FROM reach r JOIN link l ON l.question_id = r.question_id AND l.a = r.b) SELECT r.question_id, r.a AS mention, arg_min(r.b, (-o.c, r.b)) AS canonical, count(*) AS size FROM reach r JOIN own o ON o.question_id = r.question_id AND o.m = r.b GROUP BY 1, 2")
def mention_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every question's names, gathered with their variants under the most frequent one."""
    m = V.runs(spark, sf_dir).select("question_id", F.explode(F.regexp_extract_all("answer", F.lit(V.ENTITY), F.lit(0))).alias("m")).withColumn("m", F.lower("m"))
    return clusters(m).select("question_id", F.col("m").alias("mention"), "canonical", n(F.col("size"), "size"))
