"""Regression of citation rates on provenance and eight scores of a text, with a bootstrap over rows."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loopscope.functions import stats
from loopscope.functions import text as T
from loopscope.operators.influence import _PROVENANCE, _WEIGHT, _with_rates, with_provenance
from loopscope.operators.reruns import LEAD
from loopscope.plans import views as V
from loopscope.plans.registry import n, query, r6

DIMENSIONS = ["overall", "relevance", "accuracy", "thoroughness", "specificity", "up_to_date", "organization", "direct_answer"]
COLUMNS = ["const", "is_answer_derived", "is_ai_original", *DIMENSIONS]
#: Replicates, and the seed of their weights.
REPLICATES, SEED = 1000, 43


def judged(question: Column, text: Column) -> dict[str, Column]:
    """The eight scores of a text, whole numbers from 1 to 5: a deterministic judge that other engines can repeat.

    relevance and direct_answer: how many of the question's words the text and its first sentence hold; accuracy: long
    words; thoroughness: all words; specificity: different words; up_to_date: numbers; organization: lines; overall: their rounded mean.
    """
    w, q, lead = T.words(text), T.token_set(question), T.token_set(F.regexp_extract(text, LEAD, 0))
    part = lambda a, b: (1 + F.least(F.lit(4), F.call_function("div", 4 * a, F.greatest(b, F.lit(1))))).cast("int")
    upto = lambda a: (1 + F.least(F.lit(4), a)).cast("int")
    size = F.size(w)
    out = {
        "relevance": part(F.size(F.array_intersect(T.token_set(text), q)), F.size(q)),
        "accuracy": part(2 * F.size(F.filter(w, lambda t: F.length(t) >= 8)), size),
        "thoroughness": F.when(size >= 512, 5).when(size >= 128, 4).when(size >= 32, 3).when(size >= 8, 2).otherwise(1),
        "specificity": part(F.size(F.array_distinct(w)), size),
        "up_to_date": upto(F.size(F.regexp_extract_all(text, F.lit("[0-9]+"), F.lit(0)))),
        "organization": upto(F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))),
        "direct_answer": part(F.size(F.array_intersect(lead, q)), F.size(q)),
    }
    return out


def regression_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """row_id, y (the citation rate) and COLUMNS of every document whose provenance is known."""
    d = with_provenance(spark, sf_dir).where("provenance <> 'unlabeled'").join(V.questions(spark, sf_dir), "question_id")
    scored = d.withColumns(judged(F.col("question_text"), F.col("text")))
    rest = DIMENSIONS[1:]
    scored = scored.withColumn("overall", F.call_function("div", sum((F.col(c) for c in rest), F.lit(len(rest) // 2)), F.lit(len(rest))))
    kinds = {"const": F.lit(1.0), "is_answer_derived": (F.col("provenance") == "answer_derived").cast("double"), "is_ai_original": (F.col("provenance") == "ai_original").cast("double")}
    return scored.select("row_id", F.col("rate").cast("double").alias("y"), *[c.alias(k) for k, c in kinds.items()], *[F.col(c).cast("double").alias(c) for c in DIMENSIONS])


#: MD5's additive constants and shifts; where rows of as many replicates are hashed at once.
_ADD = [np.uint32(int(abs(math.sin(i + 1)) * 2**32)) for i in range(64)]
_TURN = [t for four in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for t in four * 4]
ROWS_AT_ONCE = 32


def _heads(text: np.ndarray) -> np.ndarray:
    """The first four bytes, as a number, of the MD5 of each of many messages of one length (... x bytes, 55 at most)."""
    size = text.shape[-1]
    block = np.zeros((*text.shape[:-1], 64), "u1")
    block[..., :size], block[..., size] = text, 128
    block[..., 56:58] = size * 8 % 256, size * 8 // 256
    word = [np.ascontiguousarray(block[..., 4 * i : 4 * i + 4]).view("<u4")[..., 0] for i in range(16)]
    a, b, c, d = (np.full(text.shape[:-1], x, "u4") for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476))
    for i in range(64):
        if i < 16:
            f, g = d ^ (b & (c ^ d)), i
        elif i < 32:
            f, g = c ^ (d & (b ^ c)), (5 * i + 1) % 16
        elif i < 48:
            f, g = b ^ c ^ d, (3 * i + 5) % 16
        else:
            f, g = c ^ (b | ~d), 7 * i % 16
        f = f + a + word[g] + _ADD[i]
        a, d, c, b = d, c, b, b + ((f << np.uint32(_TURN[i])) | (f >> np.uint32(32 - _TURN[i])))
    return (a + np.uint32(0x67452301)).byteswap()


def drawn_weights(keys: list[str | None], replicates: int, seed: int) -> np.ndarray:
    """Keys x (1 + replicates): stats.poisson_weight of (seed, key, replicate), and 1 in the first place."""
    out = np.ones((len(keys), replicates + 1))
    begins = [("|".join(str(x) for x in (seed, k) if x is not None) + "|").encode() for k in keys]
    bounds = [round(c, 12) for c in stats.POISSON]
    for size in set(map(len, begins)):
        own = np.array([i for i, b in enumerate(begins) if len(b) == size])
        for digits in range(1, len(str(replicates)) + 1):
            reps = range(10 ** (digits - 1), min(replicates + 1, 10**digits))
            ends = np.frombuffer("".join(map(str, reps)).encode(), "u1").reshape(len(reps), digits)
            for at in np.split(own, range(ROWS_AT_ONCE, len(own), ROWS_AT_ONCE)) if len(reps) else []:
                if size + digits > 55:
                    head = np.array([[int(hashlib.md5(begins[i] + str(r).encode()).hexdigest()[:8], 16) for r in reps] for i in at], "u4")
                else:
                    first = np.frombuffer(b"".join(begins[i] for i in at), "u1").reshape(len(at), 1, size)
                    head = _heads(np.concatenate([np.broadcast_to(first, (len(at), len(reps), size)), np.broadcast_to(ends, (len(at), len(reps), digits))], -1))
                out[at, reps.start : reps.stop] = np.searchsorted(bounds, ((head >> np.uint32(4)) + 0.5) / (1 << 28), "left")
    return out


def cross_sums(rows: DataFrame, columns: list[str], replicates: int, seed: int = SEED, key: str = "row_id") -> DataFrame:
    """rep, n and the weighted sums of all products of two columns and of each with y; rep 0 is the rows as they are.

    A replicate draws each row Poisson(1) times by a keyed hash of row and replicate (stats.poisson_weight). A task takes the product of its rows'
    weights and products, so replicates x columns squared numbers a task are shuffled, whatever the rows. A null product counts as 0.
    """
    both = [(a, b) for i, a in enumerate(columns) for b in [*columns[i:], "y"]]
    names = [f"{a}_x_{b}" for a, b in both]

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, some = np.zeros((replicates + 1, len(both) + 1)), False
        for batch in batches:
            for part in (batch.slice(i, 1024) for i in range(0, len(batch), 1024)):
                x = {c: part.column(i + 1).fill_null(0).to_numpy(zero_copy_only=False) for i, c in enumerate([*columns, "y"])}
                products = np.column_stack([np.ones(len(part)), *[x[a] * x[b] for a, b in both]])
                total, some = total + drawn_weights(part.column(0).to_pylist(), replicates, seed).T @ products, True
        if some:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(replicates + 1)), *map(pa.array, total.T.copy())], names=["rep", "n", *names])

    numbers = rows.select(F.col(key).cast("string").alias("key"), *[F.col(c).cast("double").alias(c) for c in [*columns, "y"]])
    numbers = numbers.repartition(2 * rows.sparkSession.sparkContext.defaultParallelism)  # narrow rows, much work
    parts = numbers.mapInArrow(sums, "rep long, n double, " + ", ".join(f"`{c}` double" for c in names))
    return parts.groupBy("rep").agg(F.sum("n").cast("long").alias("n"), *[F.sum(c).alias(c) for c in names]).where("n > 0")


def solved(sums: DataFrame, columns: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Replicate numbers and least-squares coefficients (of least norm where columns depend on each other): all small systems at once."""
    t = sums.toArrow()  # a row a replicate
    rep, k = t["rep"].to_numpy(), len(columns)
    a, b = np.zeros((len(rep), k, k)), np.zeros((len(rep), k))
    for i, x in enumerate(columns):
        b[:, i] = t[f"{x}_x_y"].to_numpy()
        for j in range(i, k):
            a[:, i, j] = a[:, j, i] = t[f"{x}_x_{columns[j]}"].to_numpy()
    return rep, (np.linalg.pinv(a, rcond=1e-10, hermitian=True) @ b[:, :, None])[:, :, 0]


def bootstrap_ols(rows: DataFrame, columns: list[str], replicates: int = REPLICATES, seed: int = SEED, key: str = "row_id") -> DataFrame:
    """term, coefficient, lo, hi, p_value, n: least squares of y on the columns with 95% intervals over rows drawn again.

    p_value is twice the smaller share of replicates above or below 0. Rows with a null are left out; no rows give no terms.
    """
    spark = rows.sparkSession
    schema = "term string, coefficient double, lo double, hi double, p_value double, n long"
    sums = cross_sums(rows.dropna(subset=["y", *columns]), columns, replicates, seed, key).persist()
    rep, c = solved(sums, columns)
    total = sums.where("rep = 0").select("n").first()
    sums.unpersist()
    if total is None:
        return spark.createDataFrame([], schema)
    point, drawn = c[rep == 0][0], c[rep > 0]
    lo, hi = (np.percentile(drawn, p, axis=0) if len(drawn) else point for p in (2.5, 97.5))
    p = 2 * np.minimum((drawn > 0).mean(0), (drawn < 0).mean(0)) if len(drawn) else np.ones(len(columns))
    return spark.createDataFrame([(x, *map(float, v), int(total["n"])) for x, *v in zip(columns, point, lo, hi, p)], schema)


@query()
def provenance_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citation rate on where a document comes from and eight scores of its text: coefficients, intervals, p-values."""
    got = bootstrap_ols(regression_rows(spark, sf_dir), COLUMNS)
    return got.select("term", *[r6(c, c) for c in ("coefficient", "lo", "hi", "p_value")], "n")


def _sql_judged() -> str:
    w, q, t = V.sql_words("text"), V.sql_tokens("question_text"), V.sql_tokens("text")
    part = lambda a, b: f"1 + least(4, (4 * {a}) // greatest({b}, 1))"
    cols = {
        "relevance": part(f"len(list_intersect({t}, {q}))", f"len({q})"),
        "accuracy": part(f"2 * len(list_filter({w}, lambda t: length(t) >= 8))", f"len({w})"),
        "thoroughness": f"CASE WHEN len({w}) >= 512 THEN 5 WHEN len({w}) >= 128 THEN 4 WHEN len({w}) >= 32 THEN 3 WHEN len({w}) >= 8 THEN 2 ELSE 1 END",
        "specificity": part(f"len(list_distinct({w}))", f"len({w})"),
        "up_to_date": "1 + least(4, len(regexp_extract_all(text, '[0-9]+')))",
        "organization": "1 + least(4, length(text) - length(replace(text, chr(10), '')))",
        "direct_answer": part("len(list_intersect(" + V.sql_tokens(f"regexp_extract(text, '{LEAD}')") + f", {q}))", f"len({q})"),
    }
    one = ", ".join(f"CAST({v} AS BIGINT) AS {k}" for k, v in cols.items())
    return f"sc AS (SELECT row_id, CAST(rate AS DOUBLE) AS y, provenance, {one} FROM pr JOIN questions USING (question_id) WHERE provenance <> 'unlabeled'), x AS (SELECT row_id, y, 1.0::DOUBLE AS const, CAST(provenance = 'answer_derived' AS DOUBLE) AS is_answer_derived, CAST(provenance = 'ai_original' AS DOUBLE) AS is_ai_original, CAST(({' + '.join(DIMENSIONS[1:])} + 3) // 7 AS DOUBLE) AS overall, {', '.join(f'CAST({c} AS DOUBLE) AS {c}' for c in DIMENSIONS[1:])} FROM sc)"


_SUMS = [(a, b) for i, a in enumerate(COLUMNS) for b in [*COLUMNS[i:], "y"]]


@query(f"WITH {_with_rates()}, {_PROVENANCE}, {_sql_judged()}, r AS (SELECT *, unnest(range(0, 21)) AS rep FROM x), u AS (SELECT *, (CAST('0x' || substr(md5(concat_ws('|', {SEED}, row_id, rep)), 1, 7) AS BIGINT) + 0.5) / 268435456.0 AS u FROM r), w AS (SELECT *, CASE WHEN rep = 0 THEN 1 ELSE {_WEIGHT} END AS w FROM u) SELECT CAST(rep AS BIGINT) AS rep, CAST(sum(w) AS BIGINT) AS n, " + ", ".join(f"round(sum(w * {a} * {b}), 6) AS {a}_x_{b}" for a, b in _SUMS) + " FROM w WHERE w > 0 GROUP BY rep")
def bootstrap_cross_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the regression of twenty replicates, and of the rows as they are, is solved from."""
    s = cross_sums(regression_rows(spark, sf_dir), COLUMNS, 20)
    return s.select(n(F.col("rep"), "rep"), n(F.col("n"), "n"), *[r6(f"{a}_x_{b}", f"{a}_x_{b}") for a, b in _SUMS])
