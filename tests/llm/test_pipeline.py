"""Each stage against a plain version, on the driver's smallest tables."""

import hashlib
import os
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")
SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_are_the_ones_asked_for():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "toxicity", "ngram_jaccard", "mix_sources", "sentencepiece"]


def test_dedup_keeps_the_smallest_of_each_group(spark):
    rng = random.Random(0)
    base = [" ".join(rng.choices([f"w{i}" for i in range(500)], k=60)) for _ in range(8)]
    rows = [(i, base[i % 8] + (" extra" if i > 20 else ""), "en", "s", 1) for i in range(32)] + [(50, "", "en", "s", 0), (51, "", "en", "s", 0), (52, None, "en", "s", None), (None, "x y z", "en", "s", 5), (3, base[3], "en", "s", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.keep_one_of_near_duplicates(spark, df, SF)
    assert got.columns == COLUMNS
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in got.collect()) == [(False, i) for i in (*range(8), 50, 51, 52)] + [(True, 0)]


def test_mix_repeats_whole_rows(spark):
    df = spark.createDataFrame([(i, "w " * (i % 9 + 1), "en", "ab"[i % 3 == 0], 1) for i in range(120)], "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.mix_sources(spark, df, SF)
    counts = {r["doc_id"]: r["count"] for r in got.groupBy("doc_id").count().collect()}
    assert got.columns == COLUMNS and set(counts.values()) <= {1, 2}


def test_mix_counts_each_row_of_a_repeated_id(spark):
    rows = [(None if i % 2 else 7, "" if i % 5 else "w " * (i % 4), "en", "abc"[i % 10 // 4], i) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    want = {r["source"]: r["n"] for r in corpus_pipeline.mixing.mix(df).groupBy("source").agg(F.sum("copies").alias("n")).collect()}
    got = corpus_pipeline.mix_sources(spark, df, SF)
    assert got.columns == COLUMNS
    assert {r["source"]: r["count"] for r in got.groupBy("source").count().collect()} == {s: n for s, n in want.items() if n}
    times = {r["n_chars"]: r["count"] for r in got.groupBy("n_chars").count().collect()}
    assert len(times) < 300 and set(times.values()) == {1, 2}


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
def test_whole_run(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    first = corpus_pipeline.keep_known_languages(spark, docs, SF)
    assert first.columns == docs.columns and first.count() >= 0.9 * docs.count()
    second = corpus_pipeline.drop_toxic(spark, first, SF)
    clean = first.join(labels.where("toxic = 0"), "doc_id", "left_semi").count()
    assert second.join(labels.where("toxic = 0"), "doc_id", "left_semi").count() >= 0.95 * clean
    out = corpus_pipeline.run(spark, SF)
    assert out.where(F.col("n_tokens") < 2).count() == 0 and set(out.columns) == {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"}


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def _odd(spark):
    """Nulls in every column, empty and very long texts, repeated rows and ids, a clashing extra column."""
    rng = random.Random(3)
    words = "the quick brown fox jumps over lazy dogs and then some other words come along here".split()
    rows = [(i, " ".join(rng.choices(words, k=rng.randint(6, 40))), "en", rng.choice(["a", "b", None]), i) for i in range(60)]
    rows += [(3, rows[3][1], "en", "a", 3)] * 2 + [(3, "an unlike text under the same id as another one has", "en", "a", None), (None, None, None, None, None), (None, rows[5][1], None, "b", 1), (None, "", "en", None, 0), (70, "  \n ", None, "a", 4), (71, "the lazy dog " * 40_000, "en", "c", None), (72, "12 !? 34", "en", "a", 8)]
    return spark.createDataFrame(rows, SCHEMA).withColumns({"rejected": F.lit("x"), "_row": F.lit(1), "toxicity": F.lit(0), "copies": F.lit(9)})


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
@pytest.mark.parametrize("stage", [f for _, f in corpus_pipeline.STAGES[:4]])
def test_stages_on_odd_rows_and_on_nothing(spark, stage):
    docs = _odd(spark)
    got = stage(spark, docs, SF)
    assert got.columns == docs.columns and got.dtypes == docs.dtypes and 0 < got.count() <= 2 * docs.count()
    assert {str(r) for r in got.collect()} <= {str(r) for r in docs.collect()}
    none = stage(spark, docs.limit(0), SF)
    assert none.columns == docs.columns and none.count() == 0


def test_language_stage_against_the_model_row_by_row(spark):
    docs = _odd(spark).withColumn("k", F.xxhash64("doc_id", "text", "source", "n_chars"))
    model = corpus_pipeline.langid.train(docs.where("doc_id is null or crc32(cast(doc_id as string)) % 5 <> 0"))
    texts = docs.select("k", "text").collect()
    bad = model.answer(pa.array([r["text"] or "" for r in texts]))[3]
    got = {r["k"] for r in corpus_pipeline.keep_known_languages(spark, docs, SF).collect()}
    assert got == {r["k"] for r, b in zip(texts, bad) if not b} and 60 <= len(got) < len({r['k'] for r in texts})


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
def test_toxicity_stage_against_the_field_row_by_row(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = corpus_pipeline.toxicity.train(docs, labels, F.expr("crc32(cast(doc_id as string)) % 3 <> 1"))
    rows = docs.collect()
    score = [model.score(model.tagged(pa.array([r["text"] or ""]))[0])[0] for r in rows]
    got = {r["doc_id"] for r in corpus_pipeline.drop_toxic(spark, docs, SF).collect()}
    assert got == {r["doc_id"] for r, s in zip(rows, score) if s < 0.7} and len(got) < len(rows)


def shingles(text):
    w = [x for x in re.split("[\x20\x09-\x0d]+", (text or "").translate({c: c + 32 for c in range(65, 91)})) if x]
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def test_dedup_stage_against_brute_force(spark):
    docs = _odd(spark)
    rows = docs.collect()
    sets, left = [shingles(r["text"]) for r in rows], set(range(len(rows)))
    want = []
    while left:
        group, edge = set(), {min(left)}
        while edge:
            i = edge.pop()
            group.add(i)
            edge |= {j for j in left - group if sets[i] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])}
        left -= group
        want.append(min((rows[i]["doc_id"] is None, rows[i]["doc_id"] or 0) for i in group))
    got = corpus_pipeline.keep_one_of_near_duplicates(spark, docs, SF).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in got) == sorted(want)


def test_sentencepiece_stage_against_the_library(spark):
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = []
    for r in _odd(spark).collect():
        ids = sp.encode(r["text"] or "", add_bos=True, add_eos=True)
        want.append((str(r["doc_id"]), len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(sp.decode(ids).encode()).hexdigest()))
    got = corpus_pipeline.encode_pieces(spark, _odd(spark), SF)
    assert sorted((str(r[0]), *r[1:]) for r in got.collect()) == sorted(want)
    assert corpus_pipeline.encode_pieces(spark, _odd(spark).limit(0), SF).count() == 0


def test_language_bounds_come_from_all_rows(spark, docs):
    rng = random.Random(3)
    plain = [(i, " ".join(rng.choices("the quick brown fox jumps over a lazy dog".split(), k=200)), "en", "s") for i in range(7500)]
    learned = [i for i in range(100_000, 101_000) if zlib.crc32(str(i).encode()) % 5][:9]
    odd = [(i, " ".join("".join(rng.choices("qxzjvkw", k=5)) for _ in range(200)), "en", "s") for i in learned]  # more than a thousandth of what is learned from
    kept = corpus_pipeline.keep_known_languages(spark, docs(plain + odd), "")
    assert {r["doc_id"] for r in kept.select("doc_id").collect()} >= set(learned)


def test_language_stage_learns_from_every_row(spark, docs):
    rng = random.Random(4)
    made = lambda words: " ".join(rng.choices(words, k=60))
    rest = [i for i in range(4000) if zlib.crc32(str(i).encode()) % 5 == 0][:40]
    rows = [(10_000 + i, made("the quick brown fox jumps over a lazy dog".split()), "en", "s") for i in range(60)]
    rows += [(i, made("быстрая лиса прыгает через ленивую собаку".split()), "ru", "s") for i in rest]  # all of them in op3's held-out fold
    rows += [(None, made("η γρήγορη αλεπού πηδάει πάνω από το σκυλί".split()), "el", "s") for _ in range(20)]
    kept = corpus_pipeline.keep_known_languages(spark, docs(rows), "").groupBy("lang").count().collect()
    assert {r["lang"]: r["count"] for r in kept} == {"en": 60, "ru": 40, "el": 20}
