import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from loopscope.llm import chunking, resampling

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def runs(text, n=2):
    w = WORD.findall((text or "").translate(LOW))
    return [" ".join(w[i : i + k]) for k in range(1, n + 1) for i in range(len(w) - k + 1)], len(w)


def plain(docs, target, share=25, least=20, seed=7):
    """Rows as resample() gives them, from (doc_id, text) pairs."""
    bucket = lambda f: zlib.crc32(f.encode()) % 10000
    s, t = [0] * 10000, [0] * 10000
    for _, text in docs:
        for f in runs(text)[0]:
            s[bucket(f)] += 1
    for text in target:
        for f in runs(text)[0]:
            t[bucket(f)] += 1
    gain = [math.floor(1000 * math.log((b + 1) * (sum(s) + 10000) / ((a + 1) * (sum(t) + 10000)))) for a, b in zip(s, t)]
    out = []
    for i, text in docs:
        fs, n = runs(text)
        weight = sum(gain[bucket(f)] for f in fs) // len(fs) if fs else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, n, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None])
    enough = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    for k, r in enumerate(enough[: share * len(enough) // 100]):
        r[5] = k + 1
    return sorted(map(tuple, out), key=repr)


def texts(n, seed=0, long=20_000):
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdeéß7", k=rng.randint(1, 9))) for _ in range(300)]
    rows = [(i, " ".join(rng.choices(words, k=rng.choice([0, 1, 19, 20, 21, 80])))) for i in range(n)]
    return rows + [(n, " ".join(rng.choices(words, k=long))), (n + 1, "x" * 70_000 + " Y"), (n + 2, None), (n + 3, ""), (n + 4, " .. "), (None, "a b " * 20), (None, None)]


def test_draw_equals_plain(spark, docs):
    rows = texts(60)
    rows += [rows[5], rows[60], rows[60]]  # repeats, long ones too
    target = [rows[3][1], "Zebra, zebra; a", None, ""]
    got = resampling.resample(docs([(i, t, None, None) for i, t in rows]), spark.createDataFrame([(t, 1) for t in target], "text string, doc_id long"))
    assert got.columns == ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    assert sorted(map(tuple, got.collect()), key=repr) == plain(rows, target)
    chosen = resampling.drawn(docs([(i, t, None, None) for i, t in rows]), got)
    assert "score" in chosen.columns and {r["doc_id"] for r in chosen.collect()} == {r["doc_id"] for r in got.where("rank is not null").collect()} - {None}


def test_ties_go_to_the_smaller_id_and_share_is_floored(spark, docs):
    rows = [(i, "same words " * 15) for i in range(7)]
    got = resampling.resample(docs([(i, t, None, None) for i, t in rows]), spark.createDataFrame([("other",)], "text string"), share=60)
    assert sorted(map(tuple, got.collect()), key=repr) == plain(rows, ["other"], share=60) and got.where("rank > 0").count() == 4
    twice = resampling.resample(docs([(1, rows[0][1], None, None)] * 8), spark.createDataFrame([("other",)], "text string"))
    assert sorted(r["rank"] for r in twice.collect() if r["rank"]) == [1, 2]


def test_empty_tables(spark, docs):
    none = spark.createDataFrame([], "text string")
    assert resampling.resample(docs([]), none).collect() == []
    got = resampling.resample(docs([(1, "a b c", None, None)]), none)
    assert sorted(map(tuple, got.collect()), key=repr) == plain([(1, "a b c")], [])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("abYZ09 .é日\n")), max_size=60), max_size=6), st.integers(1, 4))
def test_buckets_equal_crc32(rows, n):
    rows = [*rows, "x" * 31 + " " + "y" * 32 + " " + "z" * 33 + " " + "é" * 40 + " q"]
    bucket, of, words = resampling.features(pa.array(rows), None, n, 997)
    for i, text in enumerate(rows):
        want, count = runs(text, n)
        assert sorted(bucket[of == i].tolist()) == sorted(zlib.crc32(f.encode()) % 997 for f in want) and words[i] == count


def test_chunks_own_every_run_once(spark):
    rows = [(r[0], r[1]) for r in texts(20, 3, 500)]
    df = spark.createDataFrame([(i, t, "c", 5) for i, t in rows], "doc_id long, text string, chunk string, owned long")
    for carry, size in ((0, 10), (1, 64), (9, 50), (2, 1)):
        got = chunking.chunked(df, "text", chunking.letters_and_digits(), carry, size).collect()
        assert got[0].__fields__ == ["doc_id", "text", "chunk", "first", "owned"]
        for i, t in rows:
            if i is None:
                continue
            w = WORD.findall((t or "").translate(LOW))
            own = sorted((r["chunk"], r["first"], r["owned"], r["text"]) for r in got if r["doc_id"] == i)
            assert sum(r[2] for r in own) == len(w)
            at = 0
            for _, first, owned, text in own:
                assert first == at and WORD.findall(text.translate(LOW)) == w[at : at + owned + carry]
                at += owned


def test_words_as_arrow_strings():
    data = np.frombuffer("ab  cdé x".encode(), "u1")
    start, end = np.array([0, 4, 9]), np.array([2, 8, 10])
    assert chunking.word_strings(data, start, end).to_pylist() == ["ab", "cdé", "x"] and chunking.word_strings(data, start[:0], end[:0]).to_pylist() == []
