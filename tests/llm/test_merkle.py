import hashlib
import random
import re

from loopscope.llm import merkle


def brute(rows):
    order = sorted(((i, t or "") for i, t in rows), key=lambda r: -r[0])
    out = {}
    for k, (i, t) in enumerate(order):
        nxt, n = order[(k + 1) % len(order)][1], len(t)
        out[i] = (n, hashlib.sha256((t[: n - n // 3] + nxt[: n // 3]).encode()).hexdigest())
    return out


def test_against_brute_force(docs):
    rows = [(3, "One. Two! Three?\nFour é😀 five."), (9, None), (1, "x" * 1000 + "\n\n" + "y. " * 400), (-4, ""), (12, "ab"), (7, "One. Two! Three?\nFour é😀 five.")]
    got = {r["doc_id"]: r for r in merkle.compare_with_edits(docs([(i, t, None, None) for i, t in rows])).collect()}
    assert {i: (r["n_chars"], r["edited_sha256"]) for i, r in got.items()} == brute(rows)
    assert got[3]["fingerprint"] == got[7]["fingerprint"] and got[9]["fingerprint"] == got[-4]["fingerprint"]
    assert len({r["fingerprint"] for r in got.values()}) == 4
    assert got[1]["near_edited"] > 0.5 > got[1]["near_next"]


def test_repeats_nulls_and_nothing(docs):
    rows = [(5, "same text. " * 5, None, None)] * 3 + [(None, "no id", None, None), (4, "other words here", None, None)]
    got = merkle.compare_with_edits(docs(rows)).collect()
    assert len(got) == 5 and sorted(r["near_next"] == 1.0 for r in got if r["doc_id"] == 5) == [False, True, True]
    assert merkle.compare_with_edits(docs([])).collect() == []
    lone = merkle.compare_with_edits(docs([(1, "abcdef", None, None)])).first()
    assert lone["near_next"] == 1.0 and lone["edited_sha256"] == hashlib.sha256(b"abcdab").hexdigest()


def test_buckets(docs, monkeypatch):
    monkeypatch.setattr(merkle, "BUCKET_ROWS", 5)
    rows = [(i * i, f"text number {i}. " * (i % 4)) for i in range(40)]
    got = {r["doc_id"]: (r["n_chars"], r["edited_sha256"]) for r in merkle.compare_with_edits(docs([(i, t, None, None) for i, t in rows])).collect()}
    assert got == brute(rows)


def test_edits_are_located(spark):
    df = spark.createDataFrame([("a b c.\nd e f.\n\ng h i.\n", "a b c.\nd X f.\n\ng h i.\n")], "a string, b string")
    df = merkle.with_fingerprint(merkle.with_fingerprint(df, "a", "fa"), "b", "fb")
    assert [tuple(x) for x in merkle.edits(df, "fa", "fb", "e").first()["e"]] == [(0, 1)]


def plain(text):
    """Root, sections of (digest, paragraphs of (digest, leaves)) by hashlib."""
    sha, out = (lambda s: hashlib.sha256(s.encode()).hexdigest()), []
    for s in re.split(r"(?<=\n\n)(?!\n)", text):
        ps = []
        for p in re.split(r"(?<=\n)", s):
            ls = [sha(x) for x in re.findall(merkle.PIECE, p)]
            ps.append((sha("".join(ls)), ls))
        out.append((sha("".join(d for d, _ in ps)), ps))
    return sha("".join(d for d, _ in out)), out


def alike(a, b):
    """Likeness by walking both plain trees."""
    if a[0] == b[0]:
        return 1.0
    one, two = ({d: ps for d, ps in t[1]} for t in (a, b))
    pa, pb = ({d: ls for k in s.keys() - o.keys() for d, ls in s[k]} for s, o in ((one, two), (two, one)))
    both = sum(len(ls) for k in one.keys() & two.keys() for _, ls in one[k]) + sum(len(pa[d]) for d in pa.keys() & pb.keys())
    x, y = ({z for d in p.keys() - o.keys() for z in p[d]} for p, o in ((pa, pb), (pb, pa)))
    every = 2 * both + len(x) + len(y)
    return 2 * (both + len(x & y)) / every if every else 0.0


def test_fingerprints_and_likeness_against_plain_trees(spark):
    rng = random.Random(6)
    words = ["one", "two. ", "three\n", "four!\n\n", "é😀 ", "\n", "x" * 70]
    texts = ["".join(rng.choices(words, k=rng.randint(0, 40))) for _ in range(60)]
    pairs = [(t, "".join(t.partition("two. ")[::2]) if rng.random() < 0.6 else rng.choice(texts)) for t in texts] + [("", ""), ("", "a"), ("long " * 50000, "long " * 49999)]
    df = spark.createDataFrame(pairs, "a string, b string")
    df = merkle.with_fingerprint(merkle.with_fingerprint(df, "a", "fa"), "b", "fb")
    df = merkle.likeness(df, "fa", "fb", "near")
    for r in df.collect():
        a, b = plain(r["a"]), plain(r["b"])
        assert r["fa"] == a[0] + ":" + ";".join(d[:12] + "=" + ",".join(e[:12] + "-" + "".join(z[:12] for z in ls) for e, ls in ps) for d, ps in a[1])
        assert abs(r["near"] - alike(a, b)) < 1e-12 and 0 <= r["near"] <= 1


def test_very_long_texts_and_extra_columns(docs):
    rows = [(1, "A sentence here. " * 60_000, None, None), (2, "Another one.\n\n" * 9_000, None, None)]
    df = docs(rows).selectExpr("*", "1 as id", "2 as tie", "3 as fingerprint", "4 as next", "5 as _nodes")
    got = {r["doc_id"]: (r["n_chars"], r["edited_sha256"]) for r in merkle.compare_with_edits(df).collect()}
    assert got == brute([(i, t) for i, t, _, _ in rows])
