"""Names found by an automaton and gathered by edit distance, against brute force."""

import random

from loopscope.operators import names


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        row = new
    return row[-1]


def near(a, b):
    return distance(a, b) <= (1 if min(len(a), len(b)) < 8 else 2)


def words(n, seed, alphabet="abc", least=1, most=11):
    rng = random.Random(seed)
    own = ["".join(rng.choices(alphabet, k=rng.randint(least, most))) for _ in range(n)]
    for w in own[: n // 2]:  # variants
        k = rng.randrange(len(w) + 1)
        own.append(w[:k] + rng.choice(alphabet) + w[k + rng.randint(0, 1) :])
    return own


def test_similar_names_equal_brute_force(spark):
    rows = [(q, w) for q in (1, 2) for w in words(120, q)] + [(1, ""), (1, None), (None, "abc"), (2, "x"), (2, "xy"), (2, "yx"), (2, "xyz"), (2, "wxyz")]
    got = {tuple(r) for r in names.similar(spark.createDataFrame(rows, "question_id long, m string")).collect()}
    want = set()
    for q in (1, 2):
        own = sorted({w for x, w in rows if x == q and w is not None})
        want |= {(q, a, b) for i, a in enumerate(own) for b in own[i + 1 :] if near(a, b)}
    assert got == want


def test_clusters_equal_brute_force(spark):
    rows = [(q, w) for q in (1, 2) for w in words(40, q + 7, "abcdefgh", 4, 10)]
    rows += [(1, "madonna"), (1, "madona"), (1, "madonnas"), (1, "madonna"), (2, "madona"), (1, None)]
    got = {(r["question_id"], r["m"]): (r["canonical"], r["size"]) for r in names.clusters(spark.createDataFrame(rows, "question_id long, m string")).collect()}
    want = {}
    for q in (1, 2):
        own = [w for x, w in rows if x == q and w is not None]
        left = set(own)
        while left:
            group, todo = set(), [left.pop()]
            while todo:
                w = todo.pop()
                group.add(w)
                new = {x for x in left if near(w, x)}
                left -= new
                todo += new
            best = min(group, key=lambda w: (-own.count(w), w))
            want |= {(q, w): (best, len(group)) for w in group}
    assert got == want and got[1, "madona"] == ("madonna", 3) and got[2, "madona"][0] != "madonna"


def test_occurring_equals_substrings(spark):
    own = [(q, w.title()) for q in (1, 2) for w in words(30, q, "abÉ", 1, 5)] + [(1, "A"), (1, "a"), (1, ""), (2, None), (9, "ab")]
    texts = [(i, i % 4, t) for i, t in enumerate([*(" ".join(words(6, i, "ABé ", 1, 6)) for i in range(30)), "", None])]
    got = sorted(tuple(r) for r in names.occurring(spark.createDataFrame(texts, "id long, question_id long, answer string"), spark.createDataFrame(own, "question_id long, e string")).collect())
    want = sorted((i, q, e) for i, q, t in texts for p, e in {(p, e) for p, e in own if p == q} if e and t is not None and e.lower() in t.lower())
    assert got == want and got
