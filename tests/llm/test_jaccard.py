import random
import re
import tracemalloc
from collections import Counter, defaultdict

import numpy as np

from loopscope.llm import bytescan, jaccard
from loopscope.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def sets(rows):
    out = {}
    for i, t in rows:
        w = WORD.findall((t or "").translate(LOWER))
        out[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    return out


def brute(rows):
    s, inv, up = sets(rows), defaultdict(list), {i: i for i, _ in rows}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in sorted(s):
        for j, k in Counter(j for g in s[i] for j in inv[g]).items():
            if 100 * k >= 75 * (len(s[i]) + len(s[j]) - k):
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
        for g in s[i]:
            inv[g].append(i)
    return {i: (len(s[i]), root(i)) for i in s}


def corpus(seed, families=14, copies=9):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(4000)]
    passage = " ".join(rng.choices(vocab, k=40))
    rows, k = [], 0
    for _ in range(families):
        base = rng.choices(vocab, k=rng.choice([3, 6, 12, 30, 80, 300]))
        for _ in range(copies):
            w = list(base)
            for _ in range(rng.randint(0, max(1, len(w) // 60))):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            rows.append((k * 7, " ".join(w).upper() if rng.random() < 0.2 else "\n".join(w)))
            k += 1
        rows.append((k * 7, " ".join(base[:60]) + " " + passage))
        k += 1
    return rows + [(100001, None), (100002, ""), (100003, " \n "), (100004, "one"), (100005, "ONE"), (100006, "w1 " * 3000)]


def test_components_against_brute_force(docs):
    rows = corpus(5)
    random.Random(1).shuffle(rows)
    got, links = jaccard.jaccard_join(docs([(i, t, None, None) for i, t in rows]))
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got.collect()} == brute(rows)
    s = sets(rows)
    for a, b in links.collect():
        both = len(s[a] & s[b])
        assert 100 * both >= 75 * (len(s[a]) + len(s[b]) - both)


def test_blocks_of_large_groups(docs, monkeypatch):
    monkeypatch.setattr(jaccard, "GROUP_DOCS", 6)
    rows = corpus(8, families=5, copies=14)
    got, _ = jaccard.jaccard_join(docs([(i, t, None, None) for i, t in rows]))
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got.collect()} == brute(rows)


def test_repeats_and_nothing(docs):
    got, links = jaccard.jaccard_join(docs([(2, "a b c d e f", None, None)] * 2 + [(1, "a b c d e f", None, None), (None, "a b c d e f", None, None), (None, None, None, None)]))
    assert sorted(((r["doc_id"] or 0), r["component_id"] or 0) for r in got.collect()) == [(0, 0), (0, 0), (1, 1), (2, 1), (2, 1)]
    got, links = jaccard.jaccard_join(docs([]))
    assert got.collect() == [] and links.collect() == []


def test_trees_and_keys_lose_no_pair():
    rng = np.random.default_rng(0)
    s = []
    for n in (5, 8, 20, 47, 60, 150, 400):
        base = np.unique(rng.integers(0, 2**63, size=n).astype("u8"))
        for _ in range(40):
            e = rng.random() * 0.35
            s.append(np.unique(np.r_[base[rng.random(len(base)) > e], rng.integers(0, 2**63, size=int(len(base) * e * rng.random())).astype("u8")]))
    s = [x for x in s if len(x)]
    n, maps, keys = np.array([len(x) for x in s]), [jaccard.bitmap(x) for x in s], [set(jaccard.meeting_keys(x).tolist()) for x in s]
    true = set()
    for a in range(len(s)):
        for b in range(a):
            both = len(np.intersect1d(s[a], s[b]))
            if both * 4 >= 3 * (n[a] + n[b] - both):
                true.add((b, a))
                assert keys[a] & keys[b]
    a, b, _ = jaccard.similar(n, maps)
    found = set(zip(np.minimum(a, b).tolist(), np.maximum(a, b).tolist()))
    assert true <= found and len(found) < 1.3 * len(true)
    left, right = np.arange(0, len(s), 2), np.arange(1, len(s), 2)
    a, b, _ = jaccard.similar(n, maps, left, right)
    assert {t for t in true if (t[0] + t[1]) % 2} <= set(zip(np.minimum(a, b).tolist(), np.maximum(a, b).tolist()))


def test_word_hashes_do_not_cross_texts():
    import pyarrow as pa

    t = ["ab cd", "ef", "", "AB  cd\tef gh ij", "ab cd ef gh ij"]
    x = bytescan.shingle_sets(pa.array(t))
    assert [len(v) for v in x] == [1, 1, 0, 1, 1] and x[3][0] == x[4][0] and x[0][0] != x[1][0]


def test_components_of_a_path(spark):
    n = 60
    links = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(100, 101), (5, 5), (None, 3)], "a long, b long")
    got = {r["id"]: r["component"] for r in components(links).collect()}
    assert got == {**{i: 0 for i in range(n + 1)}, 100: 100, 101: 100}


def test_every_link_is_counted(docs, monkeypatch):
    monkeypatch.setattr(jaccard, "LINK_DOCS", 20)
    rng = random.Random(4)
    base = [f"w{i}" for i in range(80)]
    rows = [(i, " ".join(base[:k] + [f"x{i}"] + base[k + 1 :])) for i, k in enumerate(rng.choices(range(80), k=90))]  # near copies, all with different texts
    rows += [(200 + i, rows[0][1]) for i in range(3)] + [(300, "alone and like no other text")]
    got, links = jaccard.jaccard_join(docs([(i, t, None, None) for i, t in rows]))
    s = sets(rows)
    near = {(a, b) for a in s for b in s if a < b and 7 * len(s[a] & s[b]) >= 3 * (len(s[a]) + len(s[b]))}
    assert {r["doc_id"]: r["n_links"] for r in got.collect()} == {i: sum(i in x for x in near) for i in s}
    mine = [(r["a"], r["b"]) for r in links.collect()]
    assert len(mine) == len(set(mine)) and set(mine) == {(a, b) for a, b in near if b < 200}
    assert len(mine) > 2000


def test_texts_of_one_id_are_one_document(docs):
    a, b = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    got = jaccard.jaccard_join(docs([(1, a, None, None), (5, a, None, None), (5, b, None, None), (2, b, None, None), (9, "x y", None, None)]))[0].collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in got) == [(1, 1), (2, 1), (5, 1), (5, 1), (9, 9)]


def test_a_forest_connects_what_pairs_connect():
    rng = np.random.default_rng(2)
    for n, m in ((1, 0), (5, 3), (40, 30), (40, 200), (300, 4000)):
        a, b = rng.integers(0, n, (2, m)) * 7 if m else (np.zeros(0, "i8"),) * 2

        def roots(at):
            up = {i * 7: i * 7 for i in range(n)}
            for i in at:
                x, y = int(a[i]), int(b[i])
                up = {k: up[y] if v == up[x] else v for k, v in up.items()} if up[x] != up[y] else up
            return {frozenset(k for k in up if up[k] == v) for v in up.values()}

        got, want, one = jaccard.forest(a, b), [], {i * 7: i * 7 for i in range(n)}
        for i in range(m):  # pair by pair, earlier ones first
            x, y = one[int(a[i])], one[int(b[i])]
            if x != y:
                want.append(i)
                one = {k: y if v == x else v for k, v in one.items()}
        assert got.tolist() == want and roots(got) == roots(range(m))


def test_a_group_gives_fewer_pairs_than_rows():
    import pyarrow as pa

    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 400).astype("u8")
    sets = [np.unique(np.r_[base[rng.random(400) > 0.04], rng.integers(0, 2**63, 8).astype("u8")]) for _ in range(150)]  # each links with each
    rows = {"token": [1] * 150, "p": [0] * 150, "q": [0] * 150, "id": range(150), "n": [len(x) for x in sets], "comp": range(150), "bits": [jaccard.bitmap(x).tobytes() for x in sets], "block": [0] * 150}
    for best in (True, False):
        got = [list(x) for x in jaccard._candidates(best)(iter([pa.RecordBatch.from_pydict(rows)]))]
        assert sum(len(x[0]) for x in got) == 149


def test_families_just_below_the_similarity(docs, monkeypatch):
    monkeypatch.setattr(jaccard, "LINK_DOCS", 16)
    rng = random.Random(6)
    base = [f"w{i}" for i in range(300)]
    other = base[:251] + [f"v{i}" for i in range(49)]  # 247 of 345 shingles in common: no link, but a hopeful one
    rows = [(rng.getrandbits(40), " ".join(x[:k] + [f"x{k}"] + x[k + 1 :])) for x in (base, other) for k in rng.sample(range(100, 240), 40)]
    far = [(rng.getrandbits(40), " ".join([f"y{i}" for i in range(30)] + other[30:])), (rng.getrandbits(40), " ".join(base[:275] + other[275:]))]  # the second links both families
    for more in (far[:1], far):
        got = jaccard.near_components(docs([(i, t, None, None) for i, t in rows + more])).collect()
        want = brute(rows + more)
        assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want
        assert len({c for _, c in want.values()}) == (2 if len(more) == 1 else 1)


def test_links_that_join_are_enough_and_no_more():
    rng = np.random.default_rng(3)
    s = []
    for n in (20, 60, 150):
        base = rng.integers(0, 2**40, n).astype("u8")
        s += [np.unique(np.r_[base[rng.random(n) > e], rng.integers(0, 2**40, int(n * e)).astype("u8")]) for e in rng.random(30) * 0.2]
    comp = np.array([i % 4 if i < 8 else i for i in range(len(s))])  # some belong together already
    for sides in ((None, None), (np.arange(0, len(s), 2), np.arange(1, len(s), 2))):

        def merged(a, b):
            got = comp.copy()
            for x, y in zip(a, b):
                got[got == got[y]] = got[x]
            return got

        every, some = jaccard.links_between(s, *sides), jaccard.links_between(s, *sides, comp)
        want, got = merged(*every), merged(*some)
        assert [set(np.flatnonzero(want == c)) for c in want] == [set(np.flatnonzero(got == c)) for c in got]
        assert len(some[0]) == len(set(comp)) - len(set(got)) < len(every[0])
        assert set(zip(*some)) <= set(zip(*every))


def test_a_large_group_is_searched_in_bounded_memory():
    import pyarrow as pa

    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 1 << 63, 40, dtype="u8")) for _ in range(1500)]
    base = rng.integers(0, 1 << 63, 30, dtype="u8")
    sets += [np.unique(np.r_[base, rng.integers(0, 1 << 63, 6, dtype="u8")]) for _ in range(1500)]  # all alike: no node pair is ruled out
    n = np.array([len(s) for s in sets])
    rows = pa.table({"token": [1] * len(n), "p": [0] * len(n), "q": [0] * len(n), "id": range(len(n)), "n": n, "comp": range(len(n)), "bits": [jaccard.bitmap(s).tobytes() for s in sets], "block": [0] * len(n)})
    tracemalloc.start()
    got = pa.Table.from_batches(jaccard._candidates(True)(iter(rows.to_batches(2000))))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60e6  # 1.1 million pairs remain, 24 bytes each and several times that on the way
    pairs = jaccard.similar(n, [jaccard.bitmap(s) for s in sets])
    order = np.argsort(-pairs[2], kind="stable")
    keep = order[jaccard.forest(pairs[0][order], pairs[1][order])]
    want = np.unique(np.sort(np.stack([pairs[0][keep], pairs[1][keep]]), 0), axis=1)
    assert len(got) >= 1499 and (np.stack([got["a"].to_numpy(), got["b"].to_numpy()]) == want).all()
