import hashlib
import random
import re

import pytest

from loopscope.llm import phrases

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOW))


def windows(items, width):
    out = {}
    for i, text in items:
        w = words(text)
        for k in range(max(len(w) - width + 1, 1) if w else 0):
            out.setdefault(tuple(w[k : k + width]), set()).add("" if i is None else str(i))
    return out


def plain(docs, items, width=10):
    out, test = [], windows(items, width)
    for i, text in docs:
        w, hit, own = words(text), set(), set()
        for k in range(len(w)):
            for n in {len(t) for t in test}:
                if k + n <= len(w) and (t := tuple(w[k : k + n])) in test:
                    hit.update(range(k, k + n))
                    own |= test[t]
        out.append((i, len(w), len(hit), len(own), hashlib.sha256(",".join(sorted(own, key=str.encode)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def corpus(n, seed=0):
    rng = random.Random(seed)
    vocabulary = ["the", "of", "a", "é7", "Wolf", "tree", "x9", "zu"]
    say = lambda k: " ".join(rng.choices(vocabulary, k=k))
    items = [(i, say(k)) for i, k in enumerate([12, 10, 25, 9, 3, 1, 0, 14, 30])]
    items += [(2, "another text of the same id with more than ten words in it"), (None, items[0][1]), (77, None), (78, "..."), (79, items[1][1].upper() + "!"), (80, "Ünï " * 10)]
    docs = []
    for i in range(n):
        text = say(rng.choice([0, 5, 9, 10, 40]))
        if rng.random() < 0.5:
            part = rng.choice(items)[1] or ""
            text += rng.choice([" ", ". ", "  - "]) + part + " " + say(rng.randint(0, 12))
        docs.append((i, text))
    docs += [(n, "the of " * 9_000 + items[2][1] + " wolf" * 3_000 + " " + items[8][1]), (n + 1, None), (n + 2, ""), (None, items[0][1]), docs[0], docs[0], (n + 3, items[0][1] + items[1][1]), (n + 4, "x" * 40_000)]
    return docs, items


def frames(spark, docs, items):
    return spark.createDataFrame([(i, t, 1, "c", 2) for i, t in docs], "doc_id long, text string, row long, item_id string, first int"), spark.createDataFrame(items, "item_id long, text string")


def test_contamination_equals_plain(spark):
    docs, items = corpus(150)
    got = phrases.contamination(*frames(spark, docs, items))
    assert got.columns == ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    got, want = sorted(map(tuple, got.collect()), key=repr), plain(docs, items)
    assert got == want and 0 < sum(r[5] for r in got) < len(got)


def test_blocks_segments_and_whole_vocabulary(spark, monkeypatch):
    docs, items = corpus(60, 1)
    for name, value in (("BLOCK_PAIRS", 20), ("MOST_TERMS", 3), ("CANDIDATES", 50)):
        monkeypatch.setattr(phrases, name, value)
    assert sorted(map(tuple, phrases.contamination(*frames(spark, docs, items)).collect()), key=repr) == plain(docs, items)


def test_other_widths(spark):
    docs, items = corpus(40, 2)
    assert sorted(map(tuple, phrases.contamination(*frames(spark, docs, items), width=3).collect()), key=repr) == plain(docs, items, 3)


def test_empty_tables(spark):
    docs, items = corpus(5, 3)
    assert phrases.contamination(*frames(spark, [], items)).collect() == []
    assert not any(r["contaminated"] for r in phrases.contamination(*frames(spark, docs, [])).collect())


@pytest.mark.parametrize("slop", [0, 2])
def test_matches_equal_plain(spark, slop):
    rng = random.Random(5)
    docs = [(i, " ".join(rng.choices("abcd", k=rng.randint(0, 30)))) for i in range(30)] + [(30, "a b x c d"), (31, "b a c d"), (32, "q " * 20_000 + "a b c d")]
    items = [(1, "a b c d"), (2, "c a"), (3, "a b c d a b")]
    want, test = [], windows(items, 4)
    for i, text in docs:
        w = words(text)
        for t, own in test.items():
            for s in range(len(w)):
                spots = [[p for p in range(max(s + 1, s + k - slop), min(s + k + slop, len(w) - 1) + 1) if w[p] == x] if k else [s] * (w[s] == x) for k, x in enumerate(t)]
                if all(spots):
                    exact = all(s + k in p for k, p in enumerate(spots))
                    want += [(i, int(x), s, exact) for x in own]
    best = {}
    for i, x, s, exact in want:
        best[i, x, s] = best.get((i, x, s), False) or exact
    got = phrases.matches(*frames(spark, docs, items), slop=slop, width=4).collect()
    assert {(r["doc_id"], int(r["item_id"]), r["first"]): r["exact"] for r in got} == best and len(got) == len(best)
    assert all(0 < r["last"] - r["first"] < 4 + slop for r in got) and (slop == 0) == all(best.values())


def test_matches_refuse_a_slop_beyond_the_gaps(spark):
    with pytest.raises(ValueError):
        phrases.matches(*frames(spark, [], []), slop=60)
