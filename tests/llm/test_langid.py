import math
import random

import numpy as np
import pyarrow as pa
import pytest

from loopscope.llm import langid

EN = "the quick brown fox jumps over the lazy dog and then the cat sat on the mat with another small bird".split()
DE = "der schnelle braune fuchs springt über den faulen hund und dann saß die katze auf der matte mit vögeln".split()


def sentences(words, n, seed):
    rng = random.Random(seed)
    return [" ".join(rng.choices(words, k=12)) for _ in range(n)]


def test_grams():
    keys, n = langid.grams(pa.array(["Ab c", "", "!!", "é."]))
    assert n.tolist() == [5, 0, 0, 2]
    assert [hex(int(k)) for k in keys[:2]] == ["0x20002000200061", "0x20002000610062"]


def test_grams_of_letters_beyond_16_bits():
    a, b = "\U00010400\U00020000b", "\U00010428\U00020001b"  # a capital and its small letter; unlike ideographs
    keys, n = langid.grams(pa.array([a, b, "x"]))
    low = ("\U00010428\U00020000b ", "\U00010428\U00020001b ", "x ")
    want = []
    for t in low:
        u = np.frombuffer(t.encode("utf-16-le"), "u2").tolist()
        want += [sum(x << (16 * k) for k, x in enumerate(reversed(([32] * 3 + u)[i : i + 4]))) for i in range(len(u))]
    assert n.tolist() == [6, 6, 2] and keys.tolist() == want


def plain_kneser_ney(texts):
    """Probabilities by the textbook recursion over dictionaries."""
    from collections import Counter

    grams = Counter()
    for t in texts:
        t = "   " + t + " "
        grams.update(t[i - 3 : i + 1] for i in range(3, len(t)))
    levels = [grams]
    for _ in range(3):
        levels.append(Counter(g[1:] for g in levels[-1]))

    def p(gram, level=0):
        if level == 4:
            return 1 / (len(levels[3]) + 1)
        c, g = levels[level], gram[level:]
        ones, twos = sum(v == 1 for v in c.values()), sum(v == 2 for v in c.values())
        d = ones / (ones + 2 * twos) if ones and twos else 0.5
        own = [v for k, v in c.items() if k[:-1] == g[:-1]]
        low = p(gram, level + 1)
        return low if not own else max(c[g] - d, 0) / sum(own) + d * len(own) / sum(own) * low

    return p


def test_model_against_the_textbook_recursion():
    texts = sentences(EN, 6, 1)
    keys, _ = langid.grams(pa.array(texts))
    m, p = langid.Model(*np.unique(keys, return_counts=True)), plain_kneser_ney(texts)
    for gram in (" the", "the ", "quic", "xqzj", "zzth", "er z", "   q", "at x"):
        key = sum(ord(x) << (16 * k) for k, x in enumerate(reversed(gram)))
        assert m.prob(np.array([key], "u8"))[0] == pytest.approx(p(gram), rel=1e-9)


def test_ties_go_to_the_first_name(docs):
    rows = [(i, t, lang, "s") for i, t in enumerate(sentences(EN, 30, 1)) for lang in ("zz", "aa")]
    got = langid.identify(docs([(1, "the dog", None, None)]), langid.train(docs(rows))).first()
    assert got["lang_pred"] == "aa" and got["lang_score"] == pytest.approx(0.5)


def test_clashing_names(docs):
    model = langid.train(docs([(i, t, "en", "s") for i, t in enumerate(sentences(EN, 30, 1))]))
    df = docs([(1, "the dog", None, None)]).selectExpr("*", "1 as _text", "2 as `a.b`", "'x' as rejected")
    for m in (model, None):
        got = langid.identify(df, m)
        assert got.columns == [c for c in df.columns if c != "rejected"] + ["lang_pred", "lang_score", "cross_entropy", "rejected"] and got.count() == 1


def test_model_is_a_distribution():
    keys, n = langid.grams(pa.array(sentences(EN, 40, 1)))
    k, c = np.unique(keys, return_counts=True)
    m = langid.Model(k, c)
    context = k[5] >> np.uint64(16)
    letters = np.unique(k & np.uint64(0xFFFF))
    total = m.prob((context << np.uint64(16)) | letters).sum()
    assert total == pytest.approx(1, abs=m.base * 1.01)  # the base keeps one share for unseen characters


def test_hashed_finds_what_is_there():
    keys = np.unique(np.random.default_rng(0).integers(0, 1 << 60, 5000).astype("u8"))
    h = langid.Hashed(keys)
    at = h.find(keys)
    assert (keys[h.order][at] == keys).all() and (h.find(keys + np.uint64(1 << 61)) == -1).all()


def test_identify(spark, docs):
    rows = [(i, t, "en", "s") for i, t in enumerate(sentences(EN, 60, 1))] + [(100 + i, t, "de", "s") for i, t in enumerate(sentences(DE, 60, 2))]
    model = langid.train(docs(rows))
    test = [(1, "the small cat jumps over the dog", "x", "s"), (2, "die katze springt über die matte", None, None), (3, None, "en", "s"), (4, "", "en", "s"), (5, "123 !?", "en", "s"), (6, "zzzq xxyw qqqk vvvj " * 9, "en", "s"), (1, "the small cat jumps over the dog", "x", "s"), (None, "the dog", "en", "s"), (9, "the fox " * 40000, "en", "s")]
    got = langid.identify(docs(test), model).collect()
    assert len(got) == len(test) and "score" in got[0].asDict()
    by = {r["doc_id"]: r for r in got}
    assert [by[i]["lang_pred"] for i in (1, 2, 3, 4, 5, 9)] == ["en", "de", "und", "und", "und", "en"]
    assert by[6]["rejected"] and not by[1]["rejected"] and not by[2]["rejected"]
    assert all(0 <= r["lang_score"] <= 1 and math.isfinite(r["cross_entropy"]) for r in got)


def test_nothing_to_learn(docs):
    assert langid.train(docs([(1, "a", None, "s"), (2, None, "en", "s")])) is None
    assert [r["lang_pred"] for r in langid.identify(docs([(1, "abc", None, None)]), None).collect()] == ["und"]
    assert langid.identify(docs([]), None).collect() == []


def test_no_gram_is_dropped(docs, monkeypatch):
    monkeypatch.setattr(langid, "MAX_GRAMS", 50, raising=False)
    texts = sentences(EN, 60, 1)
    model = langid.train(docs([(i, t, "en", "s") for i, t in enumerate(texts)]))
    keys, _ = langid.grams(pa.array(texts))
    assert model.table.n == len(np.unique(keys)) > 50


def test_bounds_and_scale_come_from_all_rows(docs):
    rows = [(i, t, lang, "s") for lang, words in (("en", EN), ("de", DE)) for i, t in enumerate(sentences(words, 3000, len(lang + words[0])))]
    rng = random.Random(5)
    rows += [(9000 + i, " ".join("".join(rng.choices("qxzjvkw", k=5)) if rng.random() < i / 40 else rng.choice(EN) for _ in range(12)), "en", "s") for i in range(40)]
    model = langid.train(docs(rows))
    e, n = model.entropies(pa.array([r[1] for r in rows]))
    truth = np.array([model.langs.index(r[2]) for r in rows])
    for i in range(2):
        assert model.most[i] == pytest.approx(1.15 * np.quantile(e[truth == i, i], 0.999), abs=1.2e-4)
    gap = e - e.min(1, keepdims=True)
    fits = [(-s * gap[np.arange(len(e)), truth] - np.log(np.exp(-s * gap).sum(1))).sum() for s in 2.0 ** np.arange(9)]
    assert model.scale == 2.0 ** np.argmax(fits)
