import random
import re
from collections import Counter, defaultdict

from loopscope.llm import divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, least=3, most=200):
    """The audit's rows, from (text, lang, source) triples, with every zero count visited."""
    seen, count, docs = defaultdict(set), defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        seen[lang].add(source)
        terms = TERM.findall((text or "").translate(LOW))
        count[lang, source].update(terms)
        docs[lang].update(set(terms))
    out = []
    for lang, sources in seen.items():
        kept = [t for t, d in docs[lang].items() if d >= least]
        share = lambda c: {t: 1 + 10**9 * (c[t] + 1) // (sum(c[x] for x in kept) + len(kept)) for t in kept}
        p = {s: share(count[lang, s]) for s in sources}
        whole = share(sum((count[lang, s] for s in sources), Counter()))
        gap = lambda a, b: (a - b) * (a - b) // b
        for s in sources:
            pairs = [(o, sum(gap(p[s][t], p[o][t]) for t in kept)) for o in sources if o != s]
            terms = [(t, gap(p[s][t], whole[t])) for t in kept if count[lang, s][t] and p[s][t] > whole[t]]
            for part, items, upto in (("pair", pairs, None), ("term", terms, most)):
                items.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, *x, k + 1) for k, x in enumerate(items[:upto])]
    return sorted(out)


def corpus(n, seed=0):
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcDEéß", k=rng.randint(1, 4))) for _ in range(60)]
    rows = [(" ".join(rng.choices(words, k=rng.randint(0, 40))) + " x1y_z", rng.choice(["en", "de"]), rng.choice(["s0", "s0", "s0", "s1", "s2"])) for _ in range(n)]
    rows += [(None, "en", "s9"), ("", "fr", "s1"), ("one two", "fr", "s2"), ("a b", None, None), (None, None, "s1"), ("7 8 .", "en", None), ("long " * 30_000 + "tail", "en", "s1")]
    return rows + [("copy of all words", "de", "s2")] * 5 + [("only", "es", "s5")] * 3


def run(spark, rows, **more):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "text string, lang string, source string, rank int, item string")
    out = divergence.audit(df, **more)
    assert out.columns == ["lang", "source", "part", "item", "value", "rank"]
    return sorted(map(tuple, out.collect()))


def test_audit_equals_plain(spark):
    rows = corpus(200)
    got = run(spark, rows)
    assert got == plain(rows) and any(r[2] == "term" for r in got) and all(r[3] != r[1] for r in got if r[2] == "pair")


def test_ranks_and_least(spark):
    rows = corpus(80, 1)
    assert run(spark, rows, least=1, most=3) == plain(rows, 1, 3)


def test_ties_and_no_terms(spark):
    rows = [("b a c", "en", "s1")] * 3 + [("d", "en", "s2")] * 3 + [(None, "de", "s1"), (None, "de", "s2")]
    got = run(spark, rows)
    assert got == plain(rows) and ("de", "s1", "pair", "s2", 0, 1) in got
    assert [r[3] for r in got if r[1] == "s1" and r[2] == "term"] == ["a", "b", "c"]


def test_held_rows_are_handed_on(spark, monkeypatch):
    rows = corpus(50, 2)
    df = spark.createDataFrame(rows, "text string, lang string, source string")
    want = sorted(map(tuple, divergence.term_counts(df).collect()), key=repr)
    parts = df.toArrow().select(["text", "lang", "source"]).combine_chunks().to_batches(7)
    monkeypatch.setattr(divergence, "HELD_ROWS", 20)
    total = Counter()
    for b in divergence._counts(iter(parts)):
        for r in b.to_pylist():
            total[r["lang"], r["source"], r["term"]] += r["n"]
    assert sorted(((*k, n) for k, n in total.items()), key=repr) == [r[:4] for r in want]


def test_empty(spark):
    assert run(spark, []) == []


def test_index_and_pairs_do_not_depend_on_batches(monkeypatch):
    import pyarrow as pa

    rng = random.Random(4)
    rows = [(lang, term, f"s{k}", rng.randint(1, 3), rng.randint(1, 2)) for lang in ("de", "en") for term in sorted(f"t{i}" for i in range(40)) for k in range(rng.randint(1, 9))]
    table = pa.table([list(x) for x in zip(*rows)], names=["lang", "term", "source", "n", "docs"])
    want = defaultdict(list)
    for lang, term, source, n, docs in rows:
        want[lang, term].append((source, n, docs))
    want = {k: [(s, n) for s, n, _ in v] for k, v in want.items() if sum(d for *_, d in v) >= 4}
    pairs = Counter((k[0], *x, *y) for k, v in want.items() for i, x in enumerate(v) for y in v[i + 1 :])
    for built, held, size in ((50_000, 10**6, 1000), (7, 5, 3), (1, 1, 1)):
        monkeypatch.setattr(divergence, "BUILT_ROWS", built)
        monkeypatch.setattr(divergence, "HELD_PAIRS", held)
        out = list(divergence._postings(4)(iter(table.to_batches(size))))
        got = [r for b in out for r in b.to_pylist()]
        assert {(r["lang"], r["term"]): [(p["source"], p["n"]) for p in r["postings"]] for r in got} == want and len(got) == len(want)
        assert all(r["total"] == sum(p["n"] for p in r["postings"]) for r in got)
        met = Counter()
        for b in divergence._pairs(iter([b.select(["lang", "postings"]) for b in out if len(b)])):
            for r in b.to_pylist():
                met[r["lang"], r["a"], r["n_a"], r["b"], r["n_b"]] += r["m"]
        assert met == pairs
    assert [b.num_rows for b in divergence._postings(1)(iter([]))] == []
