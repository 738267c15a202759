import hashlib
import io
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from loopscope.llm import bitplanes, pieces

MODEL, WORDS = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("word_bpe_49k.json")
SP, TOK = sentencepiece.SentencePieceProcessor(model_file=MODEL), Tokenizer.from_file(WORDS)
TEXTS = ["", " ", "  ", "   a", "a  b", "a ", "\n", " \n\n x", "▁x", "a▁b", "é", "é", "ﬁ", "\x00a", "😀😀", "a\tb", " " * 50 + "word" + " " * 31, "Straße, naïve.", "日本語テスト", "a\r\nb", "İstanbul Σας it's we'll 12ab", "x" * 3000]
ODD = st.text(alphabet=st.sampled_from(list("abcdehinorst  ,.!?\n\t'ABCéüñß123█😀▁日")), max_size=60)


@settings(max_examples=300, deadline=None)
@given(ODD)
def test_pieces_equal_the_library(s):
    e = pieces.encoder(MODEL)
    want = SP.encode(s, add_bos=True, add_eos=True)
    assert np.frombuffer(e.encode(s), "<u4").tolist() == want and e.decode(e.encode(s)) == SP.decode(want)


@pytest.mark.parametrize("s", TEXTS)
def test_pieces_on_cases(s):
    test_pieces_equal_the_library.hypothesis.inner_test(s)


def test_prefix_table_equals_merges():
    e, rng = pieces.encoder(MODEL), random.Random(0)
    for _ in range(300):
        s = "▁" + "".join(rng.choices("abcdeghilmnorstuy", k=rng.randint(1, 24)))
        assert e.table(s) == e.merges(s)


def test_pieces_columns(spark, docs):
    rows = [(i, t, None, None) for i, t in enumerate(TEXTS)] + [(99, None, None, None), (0, "", None, None), (None, "x", None, None)]
    got = pieces.digests(docs(rows), MODEL).collect()
    for r, (i, t, _, _) in zip(sorted(got, key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["n_tokens"])), sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))):
        ids = SP.encode(t or "", add_bos=True, add_eos=True)
        assert (r["doc_id"], r["n_tokens"], r["ids_sha256"]) == (i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
    back = pieces.decode(pieces.encode(docs(rows), MODEL), MODEL).collect()
    assert len(back) == len(rows) and all(r["decoded"] == SP.decode(SP.encode(r["text"] or "")) for r in back)
    assert pieces.digests(docs([]), MODEL).collect() == []


@settings(max_examples=200, deadline=None)
@given(ODD)
def test_word_tokens_equal_the_library(s):
    want = TOK.encode(s, add_special_tokens=False).ids
    assert bitplanes.tokens(WORDS).encode(pa.array([s]))[0].tolist() == want
    ids, count = bitplanes.tokens(WORDS).encode(pa.array(["", s, "x", s]), 2)
    assert count.tolist() == [1, len(want) + 1, 2, len(want) + 1] and ids.tolist() == [2, *want, 2, *TOK.encode("x").ids, 2, *want, 2]


@pytest.mark.parametrize("s", TEXTS)
def test_word_tokens_on_cases(s):
    test_word_tokens_equal_the_library.hypothesis.inner_test(s)


def test_word_tokens_of_every_code_point():
    """Alone, between letters, and before punctuation: all of Unicode, in arrays of 20,000 texts."""
    t, points = bitplanes.tokens(WORDS), [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    points = [c for c in points if ord(c) < 0x3100 or ord(c) % 97 == 0 or 0xFE00 <= ord(c) < 0x10000 or 0x1F300 <= ord(c) < 0x1F700]
    texts = [f"{c} ab{c}cd {c}. E{c}" for c in points]
    for k in range(0, len(texts), 20_000):
        part = texts[k : k + 20_000]
        want = [e.ids for e in TOK.encode_batch(part, add_special_tokens=False)]
        ids, count = t.encode(pa.array(part))
        got = np.split(ids, np.cumsum(count)[:-1])
        wrong = [hex(ord(points[k + i])) for i, (a, b) in enumerate(zip(got, want, strict=True)) if a.tolist() != b]
        assert not wrong


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from(list("ab \u00a0\u0085\u2003\u0301\u0327.,«»£²½·©ªµº\u200d"))), max_size=40))
def test_word_tokens_of_any_text_equal_the_library(s):
    assert bitplanes.tokens(WORDS).encode(pa.array([s]))[0].tolist() == TOK.encode(s, add_special_tokens=False).ids


class Source(io.BytesIO):
    def size(self):
        return len(self.getvalue())


@pytest.mark.parametrize("mode", ["bit", "byte"])
@pytest.mark.parametrize("block", [8, 1000])
def test_files_round_trip(mode, block):
    rng = np.random.default_rng(0)
    docs = [(i if i != 3 else None, rng.integers(0, 1 << int(rng.integers(1, 33)), int(rng.integers(0, 60)), dtype="u8").astype("u4")) for i in range(40)]
    out = Source()
    out.close, raw = (lambda: None), out
    w = bitplanes.Writer(out, mode, block)
    for d, ids in docs:
        w.add(d, ids)
    w.close()
    r = bitplanes.Reader(Source(raw.getvalue()))
    got = list(r.documents())
    assert [g[0] for g in got] == [d[0] for d in docs] and all((g[1] == d[1]).all() for g, d in zip(got, docs))
    assert r.index["ids"] == sum(len(d[1]) for d in docs) and (r.block(0) == np.concatenate([d[1] for d in docs])[:block]).all()
    with pytest.raises((ValueError, OSError)):
        bitplanes.Reader(Source(raw.getvalue()[:-9] + b"x" * 9))


def test_write_and_read(spark, docs, tmp_path, monkeypatch):
    monkeypatch.setattr(bitplanes, "FILE_DOCS", 5)
    rows = [(i * 3 % 100, t, None, None) for i, t in enumerate(TEXTS)] + [(-7, None, None, None), (0, "again", None, None), (None, "no id", None, None)]
    files = bitplanes.write(docs(rows), WORDS, 2, folder=str(tmp_path / "f"))
    assert len(files) > 3
    got = sorted(bitplanes.read(spark, files).collect(), key=lambda r: r["start"])
    ids = [r["doc_id"] for r in got]
    assert ids[:-1] == sorted(r[0] for r in rows if r[0] is not None) and ids[-1] is None
    at, text = 0, {}
    for i, t, _, _ in rows:
        text.setdefault(i, []).append(np.array([*TOK.encode(t or "", add_special_tokens=False).ids, 2], "<u4"))
    for r in got:
        assert r["start"] == at and (r["n_tokens"], r["ids_crc32"]) in {(len(x), zlib.crc32(x)) for x in text[r["doc_id"]]}
        at += r["n_tokens"]
    assert bitplanes.read(spark, bitplanes.write(docs([]), WORDS, 2, folder=str(tmp_path / "g"))).collect() == []


def test_words_forgotten_and_long_words(monkeypatch):
    monkeypatch.setattr(bitplanes, "REMEMBERED", 8)
    t, rng = bitplanes.Tokens(WORDS), random.Random(1)
    for _ in range(40):
        s = " ".join(rng.choice(["ab", "Cd,", "e'll", "x" * 400, "日本", "<|ENDOFTEXT|>", "<|endoftext|>", f"w{rng.random()}"]) for _ in range(12))
        assert t.encode(pa.array([s]))[0].tolist() == TOK.encode(s, add_special_tokens=False).ids


def test_other_tokenizers_are_refused():
    with pytest.raises(ValueError):
        bitplanes.Tokens(public_tokenizers.path("byte_bpe_50k.json"))


def test_hot_ids_fill_buckets_of_their_own(spark, docs, tmp_path, monkeypatch):
    monkeypatch.setattr(bitplanes, "FILE_DOCS", 5)
    rows = [(7, f"a {i}", None, None) for i in range(30)] + [(None, "same", None, None)] * 22 + [(i, "b", None, None) for i in range(20)]
    files = bitplanes.write(docs(rows), WORDS, 2, folder=str(tmp_path / "f"))
    assert max(n for _, n, _ in files) <= 15 and len(files) > 12
    got = sorted(bitplanes.read(spark, files).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == sorted(r[0] for r in rows if r[0] is not None) + [None] * 22
    at = 0
    for r in got:
        assert r["start"] == at
        at += r["n_tokens"]
    crc = lambda t: zlib.crc32(np.array([*TOK.encode(t, add_special_tokens=False).ids, 2], "<u4"))
    assert sorted((r["doc_id"] or -1, r["ids_crc32"]) for r in got) == sorted((i or -1, crc(t)) for i, t, _, _ in rows)


def test_large_ids_keep_32_bits():
    ids = np.array([0, 1 << 31, 65536, 5], "u4")
    for mode in ("bit", "byte"):
        assert (bitplanes.unshuffled(bitplanes.shuffled(ids, mode), 4, mode) == ids).all()
    assert pa.array(ids).type == pa.uint32()
