"""Words that a polynomial modulo 2**64 takes for each other, and rows that share a doc_id."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np

from embedlens.llm import lm_score, ngram_join, quality, textnp, tokens, toxicity

SCHEMA = "doc_id long, text string"
THUE = "".join("ab"[bin(i).count("1") % 2] for i in range(2048))
MORSE = THUE.translate(str.maketrans("ab", "ba"))


def test_hashes_tell_words_apart():
    rng = random.Random(3)
    words = {THUE, MORSE, THUE[:1024], MORSE[:1024], "a\x00", "a", "abcdefg", "abcdefg\x07", "abcdefg\x01", "\x01"}
    words |= {"".join(rng.choices("ab\x01é語", k=n)) for n in range(1, 30) for _ in range(50)}
    words = sorted(words)
    raw = " ".join(words).encode()
    w = textnp.words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), lower=False)
    assert len(set(w.hash.tolist())) == len(w.hash) == len(words)
    again = textnp.words(np.frombuffer(raw + b" " + raw, np.uint8), np.array([0, len(raw), 2 * len(raw) + 1]), lower=False)
    assert again.hash.tolist() == w.hash.tolist() * 2


def test_join_does_not_link_them(spark):
    rows = [(1, THUE), (2, MORSE), (3, f"w x y z {THUE}"), (4, f"w x y z {MORSE}"), (5, THUE.upper())]
    got = ngram_join.ngram_groups(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r.doc_id: r.component_id for r in got} == {1: 1, 2: 2, 3: 3, 4: 4, 5: 1}
    assert {r.doc_id for r in ngram_join.one_of_each_group(spark.createDataFrame(rows, SCHEMA)).collect()} == {1, 2, 3, 4}


def test_scores_do_not_take_one_for_the_other(spark):
    held = next(i for i in range(1000, 2000) if zlib.crc32(str(i).encode()) % 10 == 0)
    rows = [(i, f"{THUE} word{i % 7} and more") for i in range(1, 60)] + [(held, MORSE)]
    got = {r.doc_id: r for r in lm_score.score(spark.createDataFrame(rows, SCHEMA)).collect()}
    c = Counter(t for i, text in rows if zlib.crc32(str(i).encode()) % 10 for t in [*text.split(), None])
    n, v = sum(c.values()), len(c)
    assert got[held].n_known == 1 and got[held].held_out
    assert math.isclose(got[held].base_score, math.log10(0.1 / (n + 0.1 * (v + 1))) + math.log10((c[None] + 0.1) / (n + 0.1 * (v + 1))), rel_tol=1e-9)


def test_repeated_windows_are_real(spark):
    rows = [(1, f"a b c d {THUE} - a b c d {MORSE} - q r"), (2, f"a b c d {THUE} - a b c d {THUE} - q r")]
    got = {r.doc_id: r for r in quality.judged(spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'en' lang")).collect()}

    def repeated(text):
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        seen = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        return len({j for i in range(len(w) - 4) if seen[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)})

    assert {i: got[i].n_repeat_words for i in got} == {i: repeated(t) for i, t in rows} and repeated(rows[0][1]) == 0


def test_features_differ():
    found = [toxicity.features(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t)]), 26)[1].tolist() for t in (THUE, MORSE)]
    assert found[0] != found[1]


def test_rows_that_share_an_id_are_told_apart(spark):
    rng = random.Random(9)
    text = lambda: " ".join(f"w{rng.randrange(10**6)}" for _ in range(60))
    a, b, c, d = (text() for _ in range(4))
    near = d.rsplit(" ", 1)[0] + " other"
    rows = [(1, d), (5, a), (5, b), (5, b), (7, near), (7, c), (8, c), (9, ""), (9, ""), (None, a), (6, a.upper())]
    extra = [(*r, i, {"k": i}) for i, r in enumerate(rows)]
    docs = spark.createDataFrame(extra, SCHEMA + ", _h1 long, m map<string,int>").repartition(3)
    got = ngram_join.one_of_each_group(docs)
    assert got.columns == docs.columns
    assert Counter((r.doc_id, r.text) for r in got.collect()) == Counter([(1, d), (5, a), (5, b), (7, c), (9, ""), (9, ""), (None, a)])
    assert ngram_join.one_of_each_group(docs.limit(0)).count() == 0


def test_units_that_are_forgotten_are_learnt_again(monkeypatch):
    import public_tokenizers

    rng = random.Random(4)
    words = [f"w{i}é" for i in range(300)]
    for kind, file in (("byte", "byte_bpe_50k.json"), ("word", "word_bpe_49k.json")):
        monkeypatch.setattr(tokens, "MEMORY", 60)
        e = tokens.UnitEncoder(public_tokenizers.path(file), kind)
        for _ in range(40):
            texts = [" ".join(rng.choices(words, weights=[1 / (i + 1) for i in range(300)], k=rng.randrange(30))) for _ in range(4)]
            data, sizes = "".join(texts).encode(), [len(t.encode()) for t in texts]
            ids, lengths = e.encode(np.frombuffer(data, np.uint8), np.cumsum([0, *sizes]), 7)
            want = [[*e.library.encode(t, add_special_tokens=False).ids, 7] for t in texts]
            assert ids.tolist() == sum(want, []) and lengths.tolist() == [len(x) for x in want]
        assert len(e.keys) == len(e.uses) == len(e.slots) < 300


def test_units_of_letters_skip_the_search_for_words(monkeypatch):
    """They go to the library's model as they are; all others, and what stands around them, give the library's ids as before."""
    import public_tokenizers

    texts = ["Some words, don't they? été Ünder ÀÖØöøÿ", "a×b c÷d ×÷ x× ÷y é× naïve, naïve-té", "first\nnext line\nété\n×", "ñ", "", "ªº µm ſ Ǆ", "it's l'été (paren) 12ab ab12 a1b2", "word " * 70 + "end", "Ġ Ċ Ā Ã Ã©"]
    texts += [" ".join(f"{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}é{chr(0xC0 + i % 64)}" for i in range(k)) for k in (63, 64, 65, 129, 700)]
    data, offsets = "".join(texts).encode(), np.cumsum([0, *(len(t.encode()) for t in texts)])
    e, searched, all_new = tokens.UnitEncoder(public_tokenizers.path("byte_bpe_50k.json"), "byte"), [], []
    encode_new, learn = e._encode_new, e._learn
    monkeypatch.setattr(e, "_encode_new", lambda new: searched.extend(new) or encode_new(new))
    monkeypatch.setattr(e, "_learn", lambda keys, raw, prefix: all_new.extend(raw) or learn(keys, raw, prefix))
    want = [[*e.library.encode(t, add_special_tokens=False).ids, 0] for t in texts]
    for _ in range(2):
        ids, lengths = e.encode(np.frombuffer(data, np.uint8), offsets, 0)
        assert ids.tolist() == sum(want, []) and lengths.tolist() == [len(x) for x in want]
    letters = {c.encode() for c in map(chr, range(0x100)) if c.isalpha() and c not in "ªµº"}
    assert len(all_new) > 600 and 0 < len(searched) < 60
    assert not any(all(c.encode() in letters for c in unit.strip()) for unit in searched)


def test_equal_spans_and_quick_hashes_at_all_sizes():
    rng = np.random.default_rng(6)
    for size in (0, 1, 7, 8, 9, 15, 16, 17, 63, 64, 65, 200):
        a = rng.integers(0, 256, size + 5).astype(np.uint8)
        b = np.append(rng.integers(0, 256, 3).astype(np.uint8), a[5:])  # the span ends with the data
        at, n = (np.array([5]), np.array([3])), np.array([size])
        assert textnp.equal_spans(a, at[0], b, at[1], n).tolist() == [True]
        one = textnp.span_hash(a, at[0], at[0] + n, True)
        assert one == textnp.span_hash(b, at[1], at[1] + n, True)
        for i in range(size):
            other = b.copy()
            other[3 + i] ^= 1
            assert textnp.equal_spans(a, at[0], other, at[1], n).tolist() == [False]
            assert one != textnp.span_hash(other, at[1], at[1] + n, True)
    assert len(textnp.equal_spans(a, n[:0], b, n[:0], n[:0])) == 0
