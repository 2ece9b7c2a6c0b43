"""Operators on texts against plain Python over the same rows."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash

from embedlens.llm import license_scan, line_dedup, ngram_join, packing, piece_codec, quality, textnp, token_store
from embedlens.llm.tokens import UnitEncoder

WORD = re.compile(r"[^\x20\x09-\x0D]+")
AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def many(df):
    return Counter(tuple(r) for r in df.collect())


def test_line_dedup(documents, rows, empty):
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(AZ)
    holders = defaultdict(set)
    for doc, text, *_ in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= 40:
                holders[key(line)].add(-1 if doc is None else doc)
    want = Counter()
    for doc, text, *_ in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(holders.get(key(x), ())) < 5 or max(holders[key(x)]) == (-1 if doc is None else doc)]
        want[doc, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()] += 1
    assert many(line_dedup.line_dedup(documents, emit="digest")) == want
    assert sum(n for (_, _, gone, _), n in want.items() if gone) >= 8
    got = {r.doc_id: r for r in line_dedup.line_dedup(documents, emit="bitmap").where("doc_id is not null").collect()}
    for doc, text, *_ in rows:
        if doc is not None:
            kept = line_dedup.apply_bitmap(text, got[doc].n_lines, got[doc].keep)
            assert (doc, got[doc].n_lines, got[doc].n_dropped, hashlib.sha256(kept.encode()).hexdigest()) in want
    texts = line_dedup.line_dedup(documents, emit="text")
    assert texts.columns == documents.columns and texts.count() == len(rows)
    assert line_dedup.line_dedup(empty, emit="digest").count() == 0


@pytest.mark.parametrize("run_rows, limit", [(200_000, 64 << 20), (3, 0)])
def test_line_dedup_runs_over_partition_edges(spark, monkeypatch, run_rows, limit):
    """One line in all documents, some twice, and rows that share an id: with long runs, and with bitmaps that are joined."""
    monkeypatch.setattr(line_dedup, "RUN_ROWS", run_rows)
    line, other = "a line of more than forty code points that all documents hold", "another line of more than forty code points, in four of them"
    rows = [(i, f"{line}\n{i}\n{line}" if i % 3 else f"{i}\n{line}") for i in range(400)]
    rows += [(7, f"x\n{line}"), (None, line), (None, f"y\n{line}\n{other}"), *[(i, other) for i in (500, 501, 502)], (399, line), (7, f"x\n{line}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    want = Counter((i, t.count("\n") + 1, 0 if i == 399 else t.split("\n").count(line)) for i, t in rows)
    got = line_dedup.line_dedup(docs, emit="digest", limit=limit)
    assert Counter(tuple(r)[:3] for r in got.collect()) == want
    assert Counter(tuple(r)[:3] for r in line_dedup.line_dedup(docs).collect()) == want


@pytest.mark.parametrize("emit", ["text", "digest"])
def test_line_dedup_among_clashing_names(spark, emit):
    line = "a line of more than forty code points that all documents hold"
    clash = "doc_id long, text string, _doc int, _DOC_ int, _rid int, _keep int, _n_lines string, keep int, gone int, rid int"
    docs = spark.createDataFrame([(i, f"{line}\n{i}", *[i] * 4, "x", 1, 2, 3) for i in range(6)], clash)
    got = line_dedup.line_dedup(docs, emit=emit)
    assert got.count() == 6 and (emit == "digest" or got.columns == docs.columns)


def shingles(text):
    words = WORD.findall((text or "").translate(AZ))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4)) if len(words) >= 5 else frozenset([tuple(words)])


def groups(rows, percent=80):
    """Brute force: all pairs, then components."""
    sets = [(doc, shingles(text)) for doc, text, *_ in rows]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    with_id = [(d, s) for d, s in sets if d is not None and s]
    for i, (a, s) in enumerate(with_id):
        for b, t in with_id[:i]:
            if 100 * min(len(s), len(t)) >= percent * max(len(s), len(t)) and 100 * len(s & t) >= percent * len(s | t):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return Counter((d, len(s), find(d)) for d, s in sets if d is not None)


def test_ngram_groups(documents, rows, empty):
    got = many(ngram_join.ngram_groups(documents).where("doc_id is not null"))
    assert got == groups(rows)
    assert ngram_join.ngram_groups(empty).count() == 0
    kept = ngram_join.one_of_each_group(documents)
    assert kept.columns == documents.columns
    ids = [r.doc_id for r in kept.collect() if r.doc_id is not None]
    assert sorted(ids) == sorted({c for (_, _, c) in groups(rows)})


@pytest.mark.parametrize("small, few, block", [(2, 20, 64), (4, 4, 5), (1, 1000, 3)])
def test_ngram_groups_with_large_buckets(spark, monkeypatch, small, few, block):
    """Chains, families that just miss each other, and common passages, with pivots, blocks and combinations forced."""
    rng = np.random.default_rng(small)
    vocabulary = [f"w{i}" for i in range(60)]
    rows, n = [], 0
    for _ in range(6):
        base = list(rng.choice(vocabulary, 70))
        for _ in range(14):
            for _ in range(int(rng.integers(0, 3))):
                base[int(rng.integers(len(base)))] = f"e{rng.integers(40)}"
            rows.append((n, " ".join(base)))
            n += 1
    passage = " ".join(rng.choice(vocabulary, 30))
    for _ in range(30):
        rows.append((n, passage + " " + " ".join(rng.choice(vocabulary, int(rng.integers(1, 12))))))
        n += 1
    monkeypatch.setattr(ngram_join, "SMALL", small)
    monkeypatch.setattr(ngram_join, "FEW", few)
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for percent in (80, 50)[: 2 if small == 4 else 1]:
        assert many(ngram_join.ngram_groups(df, percent=percent)) == groups(rows, percent)
    with pytest.raises(ValueError):
        ngram_join.ngram_groups(df, percent=10).count()


@pytest.mark.parametrize("percent", [80, 30, 50, 67, 95, 100])
def test_signatures_meet(percent):
    """Any two sets over the limit share a signature, whatever the classes."""
    rng, share = np.random.default_rng(3), percent / 100
    for trial in range(400):
        n = int(rng.integers(1, 400))
        universe = np.unique(rng.integers(0, 2**63, 2 * n + 4).astype(np.uint64))
        cls = dict(zip(universe.tolist(), rng.choice(3, len(universe), p=[0.05, 0.15, 0.8] if trial % 2 else [0.0, 0.5, 0.5])))
        x = np.sort(rng.choice(universe, n, replace=False))
        drop = rng.random(len(x)) < rng.random() * (1 - share)
        y = np.union1d(x[~drop], rng.choice(universe, int(rng.integers(0, int(n * (1 / share - 1) / 2) + 2)), replace=False))
        both = len(np.intersect1d(x, y))
        if not len(y) or 100 * both < percent * (len(x) + len(y) - both):
            continue
        for t in np.intersect1d(x, y).tolist():  # a token of both sets is in two documents
            cls[t] = max(cls[t], 1)
        sigs = [ngram_join.signatures(s, np.array([cls[t] for t in s.tolist()]), percent) for s in (x, y)]
        assert len(x) == len(y) == both or len(np.intersect1d(*sigs)), (n, both)


@pytest.mark.parametrize("name, kind", [("byte_bpe_50k.json", "byte"), ("word_bpe_49k.json", "word")])
def test_units_encode_as_the_library(rows, name, kind):
    from embedlens.llm.shared import text_buffer
    import pyarrow as pa

    e = UnitEncoder(public_tokenizers.path(name), kind)
    texts = [r[1] for r in rows]
    for part in (texts, texts[::-1], [None], [""]):
        ids, n = e.encode(*text_buffer(pa.array(part, pa.string())), 9)
        at = np.cumsum(n)
        for text, a, b in zip(part, at - n, at):
            assert ids[a:b].tolist() == [*e.library.encode(text or "", add_special_tokens=False).ids, 9]


@pytest.mark.parametrize("name, kind", [("byte_bpe_50k.json", "byte"), ("word_bpe_49k.json", "word")])
def test_units_with_one_hash_are_told_apart(monkeypatch, name, kind):
    """With a hash of three values nearly all units clash, in a slice and with what is remembered; ids are the library's all the same."""
    import pyarrow as pa

    from embedlens.llm.shared import text_buffer

    real = textnp.span_hash
    monkeypatch.setattr(textnp, "span_hash", lambda *a: real(*a) % np.uint64(3))
    texts = ["one two three", "two", "three one", "four\nfive four", "", None, "one"]
    e = UnitEncoder(public_tokenizers.path(name), kind)
    for part in (texts, texts[::-1], texts[:1]):
        ids, n = e.encode(*text_buffer(pa.array(part, pa.string())), 9)
        at = np.cumsum(n)
        for text, a, b in zip(part, at - n, at):
            assert ids[a:b].tolist() == [*e.library.encode(text or "", add_special_tokens=False).ids, 9]
    c = piece_codec.PieceCodec(public_tokenizers.path("piece_bpe_32k.model"))
    for part in (texts, texts[::-1]):
        counts, ids, decoded = c.digests(part)
        for text, n, i, d in zip(part, counts, ids, decoded):
            want = c.encode(text)
            assert (n, i, d) == (len(want), hashlib.sha256(",".join(map(str, want)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest())


def test_token_store(spark, documents, rows, empty):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want, start = [], 0
    hash_of = lambda t: 42 if t is None else int(np.uint64(xxhash.xxh64_intdigest(t.encode(), seed=42)).astype(np.int64))
    for doc, text, *_ in sorted(rows, key=lambda r: (-1 if r[0] is None else r[0], hash_of(r[1]))):
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        want.append((doc, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    got = token_store.token_store(documents, public_tokenizers.path("byte_bpe_50k.json"))
    assert sorted(map(tuple, got.collect()), key=lambda r: r[1]) == want
    assert token_store.token_store(empty, public_tokenizers.path("byte_bpe_50k.json")).count() == 0


def test_wavelet_matrix():
    rng = np.random.default_rng(1)
    for n in (0, 1, 7, 511, 512, 5000, 600_000):
        ids = (rng.zipf(1.4, n) % 50257).astype(np.uint32)
        docs, lengths, m = token_store.read_shard(token_store.write_shard([None, 4], np.array([n, 0]), ids, 16))
        assert docs == [None, 4] and lengths.tolist() == [n, 0] and (m.decode() == ids).all()
        if n:
            at = rng.integers(0, n, 50)
            assert (m.access(at) == ids[at]).all()
            for symbol in [*ids[:3].tolist(), 50000]:
                places = np.flatnonzero(ids == symbol)
                assert m.count(symbol) == len(places) and (m.occurrences(symbol) == places).all()
                assert m.rank(symbol, n // 2) == (places < n // 2).sum()
                for i in {0, len(places) // 2, len(places) - 1} if len(places) else ():
                    assert m.select(symbol, i) == places[i]
    docs, lengths, m = token_store.read_shard(token_store.write_shard([4], np.array([n]), ids, 16))
    m.access(n // 2), m.select(int(ids[n // 2]), 0)
    assert all(len(p.chunks) <= 6 < len(p.parts) - 1 for p in m.planes), "a lookup unpacks few chunks"


def test_packing(documents, rows, empty):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    want, total = Counter(), 0
    for doc, text, *_ in rows:
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        total += len(ids)
        for p in range(0, len(ids), 4096):
            want[doc, p // 4096, p, len(ids[p : p + 4096]), zlib.crc32(ids[p : p + 4096].tobytes())] += 1
    got = packing.pack(documents, path).collect()
    assert Counter(tuple(r)[:5] for r in got) == want
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for pieces in bins.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(bins) <= -(-total // 4096) + 1
    assert packing.pack(empty, path).count() == 0


@pytest.mark.parametrize("max_docs, max_cost, rule", [(3, None, "dot"), (None, 40_000, "norm"), (4, 250_000, "dot")])
def test_packing_under_every_capacity(documents, rows, max_docs, max_cost, rule):
    """Document counts and attention cost bind: pieces are cut to fit, every capacity holds, no token is lost."""
    path = public_tokenizers.path("word_bpe_49k.json")
    lengths = Counter((r.doc_id, r.piece, r.start) for r in packing.pack(documents, path).collect())
    got = packing.pack(documents, path, max_tokens=1000, max_docs=max_docs, max_cost=max_cost, rule=rule).collect()
    longest, bins = min(1000, int((max_cost or 10**6) ** 0.5)), defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    assert max(r.length for r in got) == longest and lengths
    assert sum(r.length for r in got) == sum(r.length for r in packing.pack(documents, path).collect())
    for pieces in bins.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 1000 and len(pieces) <= (max_docs or 1000) and sum(n * n for _, n in pieces) <= (max_cost or 10**6)
    with pytest.raises(ValueError):
        packing.pack(documents, path, max_docs=0)


@pytest.mark.parametrize("rule", ["dot", "norm"])
@pytest.mark.parametrize("max_docs, max_cost", [(None, None), (5, None), (None, 40_000), (7, 60_000)])
def test_plan_keeps_every_capacity(rule, max_docs, max_cost):
    rng = np.random.default_rng(2)
    counts = {int(k): int(n) for k, n in zip(rng.choice(np.arange(1, 190), 80, replace=False), rng.integers(1, 60, 80))}
    bins, seen = defaultdict(list), Counter()
    for length, first, n, repeats, sequence, offset in packing.plan(counts, 512, max_docs, max_cost, rule=rule):
        assert first == seen[length]
        seen[length] += n * repeats
        for turn in range(repeats):
            bins[sequence + turn] += [(offset + i * length, length) for i in range(n)]
    assert seen == counts
    for pieces in bins.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 512 and len(pieces) <= (max_docs or 512) and sum(x * x for _, x in pieces) <= (max_cost or 512**2)


def test_piece_codec(documents, rows, empty):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    want = Counter()
    for doc, text, *_ in rows:
        ids = library.encode(text or "")
        want[doc, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()] += 1
    assert many(piece_codec.round_trip(documents, path)) == want
    back = piece_codec.decode(piece_codec.encode(documents, path), path)
    assert many(back) == Counter((r[0], library.decode(library.encode(r[1] or ""))) for r in rows)
    assert piece_codec.round_trip(empty, path).count() == 0


def test_prefix_table_is_bpe():
    import random

    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    c, library, rng = piece_codec.PieceCodec(path), sentencepiece.SentencePieceProcessor(model_file=path), random.Random(1)
    for _ in range(3000):
        text = "".join(rng.choices("aeiourstnthéß .,\n▁0-ÀЖ漢😀", k=rng.randrange(1, 40)))
        assert c.encode(text) == library.encode(text), text


def test_quality_base_counts(rows):
    import pyarrow as pa

    texts = [r[1] for r in rows] + ["a b c d e f\na b c d e f\n\n a\n a\na"]
    got = quality.base_counts(pa.array(texts, pa.string()))
    for i, text in enumerate(texts):
        words = WORD.findall(text or "")
        windows = Counter(tuple(words[j : j + 5]) for j in range(len(words) - 4))
        repeat = {j + d for j in range(len(words) - 4) if windows[tuple(words[j : j + 5])] > 1 for d in range(5)}
        lines = [x for x in (text or "").split("\n") if WORD.search(x)]
        assert [int(got[k][i]) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")] == [len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(repeat)]


def test_words_and_windows():
    data = "Ab  cd\te\nf gé".encode() + b"h i" + b""
    w = textnp.words(np.frombuffer(data, np.uint8), np.array([0, 14, 17, 17]))
    assert w.first.tolist() == [0, 5, 7, 7]
    assert [data[a:b] for a, b in zip(w.start, w.end)] == [b"Ab", b"cd", b"e", b"f", "gé".encode(), b"h", b"i"]
    assert w.hash[0] == textnp.words(np.frombuffer(b"aB", np.uint8), np.array([0, 2])).hash[0]


def test_licenses_of_rows_without_or_with_a_shared_id(spark):
    rows = [(None, "x\nLicensed under the MIT License."), (None, "y"), (1, "Released under the MIT License.\nz"), (1, "plain"), (1, "plain")]
    got = many(license_scan.license_scan(spark.createDataFrame(rows, "doc_id long, text string")))
    assert got == {(None, None, 1, "MIT", 0, ""): 1, (None, None, 0, "", 0, ""): 1, (1, None, 1, "MIT", 0, ""): 1, (1, None, 0, "", 0, ""): 2}


def test_license_forms(spark, empty):
    mit = next(t for i, t in license_scan.KNOWN if i == "MIT" and "\n\n" in t)
    wrapped = "\n".join("// " + line for p in mit.split("\n\n") for line in [*re.findall(r".{1,60}(?: |$)", p), ""])
    texts = [
        ("Licenced under the APACHE licence version 2.0", "Apache-2.0", 1, "Apache-2.0", 1, "Apache-2.0"),
        ("Copyright 2020 A. Person\nLicensed under the MIT License", "MIT", 1, "MIT", 1, "MIT"),
        ("x\nAll rights reserved!\n all RIGHTS reserved", None, 2, "all-rights-reserved", 0, ""),
        (None, None, 0, "", 0, ""),
        ("", None, 0, "", 0, ""),
        ("(c) me", None, 0, "", 0, ""),
        ("Copyright 2020 X. Licensed under the Apache License, Version 2.0.", "Apache-2.0", 1, "Apache-2.0", 1, "Apache-2.0"),
        ("int x;\n\n// Copyright 2001 Me\n//\n" + wrapped + "\n\nint main();\n", None, 0, "", 1, "MIT"),
        (mit.replace(" ", "  \n"), "MIT", 0, "", 1, "MIT"),
        (mit[: mit.index("\n\n")], None, 0, "", 0, ""),
        ("word " * 200_000, None, 0, "", 0, ""),
    ]
    docs = spark.createDataFrame([(i, t[0], i, "x") for i, t in enumerate(texts)], "doc_id long, text string, c int, digest string")
    got = {r.doc_id: tuple(r)[1:] for r in license_scan.license_scan(docs).collect()}
    assert {i: got[i][:3] for i in got if i != 8} == {i: t[1:4] for i, t in enumerate(texts) if i != 8}
    assert {i: got[i][3:] for i in got if i != 8} == {i: t[4:] for i, t in enumerate(texts) if i != 8}
    assert got[8][0] == "MIT" and got[8][4] == "MIT"
    assert license_scan.license_scan(empty).count() == 0
