"""Ranked search against plain Python over all rows."""

import math
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from embedlens.llm import term_search, textnp

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ITEMS = "item_id long, text string, doc_id int, term string, block long"


def terms(text):
    return Counter(TERM.findall((text or "").translate(AZ)))


def ranked(docs, items, top):
    counted = [(doc, terms(text)) for doc, text in docs]
    counted = [(doc, c, sum(c.values())) for doc, c in counted if c]
    n, length, df = len(counted), sum(k for *_, k in counted), Counter(t for _, c, _ in counted for t in c)
    asked = defaultdict(Counter)
    for i, text in dict.fromkeys(items):
        asked[i] += terms(text)
    out = set()
    for i, wanted in asked.items():
        scores = []
        for doc, c, k in counted:
            m = 25 + 75 * k * n // length
            s = sum(q * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t, q in wanted.items() if t in c)
            if s > 0:
                scores.append((-s, doc is None, doc or 0))
        out |= {(i, r, None if none else doc, -s) for r, (s, none, doc) in enumerate(sorted(scores)[:top], 1)}
    return out


@pytest.fixture(scope="module")
def items(spark, rows):
    rng = random.Random(2)
    texts = [r[1] for r in rows if r[1] and len(r[1]) > 50]
    found = [(i, " ".join(rng.choice(texts).split()[:30])) for i in range(60)]
    found += [(70, ""), (71, None), (72, "..."), (73, "zzzznowhere"), (74, "the THE the"), (75, "one two"), (75, "été"), (75, "one two"), (None, "a b c 1234"), (76, "nul 😀"), (77, " ".join(texts[3].split()[:400]))]
    return found


@pytest.mark.parametrize("docs, postings, bundle, run, shares, top", [(4096, 1 << 20, 256, 16 << 20, term_search.SHARES, 10), (9, 500, 7, 2000, (0.2, 0.2, 0.2, 0.2, 0.2), 10), (30, 200, 1000, 16 << 20, (1.0,), 3)])
def test_search(spark, documents, rows, items, empty, monkeypatch, docs, postings, bundle, run, shares, top):
    for name, value in (("DOCS", docs), ("POSTINGS", postings), ("ITEMS", bundle), ("RUN_BYTES", run)):
        monkeypatch.setattr(term_search, name, value)
    frame = spark.createDataFrame([(*x, 1, "t", 2) for x in items], ITEMS)
    got = term_search.search(documents, frame, top=top, shares=shares)
    assert got.columns == ["item_id", "rank", "doc_id", "score"] and dict(got.dtypes)["rank"] == "int"
    found = [tuple(r) for r in got.collect()]
    assert set(found) == ranked([(d, t) for d, t, *_ in rows], items, top) and len(found) == len(set(found))
    assert term_search.search(empty, frame).count() == 0 and term_search.search(documents, frame.limit(0)).count() == 0


def test_ties_common_terms_and_copies(spark):
    """Thousands of copies, a term that all documents hold, scores that differ in the last stage only."""
    rng = random.Random(8)
    words = [f"w{i}" for i in range(40)]
    docs = [(i, "common copy of one text") for i in range(3000, 0, -1)]
    docs += [(4000 + i, "common " + " ".join(rng.choices(words, weights=[1 / (k + 1) for k in range(40)], k=rng.randrange(3, 40)))) for i in range(3000)]
    asked = [(1, "common copy"), (2, "w0 w1 w2 w39 common"), (3, "w0"), (4, "common"), (5, " ".join(words))]
    got = term_search.search(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(asked, "item_id long, text string"))
    assert {tuple(r) for r in got.collect()} == ranked(docs, asked, 10)


def test_accumulators_go_only_where_they_cannot_win(spark, documents, rows, items):
    """The same rows whatever the stages own, and fewer accumulators than documents with a term."""
    frame = spark.createDataFrame([(*x, 1, "t", 2) for x in items], ITEMS)
    one = {tuple(r) for r in term_search.search(documents, frame, shares=(1.0,)).collect()}
    assert one == {tuple(r) for r in term_search.search(documents, frame, shares=(0.01, 0.02, 0.03, 0.94)).collect()}


def test_terms_of_one_hash(spark, documents, rows, items, monkeypatch):
    real = textnp.span_hash
    low = lambda *a: real(*a) % np.uint64(11)
    vocabulary = None
    monkeypatch.setattr(textnp, "span_hash", low)
    vocabulary = term_search.Vocabulary.of([(1, t, 1) for t in ("a", "b", "cc", "été", "word", "x1", "y2", "z3", "long-word-of-many-letters")])
    raw = "a word of b, CC and été x1 y2 z3 q r s".lower().encode()
    data = np.frombuffer(raw, np.uint8)
    w = textnp.words(data, np.array([0, len(raw)]), gaps=textnp.NOT_ALNUM)
    at, found = vocabulary.find(data, w)
    spelt = lambda t: vocabulary.data[vocabulary.start[t] : vocabulary.start[t] + vocabulary.size[t]].tobytes().decode()
    assert sorted((raw[w.start[i] : w.end[i]].decode(), spelt(t)) for i, t in zip(at, found)) == sorted((t, t) for t in ("a", "word", "b", "cc", "été", "x1", "y2", "z3"))


def test_long_text(spark):
    long = "needle " + "hay stack " * 900_000 + "é" * 1_500_000
    docs = [(1, long), (2, "needle hay"), (3, None), (4, "")]
    asked = [(1, "needle"), (2, "stack hay")]
    got = term_search.search(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(asked, "item_id long, text string"))
    assert {tuple(r) for r in got.collect()} == ranked(docs, asked, 10)


def test_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = con.sql(term_search.SQL)
    assert want.columns == ["item_id", "rank", "doc_id", "score"]
    got = term_search.search(*(spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark")))
    assert {tuple(r) for r in got.collect()} == set(want.fetchall())
