import random

import pytest

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h1 long, part int"


@pytest.fixture(scope="session")
def rows(spark):
    """Real texts, and hard ones: null, empty, blank, very long, repeated rows, ties, null ids, many near copies."""
    docs = [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()]
    rng = random.Random(5)
    words = docs[0][1].split()
    base = " ".join(rng.choices(words, k=120))
    odd = ["", None, " \n\t ", "one two", "One  TWO", "a", "x\n\ny \n", "tab\there\x0bfeed", "\xa0wide　space x", "▁ under ▁▁bar", "😀 emoji\x00nul", "<|endoftext|> mark <|startoftext|>", "été déjà ÉTÉ", "it's don't I'LL", "1234 5,6.7!?", base, base.upper(), " ".join(rng.choices(words, k=9000))]
    out = [*docs]
    n = 10_000
    for text in odd:
        out.append((n, text, None if n % 3 else "en", "odd", None if text is None else len(text)))
        n += 1
    for i in range(40):  # near copies of one text
        w = base.split()
        for _ in range(i % 4):
            w[rng.randrange(len(w))] = f"edit{rng.randrange(10**6)}"
        out.append((n, " ".join(w), "en", "copies", None))
        n += 1
    shared = "this very line stands in many of the documents of the fixture, word for word"
    for i in range(8):
        out.append((n, f"own words {i} of a document\n  {shared.title() if i % 2 else shared} \nlast {i}\n{shared}", "en", "lines", None))
        n += 1
    out += [out[0], out[0], (None, "a text without an id that is long enough", "en", None, None), (None, shared, None, None, None)]
    return out


@pytest.fixture(scope="session")
def documents(spark, rows):
    """With columns whose names clash with the operators' own."""
    return spark.createDataFrame([(*r, 1, 2) for r in rows], SCHEMA).repartition(5)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
