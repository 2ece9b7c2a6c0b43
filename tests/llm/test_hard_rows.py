"""Very long texts and columns with clashing names, through the registered operators and the pipeline's stages."""

import hashlib
import random
import re

import corpus_pipeline
import public_tokenizers
import pytest

from embedlens.llm import license_scan, line_dedup, lm_score, ngram_join, packing, piece_codec, quality, token_store, toxicity

from .conftest import SF

WORD = re.compile(r"[^\x20\x09-\x0D]+")
CLASH = "_id, _gone, _group, _rows, _doc, _rid, _keep, _n_lines, _judged, _lang, _salt, _entries, _low, _high, _key, rid, keep, sig, h1, label, judged, lang_key, score".split(", ")


@pytest.fixture(scope="module")
def texts(rows):
    rng = random.Random(9)
    words = sorted({w for r in rows[:60] for w in WORD.findall(r[1] or "")})
    line = lambda: " ".join(rng.choices(words, k=90))
    long = "\n".join(line() for _ in range(16_000))
    assert len(long.encode()) > 8_500_000
    near = long.replace("\n", " \n", 5)
    return {1: long, 2: near, 3: "x" * 3_000_000 + " end of a long word", 4: None, 5: "", 6: line()}


@pytest.fixture(scope="module")
def long_documents(spark, texts):
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} int" for c in CLASH)
    return spark.createDataFrame([(i, t, "en" if i % 2 else None, "s", len(t or ""), *[i] * len(CLASH)) for i, t in texts.items()], schema).repartition(2)


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def test_line_dedup(long_documents, texts):
    for i, r in by_id(line_dedup.line_dedup(long_documents, emit="digest", min_docs=2)).items():
        lines = (texts[i] or "").split("\n")
        gone = len(lines) if i == 1 else 0
        assert (r.n_lines, r.n_dropped) == (len(lines), gone)
        assert r.kept_sha256 == hashlib.sha256(b"" if gone else (texts[i] or "").encode()).hexdigest()


def test_ngram_join(long_documents, texts):
    got = by_id(ngram_join.ngram_groups(long_documents))
    words = WORD.findall(texts[1].lower())
    assert got[1].n_shingles == len({tuple(words[j : j + 5]) for j in range(len(words) - 4)})
    assert {i: r.component_id for i, r in got.items()} == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5, 6: 6} and got[3].n_shingles == 2


def test_token_store_and_packing(long_documents, texts):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    got, library = by_id(token_store.token_store(long_documents, path)), Tokenizer.from_file(path)
    for i in (1, 4, 5, 6):
        assert got[i].n_tokens == len(library.encode(texts[i] or "", add_special_tokens=False).ids) + 1
    path = public_tokenizers.path("word_bpe_49k.json")
    library, total = Tokenizer.from_file(path), dict.fromkeys(texts, 0)
    for r in packing.pack(long_documents, path).collect():
        total[r.doc_id] += r.length
    for i in (1, 4, 5, 6):
        assert total[i] == len(library.encode(texts[i] or "", add_special_tokens=False).ids) + 1


def test_models(spark, long_documents, texts):
    labels = spark.createDataFrame([(i, i % 2, 5) for i in range(30)], "doc_id long, toxic int, text int")
    assert len(by_id(toxicity.with_score(long_documents, labels))) == 6
    got, judged = by_id(lm_score.score(long_documents)), by_id(quality.judged(long_documents))
    for i, t in texts.items():
        n = len(WORD.findall(t or ""))
        assert got[i].n_tokens == n + 1 and judged[i].n_words == n and judged[i].base_failed == (n < 10)


def test_codec_and_licenses(long_documents, texts):
    path = public_tokenizers.path("piece_bpe_32k.model")
    for i, r in by_id(piece_codec.round_trip(long_documents, path)).items():
        assert r.decoded_sha256 == hashlib.sha256((texts[i] or "").encode()).hexdigest()
    assert {r.license_id for r in by_id(license_scan.license_scan(long_documents)).values()} == {None}


def test_stages_keep_columns(spark, long_documents):
    small = long_documents.where("doc_id > 3")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, small, SF)
        assert out.columns == long_documents.columns, name
        out.collect()
