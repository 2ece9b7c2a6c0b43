"""The pipeline's stages, each on what its predecessor kept, against brute force."""

import zlib
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
import public_tokenizers
from embedlens.llm import quality, toxicity

from .conftest import SF
from .test_text_operators import AZ, groups


def rows_of(df):
    return [tuple(r) for r in df.select("doc_id", "text", "lang", "source", "n_chars").collect()]


def test_stages(spark, documents, tmp_path):
    from tokenizers import Tokenizer

    docs, kept = documents, {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        kept[f"before {name}"] = docs
        out = stage(spark, docs, SF)
        if i < len(corpus_pipeline.STAGES) - 1:
            assert out.schema.names == documents.schema.names
        out.write.parquet(f"{tmp_path}/{i}")
        docs = kept[name] = spark.read.parquet(f"{tmp_path}/{i}")

    labels = spark.read.parquet(f"{SF}/labels.parquet")
    clean = toxicity.with_score(kept["before toxicity"], labels).where("predicted = 0")
    assert Counter(r[0] for r in rows_of(kept["toxicity"])) == Counter(r.doc_id for r in clean.collect())
    good = quality.judged(kept["toxicity"]).where("kept")
    assert Counter(r[0] for r in rows_of(kept["quality_rules"])) == Counter(r.doc_id for r in good.collect())

    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(AZ)
    rows, holders = rows_of(kept["quality_rules"]), defaultdict(set)
    for doc, text, *_ in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= 40:
                holders[key(line)].add(-1 if doc is None else doc)
    want = Counter()
    for doc, text, lang, source, n in rows:
        lines = (text or "").split("\n")
        left = [x for x in lines if len(holders.get(key(x), ())) < 5 or max(holders[key(x)]) == (-1 if doc is None else doc)]
        new = text if len(left) == len(lines) else "\n".join(left)
        want[doc, new, lang, source, n if new == text else len(new)] += 1
    assert Counter(rows_of(kept["line_dedup"])) == want

    rows = rows_of(kept["line_dedup"])
    ids = [r[0] for r in rows_of(kept["ngram_jaccard_join"]) if r[0] is not None]
    assert sorted(ids) == sorted({c for _, _, c in groups(rows)})

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want, total = Counter(), 0
    for doc, text, *_ in rows_of(kept["ngram_jaccard_join"]):
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        total += len(ids)
        for p in range(0, len(ids), 4096):
            want[doc, p // 4096, p, len(ids[p : p + 4096]), zlib.crc32(ids[p : p + 4096].tobytes())] += 1
    got = docs.collect()
    assert Counter(tuple(r)[:5] for r in got) == want
    used = Counter()
    for r in got:
        used[r.sequence_id] += r.length
    assert max(used.values()) <= 4096 and len(used) <= -(-total // 4096) + 1


def test_run_takes_the_documents_of_a_folder(spark):
    got = corpus_pipeline.run(spark, SF)
    assert got.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and got.count() > 0
