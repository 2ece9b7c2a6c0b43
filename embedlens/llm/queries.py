"""The corpus queries that the entry module adds: ``opN_<name>`` and ``pipeline``."""

from __future__ import annotations

from embedlens.llm import binary_pack, embed_dedup, license_scan, line_dedup, lm_score, ngram_join, packing, piece_codec, quality, term_search, token_store, toxicity, turn_repair
from embedlens.llm.shared import read


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_line_dedup(spark, sf_dir):
    return line_dedup.line_dedup(read(spark, sf_dir, "documents"), emit="digest")


def op2_ngram_jaccard_join(spark, sf_dir):
    return ngram_join.ngram_groups(read(spark, sf_dir, "documents"), shingle=5, percent=80)


def op3_token_store(spark, sf_dir):
    return token_store.token_store(read(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), end_id=0)


def op4_lm_scoring(spark, sf_dir):
    return lm_score.score(read(spark, sf_dir, "documents"))


def op5_toxicity(spark, sf_dir):
    return toxicity.with_score(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), threshold=0.7)


def op6_license_scan(spark, sf_dir):
    return license_scan.license_scan(read(spark, sf_dir, "documents"))


def op7_best_fit_packing(spark, sf_dir):
    return packing.pack(read(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), end_id=1, max_tokens=4096)


def op8_embedding_near_dedup(spark, sf_dir):
    return embed_dedup.embedding_groups(read(spark, sf_dir, "embeddings"), threshold=0.98)


def op9_sentencepiece_codec(spark, sf_dir):
    return piece_codec.round_trip(read(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def op10_quality_rules(spark, sf_dir):
    return quality.judged(read(spark, sf_dir, "documents"))


def op11_power_of_two_packing(spark, sf_dir):
    return binary_pack.pack(read(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), end_id=1, max_tokens=2048)


def op12_conversation_repair(spark, sf_dir):
    return turn_repair.repair(turn_repair.damage(read(spark, sf_dir, "conversations")))


def op13_ranked_search(spark, sf_dir):
    return term_search.search(read(spark, sf_dir, "documents"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), top=10)


OPERATORS = (
    op1_line_dedup, op2_ngram_jaccard_join, op3_token_store, op4_lm_scoring, op5_toxicity, op6_license_scan, op7_best_fit_packing,
    op8_embedding_near_dedup, op9_sentencepiece_codec, op10_quality_rules, op11_power_of_two_packing, op12_conversation_repair, op13_ranked_search,
)
QUERIES = {f.__name__: f for f in OPERATORS}
ORACLE_SQL = {"op1_line_dedup": line_dedup.SQL, "op6_license_scan": license_scan.SQL, "op12_conversation_repair": turn_repair.SQL, "op13_ranked_search": term_search.SQL}
