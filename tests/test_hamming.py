"""Pairs of hashes: what is sent for them."""

from collections import defaultdict
from itertools import combinations, product

from embedlens.operators import neardup
from embedlens.plans import q_dedup_runs, registry


def test_no_row_a_hash_and_mask_is_broadcast(spark):
    df = spark.createDataFrame([(i, i * 2654435761 % 2**60) for i in range(200)], "id long, hash long")
    plan = neardup.hamming_pairs(df, "id")._jdf.queryExecution().sparkPlan().toString()
    joins = [line for line in plan.splitlines() if "Join" in line]
    assert any("SortMergeJoin" in x and "[at#" in x for x in joins), joins


def test_every_pair_follows_from_the_query(spark, tmp_path):
    texts = ["a b c d e f", "a b c d e f", "A  b c d e f", "", " ", None, "other words of a text", "a b c d e f g h i j"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    h = {r.doc_id: r.hash for r in q_dedup_runs.simhash(spark, str(tmp_path)).collect()}
    rows = registry.queries()["hamming_pairs"](spark, str(tmp_path)).collect()
    members, found = defaultdict(set), set()
    for r in rows:
        members[r.a] |= {r.a} | ({r.b} if r.distance == 0 else set())
        members[r.b] |= {r.b} if r.distance else set()
    for r in rows:
        if r.distance:
            found |= {tuple(sorted(p)) for p in product(members[r.a], members[r.b])}
        else:
            found |= set(combinations(sorted(members[r.a]), 2))
    want = {(a, b) for a, b in combinations(sorted(h), 2) if (h[a] ^ h[b]).bit_count() <= 6}
    assert found == want and len(want) >= 6
    assert sum(r.pairs for r in rows) == len(want)
