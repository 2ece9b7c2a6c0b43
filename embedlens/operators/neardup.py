"""Near-duplicates by 64-bit hashes, exact duplicates by digest, cluster reports."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from embedlens.operators.sampling import global_rank
from embedlens.sources.shared import written

BITS = 60


def simhash(df: DataFrame, key: str, text: str, n: int = 3) -> DataFrame:
    """(key, hash): 60-bit simhash of distinct lower-cased word n-grams; bits on ties are 0. Texts with fewer words have one n-gram.

    A row's votes are counted in its own task: nothing is shuffled. An n-gram's hash is the 60-bit md5 prefix of ``sim:<n-gram>``.
    """
    words = F.filter(F.split(F.lower(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), "[ \\t\\n\\r\\x0b\\f]+", " ")), " "), lambda w: w != "")
    powers = np.int64(1) << np.arange(BITS, dtype=np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros(batch.num_rows, np.int64)
            for i, found in enumerate(batch.column("w")):
                w = found.as_py()
                grams = {" ".join(w[j : j + n]) for j in range(max(1, len(w) - n + 1))}
                digests = b"".join([hashlib.md5(b"sim:" + g.encode()).digest()[:8] for g in grams])
                bits = np.unpackbits(np.frombuffer(digests, np.uint8).reshape(-1, 8), axis=1)[:, :BITS]
                out[i] = powers[::-1][2 * bits.sum(0, dtype=np.int64) > len(grams)].sum()
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(out)], names=[key, "hash"])

    kind = dict(df.dtypes)[key]
    return df.select(key, words.alias("w")).mapInArrow(run, f"{key} {kind}, hash long")


def _blocks(n: int, t: int, bits: int) -> int:
    """Blocks to cut hashes into: of ``m`` blocks some ``m - t`` agree in two hashes within t. Few blocks make long candidate lists, many
    make many keys; the best is where rows and expected candidates are fewest."""
    cost = lambda m: comb(m, t) * (n + n * n / 2 ** (1 + bits * (m - t) / m))
    return min(range(t + 1, t + 5), key=cost)


def hamming_pairs(hashes: DataFrame, key: str, t: int = 6, bits: int = BITS) -> DataFrame:
    """(a, b, distance, pairs): of every two distinct hashes within distance t the smallest ids that have them (a < b), and of every hash
    that several ids have its smallest one (a = b, distance 0); ``pairs`` is how many pairs of ids the row stands for. ``hash_members`` has
    the ids behind each, so a hash that n ids share costs n rows, not their square.

    Equal hashes are one value first, so a frequent hash is no hot key. Hashes are cut into m blocks; two within t agree in m - t of them
    (pigeonhole), so they meet under the mask of those blocks, and are verified. ``m`` follows the number of distinct hashes, so that keys
    get longer (up to 24 bits) as there are more of them.
    """
    values = hash_classes(hashes, key)
    m = _blocks(values.count(), t, bits)
    edges = [round(i * bits / m) for i in range(m + 1)]
    cells = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]
    masks = [sum(cells[i] for i in c) for c in combinations(range(m), m - t)]
    # one long a mask; masks that share a key by chance only bring candidates, which are verified
    keyed = values.select("hash", F.explode(F.array(*[F.xxhash64(F.lit(i), F.col("hash").bitwiseAND(F.lit(x))) for i, x in enumerate(masks)])).alias("at"))
    left, right = keyed.withColumnRenamed("hash", "x"), keyed.withColumnRenamed("hash", "y")
    distance = F.bit_count(F.col("x").bitwiseXOR(F.col("y"))).cast("long")
    # Spark takes an exploded side for as large as the table it is made of, and would broadcast a row for each hash and mask
    met = left.join(right.hint("merge"), "at").where("x < y").where(distance <= t)
    near = met.select("x", "y").distinct().withColumn("distance", distance)
    x, y = (values.select(F.col("hash").alias(h), F.col("rep").alias(f"rep_{h}"), F.col("n").alias(f"n_{h}")) for h in ("x", "y"))
    near = near.join(x, "x").join(y, "y").select(F.least("rep_x", "rep_y").alias("a"), F.greatest("rep_x", "rep_y").alias("b"), "distance", (F.col("n_x") * F.col("n_y")).alias("pairs"))
    same = values.where("n > 1").select(F.col("rep").alias("a"), F.col("rep").alias("b"), F.lit(0).cast("long").alias("distance"), F.expr("n * (n - 1) div 2").alias("pairs"))
    return near.unionByName(same)


def hash_classes(hashes: DataFrame, key: str) -> DataFrame:
    """(hash, rep, n): each hash with the smallest id that has it, and how many have; written."""
    return written(hashes.where(F.col("hash").isNotNull()).groupBy("hash").agg(F.min(key).alias("rep"), F.count("*").alias("n")), "classes")


def hash_members(hashes: DataFrame, key: str) -> DataFrame:
    """(key, rep): the smallest id with the same hash, for every id that has one."""
    hashes = written(hashes.select(key, "hash"), "hashes")
    return hashes.join(hash_classes(hashes, key), "hash").select(key, "rep")


def leader_clusters(hashes: DataFrame, key: str, t: int = 6, max_rounds: int = 1000) -> DataFrame:
    """(key, rep, cluster_id): ids ascending join the first-created representative within t, else become one; no chaining.

    Representatives are the lexicographically first maximal independent set of the distance graph. Equal hashes take their smallest
    id's fate, so the graph is over distinct hashes. A round decides every node whose smaller neighbours are all decided; each round is
    written to the shared folder. Rounds are as many as the longest chain of ids that wait for each other, each at least 1 apart; beyond
    ``max_rounds`` it raises.
    """
    hashes = written(hashes.select(key, "hash"), "leaders")  # read four times below
    nodes = written(hashes.groupBy("hash").agg(F.min(key).alias("id")), "leaders")
    edges = written(hamming_pairs(nodes.select("hash", F.col("id").alias(key)), key, t).select(F.col("a").alias("small"), F.col("b").alias("large")), "leaders")
    state = written(nodes.select("id", F.lit(None).cast("boolean").alias("rep")), "leaders")
    for _ in range(max_rounds):
        near = edges.join(state.withColumnRenamed("id", "small"), "small").groupBy("large").agg(F.bool_or(F.coalesce("rep", F.lit(False))).alias("covered"), F.bool_or(F.col("rep").isNull()).alias("waiting"))
        new = F.when(F.col("rep").isNotNull(), F.col("rep")).when(F.coalesce("covered", F.lit(False)), F.lit(False)).when(~F.coalesce("waiting", F.lit(False)), F.lit(True))
        state = written(state.join(near, state["id"] == near["large"], "left").select("id", new.alias("rep")), "leaders")
        if state.where("rep is null").isEmpty():
            break
    else:
        raise RuntimeError("leader_clusters: rounds ran out")
    reps = state.where("rep").select("id")
    member = edges.join(reps.withColumnRenamed("id", "small"), "small").groupBy(F.col("large").alias("id")).agg(F.min("small").alias("rep"))
    assigned = state.withColumnRenamed("rep", "own").join(member, "id", "left").select("id", F.when(F.col("own"), F.col("id")).otherwise(F.col("rep")).alias("rep"))
    numbered = global_rank(reps, F.col("id"), name="n").select(F.col("id").alias("rep"), (F.col("n") - 1).alias("cluster_id"))
    by_hash = nodes.join(assigned, "id").join(numbered, "rep").select("hash", "rep", "cluster_id")
    return hashes.join(by_hash, "hash").select(key, "rep", "cluster_id")


def cluster_sizes(clusters: DataFrame, top: int = 10) -> DataFrame:
    """The largest clusters of more than one member: a report of ``top`` rows."""
    return clusters.groupBy("cluster_id").agg(F.count("*").alias("size")).where("size > 1").orderBy(F.desc("size"), "cluster_id").limit(top)


def cluster_histogram(clusters: DataFrame) -> DataFrame:
    return clusters.groupBy("cluster_id").agg(F.count("*").alias("size")).groupBy("size").agg(F.count("*").alias("clusters"), F.sum("size").alias("members"))


def exact_dups(df: DataFrame, key: str, content: str) -> DataFrame:
    """(digest, copies, first): contents that occur more than once."""
    return df.groupBy(F.sha2(F.col(content).cast("binary"), 256).alias("digest")).agg(F.count("*").alias("copies"), F.min(key).alias("first")).where("copies > 1")
