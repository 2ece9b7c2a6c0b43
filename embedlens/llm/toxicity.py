"""Toxicity: FTRL-proximal logistic regression over hashed words, word pairs and skip-grams.

Words are lower-cased (A-Z) and freed of marks after them. A document's features are the distinct hashes (of ``hash_bits`` bits) of its
words, of neighbouring pairs and of pairs around one word, over its whole text. The model is fitted in one task on a bounded sample of
labelled rows: the ``max_rows`` labels with the smallest hash of doc_id (a documented bound; below it, all labels are used).

1. The sample's feature sets are written. Spark counts in how many of them each feature occurs, by hash range; features in fewer than
   ``min_docs`` sets are left out. What is left is a bitmap of ``2**hash_bits`` bits (8 MB), whatever the input: it is broadcast.
2. Tasks send on only the features in the bitmap; one task streams these rows and holds their places among the kept features.
3. FTRL-proximal (McMahan et al., 2013) has a rate for each coordinate and L1, so few weights are non-zero: all those are broadcast, of
   at most ``2**hash_bits`` coordinates.

Defined cases: null or empty text is scored by the bias alone. Null doc_id counts as the empty text in the fold rule. A doc_id with
several labels has the largest; null labels are left out. Of several documents with one doc_id the sample takes that whose features have
the smallest hash. Without labels of both kinds all scores are the smoothed share of label 1 (0.5 without any). An empty table gives no
rows. Every input row gives one row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from embedlens.llm import textnp
from embedlens.llm.shared import Scratch, doc_crc, over_texts, text_buffer, tidy

U = np.uint64
MAX_ROWS = 20_000
#: Bits of a feature: the bound of everything that is made for each feature.
HASH_BITS = 26
#: Features are counted in so many hash ranges, as a power of two.
RANGE_BITS = 6


def features(data: np.ndarray, offsets: np.ndarray, hash_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature) of all words, pairs and skip-grams, repeats included."""
    w = textnp.words(data, offsets, cut_marks=True)
    plain = ~textnp._MARK[data[w.start]]
    h, doc = w.hash[plain], w.doc()[plain]
    found, owner = [h], [doc]
    for gap in (1, 2):
        if len(h) > gap:
            same = doc[gap:] == doc[:-gap]
            found.append(textnp.mix(h[:-gap] * U(0xD6E8FEB86659FD93) + h[gap:] + U(gap))[same])
            owner.append(doc[gap:][same])
    return np.concatenate(owner), np.concatenate(found) >> U(64 - hash_bits)


def ftrl(rows: list[np.ndarray], y: np.ndarray, size: int, alpha: float, beta: float, l1: float, l2: float, epochs: int, positive: float, seed: int) -> tuple[np.ndarray, float]:
    """Weights and bias over presence features ``rows`` (indices below ``size``); a toxic row counts ``positive`` times."""
    z, n, bias_z, bias_n, bias = np.zeros(size, np.float32), np.zeros(size, np.float32), 0.0, 0.0, 0.0

    def weight(zi, ni):
        return np.where(np.abs(zi) <= l1, np.float32(0), -(zi - np.sign(zi) * np.float32(l1)) / ((beta + np.sqrt(ni)) / np.float32(alpha) + np.float32(l2)))

    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for r in rng.permutation(len(rows)):
            i = rows[r]
            zi, ni = z[i], n[i]
            w = weight(zi, ni)
            p = 1 / (1 + np.exp(-np.clip(float(w.sum()) + bias, -35, 35)))
            g = (p - y[r]) * (positive if y[r] else 1.0)
            after = ni + np.float32(g * g)
            z[i] = zi + np.float32(g) - (np.sqrt(after) - np.sqrt(ni)) / np.float32(alpha) * w
            n[i] = after
            step = (np.sqrt(bias_n + g * g) - np.sqrt(bias_n)) / alpha
            bias_z += g - step * bias
            bias_n += g * g
            bias = -bias_z / ((beta + np.sqrt(bias_n)) / alpha)
    return weight(z, n), float(bias)


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All features of a list column, and where each row's begin and end."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(), np.concatenate([[0], np.cumsum(column.value_lengths().to_numpy())])


def _sets(hash_bits: int):
    """doc_id, toxic, sorted distinct features."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        owner, found = features(*text_buffer(batch.column("text")), hash_bits)
        both = np.unique((owner.astype(U) << U(hash_bits)) | found)
        at = np.searchsorted(both, np.arange(batch.num_rows + 1, dtype=U) << U(hash_bits))
        found = (both & U((1 << hash_bits) - 1)).astype(np.int32)
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(found))], names=["doc_id", "toxic", "features"])

    return over_texts(run)


def _ranges(hash_bits: int, limit: int = 1 << 20):
    """(range, features, counts) of about ``limit`` occurrences at a time."""

    def packed(held: list[np.ndarray]) -> pa.RecordBatch:
        f, n = np.unique(np.concatenate(held), return_counts=True)
        part = f >> (hash_bits - RANGE_BITS)
        found, first = np.unique(part, return_index=True)
        ends = [*first[1:].tolist(), len(f)]
        return pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array([f[a:b].tobytes() for a, b in zip(first, ends)], pa.binary()), pa.array([n[a:b].astype("<u4").tobytes() for a, b in zip(first, ends)], pa.binary())], names=["range", "features", "counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            flat, _ = _flat(batch.column("features"))
            for a in range(0, len(flat), limit):
                held.append(flat[a : a + limit])
                size += len(held[-1])
                if size >= limit:
                    yield packed(held)
                    held, size = [], 0
        if size:
            yield packed(held)

    return run


def _kept_range(hash_bits: int, min_docs: int):
    """The bitmap of one range: features in ``min_docs`` sets or more."""

    def run(table: pa.Table) -> pa.Table:
        base, size = table.column("range")[0].as_py() << (hash_bits - RANGE_BITS), 1 << (hash_bits - RANGE_BITS)
        count = np.zeros(size, np.uint32)
        for f, n in zip(table.column("features"), table.column("counts")):
            count[np.frombuffer(f.as_buffer(), np.int32) - base] += np.frombuffer(n.as_buffer(), "<u4")
        return pa.table({"range": table.column("range")[:1], "bits": pa.array([np.packbits(count >= min_docs, bitorder="little").tobytes()], pa.binary())})

    return run


def _inside(bitmap: np.ndarray, f: np.ndarray) -> np.ndarray:
    return (bitmap[f >> 3] >> (f & 7).astype(np.uint8)) & 1 == 1


def _only(bitmap):
    """Rows with the features that are in the bitmap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, at = _flat(batch.column("features"))
            keep = _inside(bitmap.value, flat)
            at = np.concatenate([[0], np.cumsum(keep)])[at]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(flat[keep]))], names=["doc_id", "toxic", "features"])

    return run


def _trained(bitmap, alpha: float, beta: float, l1: float, l2: float, epochs: int, positive: float, seed: int):
    """Over all rows of the sample in one partition: sorted ids of non-zero weights, the weights, the bias."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = bitmap.value
        words = bits.view("<u8")
        before = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)]).astype(np.uint32)
        rows, y = [], []
        for batch in batches:
            flat, at = _flat(batch.column("features"))
            low = (U(1) << (flat & 63).astype(U)) - U(1)
            place = (before[flat >> 6] + np.bitwise_count(words[flat >> 6] & low)).astype(np.int32)
            rows += [place[a:b].copy() for a, b in zip(at[:-1], at[1:])]
            y += batch.column("toxic").to_pylist()
        if not rows:
            return
        y = np.array(y, float)
        if len(set(y.tolist())) < 2:
            w, bias = np.zeros(int(before[-1]), np.float32), float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)))
        else:
            w, bias = ftrl(rows, y, int(before[-1]), alpha, beta, l1, l2, epochs, positive, seed)
        found = np.flatnonzero(w)
        # from a place among the kept features back to the feature
        word = np.searchsorted(before, found, "right") - 1
        left = found - before[word]
        inner = np.unpackbits(words[word].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ids = word * 64 + (np.cumsum(inner, 1) == (left + 1)[:, None]).argmax(1) if len(found) else found
        yield pa.RecordBatch.from_arrays([pa.array([ids.astype(np.int64).tobytes()], pa.binary()), pa.array([w[found].astype(np.float64).tobytes()], pa.binary()), pa.array([bias])], names=["ids", "weights", "bias"])

    return run


def fit(documents: DataFrame, labels: DataFrame, train: Column, max_rows: int = MAX_ROWS, hash_bits: int = HASH_BITS, min_docs: int = 2, alpha: float = 5.0, beta: float = 1.0, l1: float = 8.0, l2: float = 0.0, epochs: int = 10, positive: float = 3.0, seed: int = 7) -> tuple[np.ndarray, np.ndarray, float]:
    """Sorted feature ids, their weights, the bias. ``train`` is a condition on doc_id."""
    spark = documents.sparkSession
    scratch = Scratch(spark, "toxicity")
    labels = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("toxic is not null").where(train)
    chosen = labels.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    source = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = source.join(F.broadcast(chosen), "doc_id")  # max_rows rows at most
    sample = scratch.stash(rows.mapInArrow(_sets(hash_bits), "doc_id long, toxic int, features array<int>"), "sets")
    if sample.groupBy("doc_id").count().where("count > 1").limit(1).count():
        one = F.min_by(F.struct("toxic", "features"), F.xxhash64("features")).alias("one")
        sample = scratch.stash(sample.groupBy("doc_id").agg(one).select("doc_id", "one.*"), "sets")
    bits = np.zeros((1 << RANGE_BITS, (1 << hash_bits) // 8 >> RANGE_BITS), np.uint8)
    counted = sample.select("features").mapInArrow(tidy(_ranges(hash_bits)), "range int, features binary, counts binary")
    for r in counted.groupBy("range").applyInArrow(_kept_range(hash_bits, min_docs), "range int, bits binary").toLocalIterator():  # 2**hash_bits bits in all
        bits[r.range] = np.frombuffer(r.bits, np.uint8)
    bitmap = spark.sparkContext.broadcast(bits.reshape(-1))
    kept = sample.mapInArrow(tidy(_only(bitmap)), sample.schema).repartition(1).sortWithinPartitions("doc_id")
    found = kept.mapInArrow(tidy(_trained(bitmap, alpha, beta, l1, l2, epochs, positive, seed)), "ids binary, weights binary, bias double").collect()
    scratch.drop(sample)
    bitmap.destroy()
    if not found:
        return np.zeros(0, U), np.zeros(0), 0.0
    return np.frombuffer(bytes(found[0].ids), np.int64).astype(U), np.frombuffer(bytes(found[0].weights)), found[0].bias


def scorer(model: tuple[np.ndarray, np.ndarray, float], hash_bits: int = HASH_BITS):
    ids, weights, bias = model
    sieve = np.zeros(1 << 16, bool)
    sieve[(ids & U(0xFFFF)).astype(np.int64)] = True

    def score(col: pa.Array) -> np.ndarray:
        owner, found = features(*text_buffer(col), hash_bits)
        near = np.flatnonzero(sieve[(found & U(0xFFFF)).astype(np.int64)])
        owner, found = owner[near], found[near]
        at = np.minimum(np.searchsorted(ids, found), max(len(ids) - 1, 0))
        hit = ids[at] == found if len(ids) else np.zeros(0, bool)
        pairs = np.unique(owner[hit] * len(ids) + at[hit]) if hit.any() else np.zeros(0, np.int64)
        logit = bias + np.bincount(pairs // max(len(ids), 1), weights[pairs % max(len(ids), 1)], minlength=len(col))
        return 1 / (1 + np.exp(-np.clip(logit, -700, 700)))

    return score


def with_score(documents: DataFrame, labels: DataFrame, threshold: float = 0.7, keep: str | None = None) -> DataFrame:
    """doc_id, held_out, score, predicted; with ``keep`` "clean" instead the input's rows that are not predicted toxic."""
    shared = documents.sparkSession.sparkContext.broadcast(fit(documents, labels, doc_crc("doc_id") % 3 != 1))

    if keep:
        names = documents.columns

        def clean(batch: pa.RecordBatch) -> pa.RecordBatch:
            return batch.filter(pa.array(scorer(shared.value)(batch.column("text")) < threshold)).select(names)

        return documents.mapInArrow(over_texts(clean), documents.schema)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        s = scorer(shared.value)(batch.column("text"))
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    source = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", (doc_crc("doc_id") % 3 == 1).alias("held_out"))
    return source.mapInArrow(over_texts(run), "doc_id long, held_out boolean, score double, predicted int")
