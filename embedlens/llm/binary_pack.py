"""Packing by power-of-two decomposition: every sequence is a piece of one document whose length is a power of two.

A document of L ids gives L div ``max_tokens`` pieces of ``max_tokens`` and one piece for each set bit of the rest, longest first
(dataset decomposition: Pouransari et al., 2024). Pieces of one length make up a bucket; a piece is a sequence by itself, so no
sequence crosses documents, none is padded, and a training batch drawn from one bucket is rectangular. Sequences are numbered without
gaps, bucket after bucket, longest first: ``rank`` is a sequence's place in its bucket, and ``rank div batch`` a batch's.

Tasks number their own pieces; places in the whole bucket come from one count for each task and bucket, so the pieces of a bucket
never meet anywhere. What a task holds is one slice of text, or one text.

Defined cases: null text is empty (one piece, the end id). Rows that share a doc_id and null doc_ids are cut like any others. An empty
table gives no rows. Other columns are left out. ``max_tokens`` must be a power of two.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from embedlens.llm.shared import Scratch, slices, text_buffer, tidy
from embedlens.llm.tokens import encoder

PIECES = "part int, doc_id long, doc_tokens long, start long, length int, ids_crc32 long, bucket int, at long"


def decomposition(lengths: np.ndarray, max_tokens: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, start in it, length) of all pieces of documents with ``lengths``, in order."""
    if max_tokens < 1 or max_tokens & (max_tokens - 1):
        raise ValueError("max_tokens must be a power of two")
    lengths = np.asarray(lengths, np.int64)
    bits = 1 << np.arange(max_tokens.bit_length() - 2, -1, -1, dtype=np.int64)
    # row: a document; first column: how many whole sequences; then one column for each smaller power
    times = np.concatenate([(lengths // max_tokens)[:, None], (lengths[:, None] & bits[None, :]) > 0], axis=1)
    powers = np.concatenate([[max_tokens], bits])
    doc, column = np.nonzero(times)
    n = times[doc, column]
    doc, size = np.repeat(doc, n), np.repeat(powers[column], n)
    ends = np.cumsum(size)
    return doc, ends - size - (np.cumsum(lengths) - lengths)[doc], size


def _cut(tokenizer: str, end_id: int, max_tokens: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e, part = encoder(tokenizer, "byte"), TaskContext.get().partitionId()
        seen = np.zeros(max_tokens.bit_length(), np.int64)
        for batch in batches:
            for some in slices(batch):
                ids, lengths = e.encode(*text_buffer(some.column("text")), end_id)
                raw = memoryview(ids.astype("<u4").tobytes())
                doc, start, size = decomposition(lengths, max_tokens)
                first = np.cumsum(size) - size
                bucket = np.log2(size).astype(np.int32)
                at = np.empty(len(size), np.int64)
                for b in np.unique(bucket).tolist():
                    mine = bucket == b
                    at[mine] = seen[b] + np.arange(np.count_nonzero(mine))
                    seen[b] += np.count_nonzero(mine)
                spans = [raw[4 * a : 4 * (a + n)] for a, n in zip(first.tolist(), size.tolist())]
                out = {
                    "part": pa.array(np.full(len(doc), part, np.int32)), "doc_id": some.column("doc_id").take(pa.array(doc)), "doc_tokens": pa.array(lengths[doc]), "start": pa.array(start),
                    "length": pa.array(size.astype(np.int32)), "ids_crc32": pa.array(list(map(zlib.crc32, spans)), pa.int64()), "bucket": pa.array(bucket), "at": pa.array(at),
                }
                if with_ids:
                    out["ids"] = pa.ListArray.from_arrays(pa.array(np.concatenate([first, first[-1:] + size[-1:]]).astype(np.int32)), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_pydict(out)

    return run


def pack(documents: DataFrame, tokenizer: str, end_id: int = 1, max_tokens: int = 2048, with_ids: bool = False) -> DataFrame:
    """Per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (0), bucket (log2 of the length), rank in the bucket;
    ``with_ids`` adds the ids themselves, for a table partitioned by bucket that training reads."""
    decomposition(np.zeros(0), max_tokens)  # raises here rather than in a task
    scratch = Scratch(documents.sparkSession, "binary")
    source = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    pieces = source.mapInArrow(tidy(_cut(tokenizer, end_id, max_tokens, with_ids), "units"), PIECES + (", ids array<int>" if with_ids else ""))
    pieces = scratch.stash(pieces, "pieces")
    cells = scratch.stash(pieces.groupBy("bucket", "part").agg(F.count("*").alias("n")), "cells")
    # one row a bucket, log2(max_tokens) + 1 of them at most
    counts = {r.bucket: r.n for r in cells.groupBy("bucket").agg(F.sum("n").alias("n")).collect()}
    first, total = {}, 0
    for b in sorted(counts, reverse=True):
        first[b], total = total, total + counts[b]
    begin = F.lit(0).cast("long")
    for b, n in first.items():
        begin = F.when(F.col("bucket") == b, F.lit(n).cast("long")).otherwise(begin)
    before = F.sum("n").over(Window.partitionBy("bucket").orderBy("part")) - F.col("n")
    ranked = pieces.join(cells.select("bucket", "part", before.alias("before")), ["bucket", "part"]).withColumn("rank", F.col("at") + F.col("before"))
    columns = ["doc_id", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "doc_tokens", (begin + F.col("rank")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"), "bucket", "rank"]
    return ranked.select(*columns, *(["ids"] if with_ids else []))
