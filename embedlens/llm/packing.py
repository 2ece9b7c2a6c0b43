"""Best-fit packing of documents into sequences, under several capacities at once.

A piece asks for (tokens, 1 document, tokens**2 of attention cost); a sequence offers ``max_tokens``, ``max_docs`` and ``max_cost``.
Pieces of one length ask for the same, so the plan needs only the count of each length: at most ``max_tokens`` rows, whatever the
input. Sequences are filled one pattern at a time: among the lengths that still fit under every capacity, the next is the one with
the largest weighted dot product of what it asks and what is left, or the smallest weighted norm of what would remain (Panigrahy et
al., 2011). A pattern is repeated as often as the counts allow. Spark then deals pieces out to the plan: by rank among the pieces
of their length, with ranks from counts for each partition and length, so no length's pieces ever meet in one task.

Defined cases: null text is empty (one piece, the end id). A text longer than a sequence holds (``max_tokens``, or the root of
``max_cost`` where that is less) is cut into full pieces and a rest.
Repeated doc_ids and null doc_ids are packed like any others. An empty table gives no rows.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from embedlens.llm.shared import Scratch, slices, text_buffer, tidy
from embedlens.llm.tokens import encoder

PIECES = "part int, doc_id long, piece int, start long, length int, ids_crc32 long, rank long, at long"


def plan(counts: dict[int, int], max_tokens: int, max_docs: int | None = None, max_cost: int | None = None, weights=(1.0, 1e-3, 1e-3), rule: str = "dot") -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, copies, repeats, first sequence, offset): copies of a length stand side by side in each of ``repeats``
    sequences. Lengths are 1 to ``max_tokens``."""
    sizes = np.array(sorted(k for k, n in counts.items() if n), np.int64)
    left = np.array([counts[k] for k in sizes.tolist()], np.int64)
    used = np.zeros(len(sizes), np.int64)
    capacity = np.array([max_tokens, max_docs or max_tokens, max_cost or max_tokens**2], np.float64)
    asks = np.stack([sizes, np.ones_like(sizes), sizes**2], 1) / capacity
    w, out, sequence = np.asarray(weights), [], 0
    if (asks > 1).any():
        raise ValueError("a piece asks for more than a sequence offers")
    alive = np.flatnonzero(left > 0)
    while len(alive):
        spare, pattern, free = np.ones(3), {}, left.copy()
        while True:
            fits = alive[(asks[alive] <= spare + 1e-12).all(1) & (free[alive] > 0)]
            if not len(fits):
                break
            score = asks[fits] @ (w * spare) if rule == "dot" else -(w * (spare - asks[fits]) ** 2).sum(1)
            i = int(fits[len(fits) - 1 - np.argmax(score[::-1])])
            n = 1
            if rule == "dot":  # the same length stays best while it fits, as what is left shrinks alike for all
                n = int(min(free[i], np.floor((spare / asks[i] + 1e-12).min()))) if score.max() == score[-1] and i == fits[-1] else 1
            pattern[i] = pattern.get(i, 0) + n
            free[i] -= n
            spare = spare - n * asks[i]
        repeats = int(min(left[i] // n for i, n in pattern.items()))
        offset = 0
        for i, n in pattern.items():
            out.append((int(sizes[i]), int(used[i]), n, repeats, sequence, offset))
            used[i] += n * repeats
            left[i] -= n * repeats
            offset += n * int(sizes[i])
        sequence += repeats
        alive = alive[left[alive] > 0]
    return out


def _pieces(tokenizer: str, end_id: int, max_tokens: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e, part = encoder(tokenizer, "word"), TaskContext.get().partitionId()
        seen, at = np.zeros(max_tokens + 1, np.int64), 0
        for batch in batches:
            for some in slices(batch):
                ids, lengths = e.encode(*text_buffer(some.column("text")), end_id)
                raw = ids.astype("<u4").tobytes()
                n = -(-lengths // max_tokens)
                doc = np.repeat(np.arange(len(n)), n)
                piece = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                start = piece * max_tokens
                length = np.minimum(max_tokens, lengths[doc] - start)
                first = (np.cumsum(lengths) - lengths)[doc] + start
                crc = [zlib.crc32(raw[4 * a : 4 * (a + b)]) for a, b in zip(first.tolist(), length.tolist())]
                order = np.argsort(length, kind="stable")
                by = length[order]
                new = np.concatenate([[True], by[1:] != by[:-1]])
                begin = np.maximum.accumulate(np.where(new, np.arange(len(by)), 0))
                rank = np.empty(len(by), np.int64)
                rank[order] = np.arange(len(by)) - begin + seen[by]
                np.add.at(seen, length, 1)
                ids_ = some.column("doc_id").take(pa.array(doc))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(doc), part, np.int32)), ids_, pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length.astype(np.int32)), pa.array(crc, pa.int64()), pa.array(rank), pa.array(at + np.arange(len(doc)))], names=["part", "doc_id", "piece", "start", "length", "ids_crc32", "rank", "at"])
                at += len(doc)

    return run


def pack(documents: DataFrame, tokenizer: str, end_id: int = 1, max_tokens: int = 4096, max_docs: int | None = None, max_cost: int | None = None, rule: str = "dot") -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset. ``max_docs`` and ``max_cost`` (the sum of squared
    piece lengths) default to values that never bind."""
    spark = documents.sparkSession
    scratch = Scratch(spark, "packing")
    longest = min(max_tokens, math.isqrt(max_cost)) if max_cost else max_tokens
    if longest < 1 or (max_docs is not None and max_docs < 1):
        raise ValueError("a sequence must hold a piece")
    source = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    pieces = scratch.stash(source.mapInArrow(tidy(_pieces(tokenizer, end_id, longest), "units"), PIECES), "pieces")
    cells = scratch.stash(pieces.groupBy("length", "part").agg(F.count("*").alias("n")), "cells")
    # at most max_tokens rows come to the driver
    counts = {r.length: r.n for r in cells.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    rows = plan(counts, max_tokens, max_docs, max_cost, rule=rule)
    table = np.array(sorted(rows), np.int64).reshape(-1, 6)
    shared = spark.sparkContext.broadcast(table)
    before = Window.partitionBy("length").orderBy("part")
    base = cells.select("length", "part", (F.sum("n").over(before) - F.col("n")).alias("before"))
    ranked = pieces.join(base, ["length", "part"])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = shared.value
        key = (t[:, 0] << 44) + t[:, 1]  # a length's first ranks ascend
        for batch in batches:
            if not batch.num_rows:
                continue
            length, rank, before = (batch.column(c).to_numpy().astype(np.int64) for c in ("length", "rank", "before"))
            rank = rank + before
            row = t[np.searchsorted(key, (length << 44) + rank, "right") - 1]
            inside = rank - row[:, 1]
            copy, turn = inside // row[:, 3], inside % row[:, 3]
            columns = [batch.column(c) for c in ("doc_id", "piece", "start")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(length), batch.column("ids_crc32"), pa.array(row[:, 4] + turn), pa.array(row[:, 5] + copy * length)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank", "before").mapInArrow(tidy(deal), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
