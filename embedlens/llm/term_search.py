"""Ranked lexical search by pipelined term partitioning.

Every term of the items is owned by one stage; bundles of items carry sparse accumulators (item, document, score so far) through the
stages one after another, and each stage adds the integer contributions of the terms it owns (pipelined evaluation over a term
partitioned index: Moffat, Webber, Zobel and Baeza-Yates, 2007). Stages are cogroups of bundles with the postings of the stage's terms.

1. The documents are read once: terms are found and hashed in numpy, those of items are compared byte by byte and counted. Documents stand
   in blocks of at most ``DOCS`` documents and about ``POSTINGS`` postings, written as rows of arrays. N, L and document frequencies are
   sums over these.
2. Terms go to stages by weight, the heaviest first, so that the shares of postings grow from stage to stage.
3. Bundles are keyed by (block, bundle), so neither the postings of a frequent term nor the accumulators of an item ever meet in one task;
   a cogroup holds ``ITEMS`` x ``DOCS`` sums.
4. After a stage an accumulator goes only if it can't win: with the most that this block's later terms can add it stays below the score
   that the block's ``top`` best of its item have already. A document that comes back in a later stage lacks what it had, and then stays
   below that score too; so the first ``top`` are exact, ties included.
5. The last stage gives each block's ``top`` for each item, and the first ``top`` of those are the result.

Items are worked off in runs of about ``RUN_BYTES`` of text, each with its own vocabulary; that bounds what is broadcast and what comes to
the driver (a run's terms and their document frequencies).

Defined cases: null text has no terms. Rows with one item_id are one item with the terms of all its distinct texts; a null item_id is an
item. Rows that share a doc_id, and null doc_ids (last among equal scores), are documents of their own. Empty tables give no rows; other
columns are left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from embedlens.llm import textnp
from embedlens.llm.shared import Scratch, slices, text_buffer, tidy

U = np.uint64
#: Documents and postings of a block, items of a bundle: the bounds of what a task holds.
DOCS, POSTINGS, ITEMS = 4096, 1 << 20, 256
RUN_BYTES = 16 << 20
#: Shares of the postings that the stages own.
SHARES = (0.05, 0.15, 0.3, 0.5)
BLOCK = "block long, documents long, terms long, doc_id array<long>, n array<long>, term array<int>, at array<int>, tf array<long>"
POSTED = "block long, bundle int, doc_id array<long>, term array<int>, at array<int>, gain array<long>, later array<long>"
CARRIED = "block long, bundle int, item array<int>, at array<int>, score array<long>"


@dataclass
class Vocabulary:
    """Terms in the order of their hashes, with their bytes; ``item[first[t]:first[t + 1]]`` hold term t ``times`` times."""

    hash: np.ndarray
    data: np.ndarray
    start: np.ndarray
    size: np.ndarray
    first: np.ndarray
    item: np.ndarray
    times: np.ndarray
    ids: list

    @staticmethod
    def of(rows: list) -> Vocabulary:
        """From (item_id, term, times)."""
        ids = sorted({r[0] for r in rows}, key=lambda i: (i is None, i or 0))
        number = {i: k for k, i in enumerate(ids)}
        terms = sorted({r[1] for r in rows})
        raw = [t.encode() for t in terms]
        data, size = np.frombuffer(b"".join(raw), np.uint8), np.fromiter(map(len, raw), np.int64, len(raw))
        start = np.cumsum(size) - size
        h = textnp.span_hash(data, start, start + size)
        order = np.argsort(h, kind="stable")
        place = np.empty(len(terms), np.int64)
        place[order] = np.arange(len(terms))
        at = {t: int(p) for t, p in zip(terms, place)}
        cells = np.array(sorted((at[t], number[i], n) for i, t, n in rows), np.int64).reshape(-1, 3)
        return Vocabulary(h[order], data, start[order], size[order], np.searchsorted(cells[:, 0], np.arange(len(terms) + 1)), cells[:, 1], cells[:, 2], ids)

    def find(self, low: np.ndarray, w: textnp.Words) -> tuple[np.ndarray, np.ndarray]:
        """Which of the words are terms here, and which terms."""
        first = np.searchsorted(self.hash, w.hash)
        found, terms = [], []
        for step in range(1 + int(np.unique(self.hash, return_counts=True)[1].max(initial=0))):  # terms of one hash stand side by side
            at = np.minimum(first + step, len(self.hash) - 1)
            words = np.flatnonzero(self.hash[at] == w.hash)
            words = words[(w.end - w.start)[words] == self.size[at[words]]]
            words = words[textnp.equal_spans(low, w.start[words], self.data, self.start[at[words]], self.size[at[words]])]
            if step and (first[words] + step >= len(self.hash)).any():
                words = words[first[words] + step < len(self.hash)]
            found.append(words)
            terms.append(at[words])
        return np.concatenate(found), np.concatenate(terms)


def _terms(part: pa.RecordBatch) -> tuple[np.ndarray, textnp.Words]:
    data, offsets = text_buffer(part.column("text"))
    return textnp._LOWER[data], textnp.words(data, offsets, gaps=textnp.NOT_ALNUM)


def item_terms(items: DataFrame) -> DataFrame:
    """(item_id, term, times)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                low, w = _terms(part)
                raw = low.tobytes()
                yield pa.RecordBatch.from_arrays([part.column("item_id").take(pa.array(w.doc())), pa.array([raw[a:b].decode() for a, b in zip(w.start.tolist(), w.end.tolist())], pa.string())], names=["item_id", "term"])

    return items.mapInArrow(tidy(run), "item_id long, term string").groupBy("item_id", "term").agg(F.count("*").alias("times"))


def _blocks(vocabulary):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v: Vocabulary = vocabulary.value
        block, held, size = TaskContext.get().partitionId() << 32, [], 0

        def put() -> pa.RecordBatch:
            nonlocal block, held, size
            before = np.cumsum([0, *(len(ids) for _, _, ids, *_ in held)])
            ids = pa.concat_arrays([x[2] for x in held])
            n, term, tf = (np.concatenate([x[i] for x in held]) for i in (3, 4, 6))
            at = np.concatenate([x[5] + b for x, b in zip(held, before)])
            order = np.argsort(term, kind="stable")  # within a term in the block's order
            one = lambda x, t: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x if isinstance(x, pa.Array) else pa.array(x, t))
            columns = [pa.array([block]), pa.array([sum(x[0] for x in held)], pa.int64()), pa.array([sum(x[1] for x in held)], pa.int64()), one(ids, None), one(n, pa.int64()), one(term[order], pa.int32()), one(at[order], pa.int32()), one(tf[order], pa.int64())]
            block, held, size = block + 1, [], 0
            return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in BLOCK.split(", ")])

        for batch in batches:
            for some in slices(batch):
                for a in range(0, some.num_rows, DOCS):
                    part = some.slice(a, DOCS)
                    low, w = _terms(part)
                    n, doc = np.diff(w.first), w.doc()
                    words, terms = v.find(low, w)
                    key, tf = np.unique(doc[words] * len(v.hash) + terms, return_counts=True)
                    owner = key // max(1, len(v.hash))
                    docs = np.unique(owner)
                    if held and (sum(len(x[2]) for x in held) + len(docs) > DOCS or size + len(key) > POSTINGS):
                        yield put()
                    held.append((int(np.count_nonzero(n)), int(n.sum()), part.column("doc_id").take(pa.array(docs)), n[docs], key % max(1, len(v.hash)), np.searchsorted(docs, owner), tf))
                    size += len(key)
        if held:
            yield put()

    return run


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many documents of this partition have each term."""
    total = np.zeros(0, np.int64)
    for batch in batches:
        n = np.bincount(batch.column("term").flatten().to_numpy(zero_copy_only=False).astype(np.int64))
        if len(n) > len(total):
            n[: len(total)] += total
            total = n
        else:
            total[: len(n)] += n
    some = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], names=["term", "df"])


def stages_of(df: np.ndarray, shares=SHARES) -> np.ndarray:
    """Each term's stage: rare, heavy terms first; stages own about ``shares`` of the postings."""
    order = np.argsort(df, kind="stable")
    before = np.cumsum(df[order]) - df[order]
    stage = np.empty(len(df), np.int64)
    stage[order] = np.searchsorted(np.cumsum(shares)[:-1] * max(1, df.sum()), before, "right")
    return stage


def _postings(shared, stage: int, bundles: int, last: bool):
    """Each block's postings of a stage for each bundle: a document's gain from a term, and the most that later stages can add to an item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, weight, owner, documents, terms = shared.value
        names = [c.split()[0] for c in POSTED.split(", ")]
        for batch in batches:
            for row in range(batch.num_rows):
                values = lambda c: batch.column(c).slice(row, 1).flatten().to_numpy(zero_copy_only=False)  # noqa: B023, E731
                n, term, at, tf = (values(c).astype(np.int64) for c in ("n", "term", "at", "tf"))
                m = np.array([25 + 75 * x * documents // terms for x in n.tolist()], np.int64)  # Python's integers don't overflow
                here = owner[term] >= stage
                term, at, tf = term[here], at[here], tf[here]
                gain = weight[term] * (1_000_000_000 * tf // (1000 * tf + 8 * m[at]))
                late = owner[term] > stage
                most, later = np.zeros(len(weight), np.int64), np.zeros(len(v.ids), np.int64)
                np.maximum.at(most, term[late], gain[late])
                rest = np.flatnonzero(most)
                cells = np.concatenate([np.arange(v.first[t], v.first[t + 1]) for t in rest.tolist()]) if len(rest) else np.zeros(0, np.int64)
                np.add.at(later, v.item[cells], v.times[cells] * np.repeat(most[rest], np.diff(v.first)[rest]))
                term, at, gain = term[~late], at[~late], gain[~late]
                for b in range(bundles):
                    held = np.zeros(len(weight), bool)
                    held[np.repeat(np.arange(len(weight)), np.diff(v.first))[v.item // ITEMS == b]] = True
                    mine = held[term]
                    one = lambda x, t: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x if isinstance(x, pa.Array) else pa.array(x, t))
                    ids = batch.column("doc_id").slice(row, 1).flatten() if last else pa.array([], pa.int64())
                    yield pa.RecordBatch.from_arrays([batch.column("block").slice(row, 1), pa.array([b], pa.int32()), one(ids, None), one(term[mine], pa.int32()), one(at[mine], pa.int32()), one(gain[mine], pa.int64()), one(later[b * ITEMS : (b + 1) * ITEMS], pa.int64())], names=names)

    return run


def _visit(shared, last: bool, top: int):
    """One bundle at one stage: what it carries and the stage's postings of its block give what it carries on, or each item's first ``top``."""

    def flat(table: pa.Table, column: str) -> np.ndarray:
        return table.column(column).combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64) if table.num_rows else np.zeros(0, np.int64)

    def run(key, carried: pa.Table, posted: pa.Table) -> pa.Table:
        v = shared.value[0]
        block, bundle = (k.as_py() for k in key)
        count = min(ITEMS, len(v.ids) - bundle * ITEMS)
        term, at, gain = (flat(posted, c) for c in ("term", "at", "gain"))
        item, place, score = (flat(carried, c) for c in ("item", "at", "score"))
        docs = 1 + max(at.max(initial=-1), place.max(initial=-1))
        sums = np.zeros((count, docs), np.int64)
        sums[item, place] = score
        edges = np.flatnonzero(np.diff(term, prepend=-1, append=-1)) if len(term) else np.zeros(1, np.int64)
        for a, b in zip(edges.tolist(), edges[1:].tolist()):
            cells = np.arange(v.first[term[a]], v.first[term[a] + 1])
            cells = cells[v.item[cells] // ITEMS == bundle]
            sums[np.ix_(v.item[cells] % ITEMS, at[a:b])] += v.times[cells][:, None] * gain[None, a:b]
        best = np.partition(sums, docs - top, axis=1)[:, docs - top] if docs >= top else np.zeros(count, np.int64)
        if not last:
            later = flat(posted, "later") if posted.num_rows else np.zeros(count, np.int64)
            item, place = np.nonzero((sums > 0) & (sums + later[:, None] >= best[:, None]))
            one = lambda x, t: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x, t))
            return pa.table([pa.array([block], pa.int64()), pa.array([bundle], pa.int32()), one(item, pa.int32()), one(place, pa.int32()), one(sums[item, place], pa.int64())], names=[c.split()[0] for c in CARRIED.split(", ")])
        item, place = np.nonzero((sums > 0) & (sums >= best[:, None]))
        ids = posted.column("doc_id").combine_chunks().flatten().take(pa.array(place))
        score, missing = sums[item, place], ids.is_null().to_numpy(zero_copy_only=False)
        order = np.lexsort((ids.fill_null(0).to_numpy(), missing, -score, item))
        rank = np.arange(len(order)) - np.searchsorted(item[order], item[order])
        order = order[rank < top]
        return pa.table([pa.array([v.ids[bundle * ITEMS + i] for i in item[order].tolist()], pa.int64()), ids.take(pa.array(order)), pa.array(score[order])], names=["item_id", "doc_id", "score"])

    return run


def _searched(documents: DataFrame, vocabulary: Vocabulary, top: int, shares, scratch: Scratch) -> DataFrame | None:
    """(item_id, doc_id, score) of each block's first ``top``; None where no document has a term."""
    spark = documents.sparkSession
    sent = spark.sparkContext.broadcast(vocabulary)
    blocks = scratch.stash(documents.mapInArrow(tidy(_blocks(sent)), BLOCK), "blocks")
    sent.destroy()
    total = blocks.agg(F.sum("documents").alias("n"), F.sum("terms").alias("l")).first()
    if not total.n:
        return None
    df = np.zeros(len(vocabulary.hash), np.int64)
    # at most as many rows as the run has terms
    for r in blocks.select("term").mapInArrow(tidy(_frequencies), "term int, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():
        df[r.term] = r.df
    weight = np.array([math.floor(1000 * math.log((2 * total.n + 2) / (2 * n + 1))) for n in df.tolist()], np.int64)
    bundles = -(-len(vocabulary.ids) // ITEMS)
    shared = spark.sparkContext.broadcast((vocabulary, weight, stages_of(df, shares), total.n, total.l))
    none = lambda t: F.array().cast(f"array<{t}>")
    carried = blocks.select("block", F.explode(F.sequence(F.lit(0), F.lit(bundles - 1))).alias("bundle"), none("int").alias("item"), none("int").alias("at"), none("long").alias("score"))
    for stage in range(len(shares)):
        last = stage == len(shares) - 1
        posted = blocks.select("block", "doc_id", "n", "term", "at", "tf").mapInArrow(tidy(_postings(shared, stage, bundles, last)), POSTED)
        visit = _visit(shared, last, top)
        carried = carried.groupBy("block", "bundle").cogroup(posted.groupBy("block", "bundle")).applyInArrow(visit, "item_id long, doc_id long, score long" if last else CARRIED)
    found = scratch.stash(carried, "found")
    shared.destroy()
    scratch.drop(blocks)
    return found


def search(documents: DataFrame, items: DataFrame, top: int = 10, shares=SHARES) -> DataFrame:
    """Per item its ``top`` highest-scoring documents with a score above 0: item_id, rank, doc_id, score."""
    spark = documents.sparkSession
    scratch = Scratch(spark, "search")
    documents = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    distinct = items.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text is not null").distinct()
    size = distinct.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    runs = max(1, -(-size // RUN_BYTES))
    found = []
    for run in range(runs):
        mine = distinct.where(F.pmod(F.xxhash64("item_id"), F.lit(runs)) == run) if runs > 1 else distinct
        rows = [tuple(r) for r in item_terms(mine).collect()]  # bounded by RUN_BYTES
        if rows and (part := _searched(documents, Vocabulary.of(rows), top, shares, scratch)) is not None:
            found.append(part)
    if not found:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    best = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = reduce(DataFrame.unionByName, found).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    return ranked.select("item_id", "rank", "doc_id", "score")


#: The same ranking in SQL.
SQL = r"""
WITH terms AS (
  SELECT row, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM (SELECT row_number() OVER () AS row, doc_id, text FROM documents)),
counts AS (SELECT row, doc_id, term, count(*) AS tf FROM terms GROUP BY ALL),
sizes AS (SELECT row, CAST(sum(tf) AS BIGINT) AS n FROM counts GROUP BY row),
totals AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS len FROM sizes),
weights AS (
  SELECT term, CAST(floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w
  FROM counts, totals GROUP BY term),
wanted AS (
  SELECT item_id, term, count(*) AS times FROM (
    SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM (SELECT DISTINCT item_id, text FROM benchmark)) GROUP BY ALL),
scores AS (
  SELECT item_id, row, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // len)))) AS BIGINT) AS score
  FROM wanted JOIN weights USING (term) JOIN counts USING (term) JOIN sizes USING (row), totals GROUP BY item_id, row, doc_id),
ranked AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank, doc_id, score FROM scores WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
"""
