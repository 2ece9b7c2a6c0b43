"""Line dedup: range-partitioned line hashes, streamed in order, give compressed keep bitmaps per document.

1. Every text is split at ``\\n``; each line whose key is long enough sends one row ``(key hash, doc_id, text hash, position)``. The key
   hash has 128 bits; the text hash tells rows apart that share a doc_id. A document also sends its count of lines.
2. The rows are range-partitioned by (hash, doc_id, text hash), so a line that a third of all documents hold is dealt over many tasks, and
   sorted within partitions by hash, descending doc_id and position. A task streams them: a run's first document keeps its lines, the
   rest of a run of ``min_docs`` documents or more is dropped. Runs inside a partition are decided at once. A run that touches a
   partition's edge, or is too long to wait for its end, sends its first and last document and the count of those between; its rows are
   decided by joining these sums.
3. A document's dropped positions become a bitmap over its lines (bit 1: kept), zlib-compressed. These bitmaps are the result; up to here
   no text has left its task.
4. Texts or their digests, where they are asked for, come from applying bitmaps to the texts. The bitmaps of documents that lose lines are
   broadcast if they measure at most ``BROADCAST_BYTES``, so that no text is shuffled; beyond that both sides are joined by doc_id and
   text hash.

Defined cases: null or empty text is one empty line, which is never long enough to drop. Null doc_id counts as one document,
smaller than all others. Rows that share a doc_id count as one document; each gets a row of its own. Lines are compared by their
key: all of ``[\\x20\\x09-\\x0D]`` stripped at both ends and A-Z lower-cased. An empty table gives no rows. Other columns of the
input are left alone, whatever their names.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from embedlens.llm.shared import Scratch, fresh, over_texts, tidy

SPACE = b" \t\n\x0b\x0c\r"
LINES = "h1 long, h2 long, doc_id long, rid long, pos int"
RUNS = "edge int, h1 long, h2 long, doc_id long, rid long, pos int, docs long"
#: Bitmaps of changed documents up to this size are broadcast.
BROADCAST_BYTES = 64 << 20
#: A run's rows wait for its end up to this many; beyond, they are decided like a partition's edge.
RUN_ROWS = 200_000


def line_keys(text: bytes, min_chars: int) -> list[bytes | None]:
    """16-byte digests of the lines' keys, None for keys that are too short."""
    out = []
    for line in text.lower().split(b"\n"):  # bytes.lower() changes A-Z only
        key = line.strip(SPACE)
        if len(key) < min_chars or (not key.isascii() and len(key.decode()) < min_chars):
            out.append(None)
        else:
            out.append(xxhash.xxh3_128_digest(key))
    return out


def _lines(min_chars: int):
    """A row for each long enough line; and for each document one without hash, whose ``pos`` is its count of lines."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        digests, doc, pos, counts = [], [], [], []
        for i, text in enumerate(batch.column("text").cast(pa.large_binary()).to_pylist()):
            found = line_keys(text or b"", min_chars)
            at = [j for j, k in enumerate(found) if k]
            digests += [found[j] for j in at]
            pos += at
            doc += [i] * len(at)
            counts.append(len(found))
        n = len(counts)
        both = np.frombuffer(b"".join(digests), dtype=np.int64).reshape(-1, 2)
        take = pa.array(np.concatenate([np.array(doc, np.int64), np.arange(n)]))
        hashes = [pa.concat_arrays([pa.array(both[:, i]), pa.nulls(n, pa.int64())]) for i in (0, 1)]
        return pa.RecordBatch.from_arrays([*hashes, batch.column("doc_id").take(take), batch.column("rid").take(take), pa.array(pos + counts, pa.int32())], names=["h1", "h2", "doc_id", "rid", "pos"])

    return over_texts(run)


class _Rows:
    """Columns of sorted rows as arrays; null doc_ids have ``null`` set and 0 as doc."""

    names = ("h1", "h2", "doc", "null", "rid", "pos")

    def __init__(self, columns: list[np.ndarray]):
        self.columns = columns
        self.h1, self.h2, self.doc, self.null, self.rid, self.pos = columns

    @classmethod
    def of(cls, batch: pa.RecordBatch) -> _Rows:
        doc = batch.column("doc_id")
        rest = [batch.column(c).to_numpy() for c in ("h1", "h2", "rid", "pos")]
        return cls([*rest[:2], doc.fill_null(0).to_numpy(), np.asarray(doc.is_null()), *rest[2:]])

    def __len__(self) -> int:
        return len(self.h1)

    def __getitem__(self, at) -> _Rows:
        return _Rows([c[at] for c in self.columns])

    def after(self, before: _Rows) -> _Rows:
        return _Rows([np.concatenate(x) for x in zip(before.columns, self.columns)])

    def changes(self, *names: str) -> np.ndarray:
        """True where a row differs from the one before in any of the columns; true for the first."""
        out = np.ones(len(self), bool)
        out[1:] = np.logical_or.reduce([getattr(self, c)[1:] != getattr(self, c)[:-1] for c in names])
        return out

    def send(self, edge: int, docs: int = 0) -> pa.RecordBatch:
        n = len(self)
        return pa.RecordBatch.from_arrays([pa.array(np.full(n, edge, np.int32)), pa.array(self.h1), pa.array(self.h2), pa.array(self.doc, mask=self.null), pa.array(self.rid), pa.array(self.pos), pa.array(np.full(n, docs, np.int64))], names=["edge", "h1", "h2", "doc_id", "rid", "pos", "docs"])


def _stream(min_docs: int, run_rows: int):
    """Over rows sorted by (h1, h2, doc_id descending, rid, pos): what is decided, and what touches the partition's edges.

    ``edge`` 0: this position is dropped. 1: a row of an edge run, undecided. 2: an edge run's first or last document, with the count of
    documents between.
    """

    def decided(rows: _Rows) -> _Rows:
        """Drops of complete runs."""
        new_run, new_doc = rows.changes("h1", "h2"), rows.changes("h1", "h2", "doc", "null")
        run = np.cumsum(new_run) - 1
        docs = np.bincount(run, new_doc)
        order = np.cumsum(new_doc)
        first = order[new_run][run]  # the run's largest document
        return rows[(docs[run] >= min_docs) & (order != first)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: _Rows | None = None  # the run that the last batch ended in
        edge: list | None = None  # a run that touches an edge: first row, last row, documents so far
        begun, last = False, None

        def summary() -> Iterator[pa.RecordBatch]:
            first, end, docs = edge
            yield first.send(2, max(0, docs - 2))
            if docs > 1:
                yield end.send(2)

        def into_edge(rows: _Rows) -> pa.RecordBatch:
            nonlocal edge
            both = rows if edge is None else rows.after(edge[1])
            docs = int(both.changes("doc", "null").sum()) - (0 if edge is None else 1)
            edge = [rows[:1], rows[-1:], docs] if edge is None else [edge[0], rows[-1:], edge[2] + docs]
            return rows.send(1)

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = _Rows.of(batch)
            both = rows if last is None else rows.after(last)
            new = both.changes(*_Rows.names)[len(both) - len(rows) :]
            last, rows = rows[-1:], rows[new]  # equal rows of documents that are there twice
            if not len(rows):
                continue
            if not begun:
                begun, n = True, int(np.append(np.flatnonzero(rows.changes("h1", "h2")[1:]) + 1, len(rows))[0])
                yield into_edge(rows[:n])
                rows = rows[n:]
            elif edge is not None:
                same = (rows.h1 == edge[1].h1[0]) & (rows.h2 == edge[1].h2[0])
                n = int(same.sum())
                if n:
                    yield into_edge(rows[:n])
                rows = rows[n:]
            if not len(rows):
                continue
            if edge is not None:
                yield from summary()
                edge = None
            rows = rows if held is None else rows.after(held)
            begin = int(np.flatnonzero(rows.changes("h1", "h2"))[-1])
            yield decided(rows[:begin]).send(0)
            held = rows[begin:]
            if len(held) > run_rows:
                yield into_edge(held)
                held = None
        if held is not None:  # the partition's last run
            yield into_edge(held)
        if edge is not None:
            yield from summary()

    return run


def dropped_lines(lines: DataFrame, scratch: Scratch, min_docs: int = 5) -> tuple[DataFrame, DataFrame]:
    """(doc_id, rid, pos): the positions that a document loses, and the written runs they come from; ``lines`` has a row for each long
    enough line."""
    order = [F.asc("h1"), F.asc("h2"), F.desc_nulls_last("doc_id"), F.asc("rid")]
    runs = lines.repartitionByRange(*order).sortWithinPartitions(*order, "pos").mapInArrow(tidy(_stream(min_docs, RUN_ROWS)), RUNS)
    runs = scratch.stash(runs, "runs")
    ends = F.count_distinct(F.struct(F.col("doc_id").isNull(), F.coalesce("doc_id", F.lit(0))))
    total = runs.where("edge = 2").groupBy("h1", "h2").agg((F.sum("docs") + ends).alias("all_docs"), F.max("doc_id").alias("kept_in")).where(F.col("all_docs") >= min_docs)
    edge = runs.where("edge = 1").join(total, ["h1", "h2"]).where(~F.col("doc_id").eqNullSafe(F.col("kept_in")))
    return runs.where("edge = 0").select("doc_id", "rid", "pos").union(edge.select("doc_id", "rid", "pos")), runs


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lost, keep = [], []
        for n, gone in zip(batch.column("n_lines").to_pylist(), batch.column("gone")):
            kept = np.ones(n, bool)
            if gone.is_valid:
                kept[gone.values.to_numpy()] = False
            lost.append(n - int(kept.sum()))
            keep.append(zlib.compress(np.packbits(kept).tobytes(), 1))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("rid"), batch.column("n_lines"), pa.array(lost, pa.int64()), pa.array(keep, pa.binary())], names=["doc_id", "rid", "n_lines", "n_dropped", "keep"])


def bitmaps(documents: DataFrame, scratch: Scratch, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """(doc_id, rid, n_lines, n_dropped, keep) of every row: compressed bitmaps, most significant bit first."""
    source = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("rid"), "text")
    lines = scratch.stash(source.mapInArrow(_lines(min_chars), LINES), "lines")
    gone, runs = dropped_lines(lines.where("h1 is not null"), scratch, min_docs)
    gone = gone.groupBy("doc_id", "rid").agg(F.collect_list("pos").alias("gone"))
    gone = gone.select(F.col("doc_id").alias("gone_doc"), F.col("rid").alias("gone_rid"), "gone")
    docs = lines.where("h1 is null").select("doc_id", "rid", F.col("pos").cast("long").alias("n_lines"))
    joined = docs.join(gone, docs["doc_id"].eqNullSafe(gone["gone_doc"]) & (docs["rid"] == gone["gone_rid"]), "left")
    found = joined.select("doc_id", "rid", "n_lines", "gone").mapInArrow(tidy(_bitmaps), "doc_id long, rid long, n_lines long, n_dropped long, keep binary")
    found = scratch.stash(found, "bitmaps")
    scratch.drop(lines, runs)
    return found


def apply_bitmap(text: str | None, n: int, bitmap: bytes) -> str:
    """The kept lines, joined by newlines."""
    kept = np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8), count=n).astype(bool)
    return text or "" if kept.all() else "\n".join(line for line, k in zip((text or "").split("\n"), kept) if k)


def line_dedup(documents: DataFrame, min_chars: int = 40, min_docs: int = 5, emit: str = "bitmap", limit: int = BROADCAST_BYTES) -> DataFrame:
    """One row for each document; ``min_docs`` documents must share a key of at least ``min_chars`` code points.

    emit "bitmap": doc_id, n_lines, n_dropped, keep (compressed bitmap). "digest": kept_sha256 instead of keep. "text": the input's
    columns with the kept text, and n_chars (of changed rows) where there is such a column. ``limit``: see ``BROADCAST_BYTES``.
    """
    scratch = Scratch(documents.sparkSession, "lines")
    found = bitmaps(documents, scratch, min_chars, min_docs)
    if emit == "bitmap":
        return found.drop("rid")
    changed = found.where("n_dropped > 0").dropDuplicates(["doc_id", "rid"])
    size = changed.agg(F.coalesce(F.sum(F.length("keep") + 64), F.lit(0))).first()[0]
    source = documents if emit == "text" else documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    names = source.columns
    doc, rid, keep, n_lines = fresh(names, "doc", "rid", "keep", "n_lines")
    changed = changed.select(F.col("doc_id").alias(doc), F.col("rid").alias(rid), F.col("keep").alias(keep), F.col("n_lines").alias(n_lines))
    on = source["doc_id"].cast("long").eqNullSafe(F.col(doc)) & (F.xxhash64(source["text"]) == F.col(rid))
    joined = source.join(F.broadcast(changed) if size <= limit else changed, on, "left").drop(doc, rid)

    def kept_texts(batch: pa.RecordBatch) -> list[str | None]:
        """The texts of changed rows, None for the others."""
        return [None if k is None else apply_bitmap(t, n, k) for t, k, n in zip(batch.column("text").to_pylist(), batch.column(keep).to_pylist(), batch.column(n_lines).to_pylist())]

    def as_text(batch: pa.RecordBatch) -> pa.RecordBatch:
        columns, kept = {c: batch.column(i) for i, c in enumerate(batch.schema.names)}, kept_texts(batch)
        if any(k is not None for k in kept):
            columns["text"] = pa.array([t if k is None else k for t, k in zip(columns["text"].to_pylist(), kept)], columns["text"].type)
            if "n_chars" in names:
                columns["n_chars"] = pa.array([o if k is None else len(k) for o, k in zip(columns["n_chars"].to_pylist(), kept)], columns["n_chars"].type)
        return pa.RecordBatch.from_arrays([columns[c] for c in names], names=names)

    def as_digest(batch: pa.RecordBatch) -> pa.RecordBatch:
        n, lost, digest = [], [], []
        for text, kept, bitmap in zip(batch.column("text").to_pylist(), kept_texts(batch), batch.column(keep).to_pylist()):
            n.append((text or "").count("\n") + 1)
            bits = 0 if bitmap is None else int(np.bitwise_count(np.frombuffer(zlib.decompress(bitmap), np.uint8)).sum())
            lost.append(0 if bitmap is None else n[-1] - bits)
            digest.append(hashlib.sha256(((text or "") if kept is None else kept).encode()).hexdigest())
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(lost, pa.int64()), pa.array(digest)], names=["doc_id", "n_lines", "n_dropped", "kept_sha256"])

    if emit == "text":
        return joined.mapInArrow(over_texts(as_text), source.schema)
    return joined.mapInArrow(over_texts(as_digest), "doc_id long, n_lines long, n_dropped long, kept_sha256 string")


SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos
  FROM documents
), keyed AS (
  SELECT doc_id, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines
), shared AS (
  SELECT k, max(doc_id) AS kept_in FROM keyed WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5
), marked AS (
  SELECT y.doc_id, y.pos, y.line, s.k IS NOT NULL AND s.kept_in <> y.doc_id AS gone FROM keyed y LEFT JOIN shared s ON y.k = s.k
)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
