"""Token ids in compressed files: a wavelet matrix per shard.

Documents are range-partitioned and sorted by doc_id and a hash of their texts, encoded, and cut into shards of whole documents. A shard's
file holds the document ids and lengths, and one bit-plane for each bit of an id, most significant first: plane k has bit k of the ids as
ordered by the planes before it (zeros first, stably). Each plane has a rank directory: ones before every ``BLOCK`` bits. Access and
counting take one block a plane; select takes one block a plane besides a binary search of its directory (Claude, Navarro, Ordonez, 2015).
Planes are compressed in chunks, and only the chunks that a lookup touches are unpacked. Files are the rows of a written table
(``payload``), so they lie in any store that Spark writes to.

Defined cases: a null text is empty and gets the end id alone. Equal doc_ids come in the order of their texts' hashes, null doc_ids first.
An empty table gives no shard. Other columns are left out.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from embedlens.llm.shared import Scratch, shuffle_partitions, slices, text_buffer, tidy
from embedlens.llm.tokens import encoder

MAGIC = b"WMX2"
BLOCK = 512  # bits between two entries of a rank directory
WIDTH = BLOCK // 8
CHUNK = 128  # blocks that are compressed together
SHARD_TOKENS = 1 << 20
FILES = "part int, shard int, n_docs long, n_tokens long, payload binary"


class Plane:
    """One bit-plane as rows of ``WIDTH`` bytes with its rank directory; from an array, or from compressed parts that are unpacked when
    they are touched."""

    def __init__(self, rows: np.ndarray | None = None, parts: list | None = None):
        self.chunks = {0: rows} if rows is not None else {}
        self.size = max(1, len(rows)) if rows is not None else CHUNK
        self.parts = parts
        ones = np.bitwise_count(rows).sum(1, dtype=np.int64) if rows is not None else None
        self._ranks = np.concatenate([[0], np.cumsum(ones)]).astype(np.uint32) if rows is not None else None

    @property
    def ranks(self) -> np.ndarray:
        if self._ranks is None:
            self._ranks = np.frombuffer(zstandard.decompress(self.parts[0]), np.uint32)
        return self._ranks

    def _chunk(self, i: int) -> np.ndarray:
        if i not in self.chunks:
            self.chunks[i] = np.frombuffer(zstandard.decompress(self.parts[1 + i]), np.uint8).reshape(-1, WIDTH)
        return self.chunks[i]

    def bits(self, block: np.ndarray) -> np.ndarray:
        """The bits of the given blocks, a row each."""
        out = np.zeros((len(block), WIDTH), np.uint8)
        chunk = block // self.size
        for i in np.unique(chunk):
            mine = chunk == i
            out[mine] = self._chunk(int(i))[block[mine] - i * self.size]
        return np.unpackbits(out, axis=1)

    def all(self, n: int) -> np.ndarray:
        if self.parts is not None and len(self.parts) > 1:
            whole = np.concatenate([self._chunk(i) for i in range(len(self.parts) - 1)])
        else:
            whole = self.chunks.get(0, np.zeros((0, WIDTH), np.uint8))
        return np.unpackbits(whole.reshape(-1), count=n).astype(bool)

    def rank1(self, at: np.ndarray) -> np.ndarray:
        """Ones before each place."""
        block = np.minimum(at // BLOCK, max(len(self.ranks) - 2, 0))
        if len(self.ranks) < 2:
            return np.zeros(len(at), np.int64)
        before = np.arange(BLOCK)[None, :] < (at - block * BLOCK)[:, None]
        return self.ranks[block].astype(np.int64) + (self.bits(block).astype(bool) & before).sum(1)

    def select(self, bit: int, i: np.ndarray) -> np.ndarray:
        """The place of occurrence ``i`` (from 0) of ``bit``: a binary search of the directory, then one block."""
        ones = self.ranks.astype(np.int64)
        before = ones if bit else np.arange(len(ones)) * BLOCK - ones
        block = np.searchsorted(before, i, "right") - 1
        seen = np.cumsum(self.bits(block) == bit, axis=1)
        return block * BLOCK + (seen > (i - before[block])[:, None]).argmax(1)

    def packed(self) -> list[bytes]:
        pack, rows = zstandard.ZstdCompressor(level=1).compress, self.chunks[0]
        return [pack(self.ranks.tobytes()), *(pack(rows[a : a + CHUNK].tobytes()) for a in range(0, len(rows), CHUNK))]


class WaveletMatrix:
    """Access, rank, select and counts over a sequence of ids, from bit-planes."""

    def __init__(self, n: int, planes: list[Plane], zeros: list[int]):
        self.n, self.planes, self.zeros = n, planes, zeros

    @classmethod
    def build(cls, ids: np.ndarray, bits: int) -> WaveletMatrix:
        n, planes, zeros = len(ids), [], []
        now = ids.astype(np.uint16 if bits <= 16 else np.uint32)
        for k in range(bits - 1, -1, -1):
            bit = (now & now.dtype.type(1 << k)).astype(bool)
            packed = np.packbits(bit)
            planes.append(Plane(np.concatenate([packed, np.zeros(-len(packed) % WIDTH, np.uint8)]).reshape(-1, WIDTH)))
            first, then = np.flatnonzero(~bit), np.flatnonzero(bit)  # taken by place: masks cost twice as much
            now = np.concatenate([now.take(first), now.take(then)])
            zeros.append(len(first))
        return cls(n, planes, zeros)

    def access(self, at) -> np.ndarray:
        """The ids at the given places."""
        at, out = np.atleast_1d(np.asarray(at, np.int64)), 0
        for plane, zeros in zip(self.planes, self.zeros):
            ones, more = plane.rank1(at), plane.rank1(at + 1)
            bit = more - ones
            out = out * 2 + bit
            at = np.where(bit == 1, zeros + ones, at - ones)
        return out

    def _bit(self, symbol: int, k: int) -> int:
        return symbol >> (len(self.planes) - 1 - k) & 1

    def _range(self, symbol: int, stop: int) -> tuple[int, int]:
        """Where ``symbol`` among the first ``stop`` ids lies in the last order."""
        a, b = 0, stop
        for k, plane in enumerate(self.planes):
            ra, rb = (int(x) for x in plane.rank1(np.array([a, b])))
            if self._bit(symbol, k):
                a, b = self.zeros[k] + ra, self.zeros[k] + rb
            else:
                a, b = a - ra, b - rb
        return a, b

    def rank(self, symbol: int, stop: int) -> int:
        """Occurrences of ``symbol`` before ``stop``."""
        a, b = self._range(symbol, stop)
        return b - a

    def count(self, symbol: int) -> int:
        return self.rank(symbol, self.n)

    def _up(self, symbol: int, at: np.ndarray) -> np.ndarray:
        """From places in the last order to places in the sequence."""
        for k in range(len(self.planes) - 1, -1, -1):
            one = self._bit(symbol, k)
            at = self.planes[k].select(one, at - self.zeros[k] * one)
        return at

    def select(self, symbol: int, i: int) -> int:
        """The place of occurrence ``i`` (from 0) of ``symbol``."""
        a, b = self._range(symbol, self.n)
        if not 0 <= i < b - a:
            raise IndexError(i)
        return int(self._up(symbol, np.array([a + i]))[0])

    def occurrences(self, symbol: int) -> np.ndarray:
        """All places of ``symbol``, ascending."""
        a, b = self._range(symbol, self.n)
        parts = [self._up(symbol, np.arange(x, min(b, x + 4096))) for x in range(a, b, 4096)]
        return np.concatenate(parts) if parts else np.zeros(0, np.int64)

    def decode(self) -> np.ndarray:
        """All ids in their order, plane by plane from the last."""
        now = np.zeros(self.n, np.uint16 if len(self.planes) <= 16 else np.uint32)
        for k in range(len(self.planes) - 1, -1, -1):
            bit = self.planes[k].all(self.n)
            up = np.empty_like(now)
            up[np.flatnonzero(~bit)] = now[: self.zeros[k]]
            up[np.flatnonzero(bit)] = now[self.zeros[k] :] | now.dtype.type(1 << (len(self.planes) - 1 - k))
            now = up
        return now.astype(np.uint32)


def write_shard(doc_ids: list[int | None], lengths: np.ndarray, ids: np.ndarray, bits: int) -> bytes:
    """One file: header, sizes of parts, documents, then each plane's rank directory and chunks; parts are zstandard-compressed."""
    m = WaveletMatrix.build(ids, bits)
    pack = zstandard.ZstdCompressor(level=1).compress
    null = np.fromiter((d is None for d in doc_ids), bool, len(doc_ids))
    numbers = np.fromiter((d or 0 for d in doc_ids), np.int64, len(doc_ids))
    parts = [pack(np.packbits(null).tobytes()), pack(numbers.tobytes()), pack(np.asarray(lengths, np.uint32).tobytes())]
    for plane in m.planes:
        parts += plane.packed()
    head = struct.pack("<4sBQQQ", MAGIC, bits, len(doc_ids), m.n, len(parts)) + struct.pack(f"<{bits}Q", *m.zeros) + struct.pack(f"<{len(parts)}Q", *map(len, parts))
    return head + b"".join(parts)


def read_shard(payload: bytes) -> tuple[list[int | None], np.ndarray, WaveletMatrix]:
    """Documents, their lengths, and the matrix, whose planes are unpacked as they are touched."""
    magic, bits, n_docs, n, n_parts = struct.unpack_from("<4sBQQQ", payload)
    if magic != MAGIC:
        raise ValueError("not a shard file")
    at = struct.calcsize("<4sBQQQ")
    zeros = list(struct.unpack_from(f"<{bits}Q", payload, at))
    at += 8 * bits
    sizes = struct.unpack_from(f"<{n_parts}Q", payload, at)
    at += 8 * n_parts
    whole, parts = memoryview(payload), []
    for size in sizes:
        parts.append(whole[at : at + size])
        at += size
    unpack = zstandard.ZstdDecompressor().decompress
    null = np.unpackbits(np.frombuffer(unpack(parts[0]), np.uint8), count=n_docs).astype(bool)
    docs = [None if x else d for d, x in zip(np.frombuffer(unpack(parts[1]), np.int64).tolist(), null)]
    lengths, each = np.frombuffer(unpack(parts[2]), np.uint32), (n_parts - 3) // bits
    return docs, lengths, WaveletMatrix(n, [Plane(parts=parts[3 + k * each : 3 + (k + 1) * each]) for k in range(bits)], zeros)


def write_store(documents: DataFrame, path: str, tokenizer: str, end_id: int, bits: int = 16, shard_tokens: int = SHARD_TOKENS) -> None:
    """Writes the shard table; rows (part, shard) in order hold all documents in ascending doc_id order.

    A shard ends with the document that brings it to ``shard_tokens``; ids must be below ``2**bits``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e, part = encoder(tokenizer, "byte"), TaskContext.get().partitionId()
        held, shard = [], 0

        def row() -> pa.RecordBatch:
            docs = [d for x in held for d in x[0]]
            lengths, ids = np.concatenate([x[1] for x in held]), np.concatenate([x[2] for x in held])
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([shard], pa.int32()), pa.array([len(docs)]), pa.array([len(ids)]), pa.array([write_shard(docs, lengths, ids, bits)], pa.binary())], names=["part", "shard", "n_docs", "n_tokens", "payload"])

        for batch in batches:
            for piece in slices(batch):
                ids, lengths = e.encode(*text_buffer(piece.column("text")), end_id)
                held.append((piece.column("doc_id").to_pylist(), lengths, ids))
                if sum(len(x[2]) for x in held) >= shard_tokens:
                    yield row()
                    held, shard = [], shard + 1
        if held:
            yield row()

    source = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("h"))
    n = shuffle_partitions(documents.sparkSession)
    ordered = source.repartitionByRange(n, "doc_id", "h").sortWithinPartitions("doc_id", "h", "text")  # a frequent id is dealt by its texts
    ordered.select("doc_id", "text").mapInArrow(tidy(run, "units"), FILES).write.option("compression", "uncompressed").parquet(path)


def read_store(spark, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, decoded from the files."""
    files = spark.read.schema(FILES).parquet(path)
    # at most as many rows as there were partitions meet in one task; a partition's shards are summed apart
    parts = files.groupBy("part").agg(F.sum("n_tokens").alias("part_tokens"))
    parts = parts.select("part", (F.sum("part_tokens").over(Window.orderBy("part")) - F.col("part_tokens")).alias("part_start"))
    within = Window.partitionBy("part").orderBy("shard")
    base = files.select("part", "shard", (F.sum("n_tokens").over(within) - F.col("n_tokens")).alias("shard_start")).join(parts, "part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, shard, payload in zip(*(batch.column(c).to_pylist() for c in ("part", "shard", "payload"))):
                docs, lengths, m = read_shard(payload)
                ids = m.decode().astype("<u4").tobytes()
                ends = np.cumsum(lengths.astype(np.int64))
                crcs = [zlib.crc32(ids[4 * (b - n) : 4 * b]) for b, n in zip(ends.tolist(), lengths.tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(docs), part, np.int32)), pa.array(np.full(len(docs), shard, np.int32)), pa.array(docs, pa.int64()), pa.array(ends - lengths), pa.array(lengths.astype(np.int64)), pa.array(crcs, pa.int64())], names=["part", "shard", "doc_id", "at", "n_tokens", "ids_crc32"])

    rows = files.select("part", "shard", "payload").mapInArrow(tidy(run), "part int, shard int, doc_id long, at long, n_tokens long, ids_crc32 long")
    return rows.join(base, ["part", "shard"]).select("doc_id", (F.col("part_start") + F.col("shard_start") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def token_store(documents: DataFrame, tokenizer: str, end_id: int = 0) -> DataFrame:
    scratch = Scratch(documents.sparkSession, "tokens")
    path = f"{scratch.root}/shards"
    write_store(documents, path, tokenizer, end_id)
    return read_store(documents.sparkSession, path)
