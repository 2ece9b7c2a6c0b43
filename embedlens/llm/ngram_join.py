"""N-gram Jaccard join by token-combination prefixes, and the groups that its links make.

A document's tokens are its distinct word shingles (64-bit hashes). Two sets x, y link when 100*|x & y| >= 80*|x | y|.

1. Count in how many documents each token occurs. Tasks send sorted hashes packed to 5 bytes, not rows; each hash range gives back
   two Bloom filter blocks of fixed size: tokens in two documents or more, and tokens of the *frequent* class. The class begins at
   three documents, or at the next power of two at which the range's frequent tokens fit its block. A filter may take a token for more
   frequent than it is: classes need only be the same for all documents, results don't depend on them.
2. Tokens are ordered: single-document tokens (nothing to index), rare, frequent; by hash within a class. With e = |x| - ceil(0.8|x|)
   tokens that x may miss, its prefix is extended until removing any e of its tokens leaves a signature: a rare token is one by
   itself; of frequent tokens any two of one sub-class are one (a sub-class of c gives c - 1 towards e + 1). Two linked sets then share
   a signature: the one whose prefix ends first misses at most e of its own prefix tokens, and all others lie in both prefixes
   (partitioned k-wise signatures: Wang et al., 2016). Sub-classes depend on a size bracket (powers of 100 / percent); a set also sends
   signatures for the bracket below, so sets of neighbouring brackets meet.
3. Equal sets are one class from here on. Buckets of at most ``SMALL`` sets give all pairs; in larger ones each set meets one pivot, the
   set with the fewest tokens of its own (of near copies that is mostly the original), so rows stay linear in a bucket's size. Buckets
   that then hold one component are settled. The others make clusters of sets that share such a bucket; in each cluster all sets outside
   its largest component are compared with all its sets of neighbouring size brackets, in blocks against blocks inside tasks, which send
   on spanning links only.
4. Candidates are verified on their whole sets; links make connected components.

No text leaves its task; packed sets are kept for documents with signatures only.

Defined cases: null, empty or blank text has no set, links with nothing, and is its own component; with fewer words than a shingle the
whole sequence is the one token. ``percent`` is 20 to 100; below, sub-classes could not hold enough tokens, so it raises. Rows that share a doc_id count as one document that has all its rows' links; each gives a row. A null
doc_id links with nothing and has a null component unless an equal set has an id. An empty table gives no rows; other columns are
left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from embedlens.llm import textnp
from embedlens.llm.components import connected_components
from embedlens.llm.shared import Scratch, fresh, over_texts, power_of_two, shuffle_partitions, slices, text_buffer, tidy

U = np.uint64
#: Buckets of at most so many sets give all their pairs at once.
SMALL = 4
#: Sets in a block of a large cluster.
BLOCK = 64
#: Bits of each Bloom filter over all ranges at most: the bound of what is broadcast (2 x 32 MB). Up to it they follow the tokens' count.
FILTER_BITS = 1 << 28
PROBES = 4
#: Bytes of text in one numpy pass.
SLICE = 2 << 20
#: Ids of documents that go or share an id are broadcast up to this number (about 64 MB).
BROADCAST_ROWS = 1_000_000
#: Brackets below this size index frequent tokens singly.
FEW = 20


@cache
def _brackets(percent: int) -> np.ndarray:
    """Lower bounds of size brackets; sets whose sizes allow a link are in the same or in neighbouring ones."""
    if not 20 <= percent <= 100:
        raise ValueError("percent must be 20 to 100")
    growth = max(100 / percent, 1.02)
    return growth ** np.arange(int(np.ceil(np.log(1e12) / np.log(growth))))


def _bucket_bits(spark) -> int:
    """Hash ranges follow the shuffle partitions, so a range's share of the tokens stays small at any input."""
    return power_of_two(max(16, 2 * shuffle_partitions(spark))).bit_length() - 1


def _pack40(h: np.ndarray) -> bytes:
    return np.ascontiguousarray(h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]).tobytes()


def _unpack40(raw: bytes) -> np.ndarray:
    b = np.frombuffer(raw, np.uint8).reshape(-1, 5)
    out = np.zeros((len(b), 8), np.uint8)
    out[:, :5] = b
    return out.reshape(-1).view("<u8").astype(U)


def _probe(low: np.ndarray, bits: int) -> np.ndarray:
    """Places of each 40-bit key in a block of ``bits`` bits: one row per probe."""
    h = textnp.mix(low + U(0x5851F42D4C957F2D))
    a, b = h & U(0xFFFFFFFF), (h >> U(32)) | U(1)
    return np.stack([(a + U(i) * b) % U(bits) for i in range(PROBES)]).astype(np.int64)


def _count_tokens(shingle: int, bucket_bits: int):
    """(bucket, ones, many, counts): packed tokens that occur once here, and those that occur more often with their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, limit=SLICE):
                w = textnp.words(*text_buffer(part.column("text")))
                sets = textnp.shingle_sets(w, shingle)
                h, n = np.unique(np.concatenate(sets) >> U(64 - bucket_bits - 40), return_counts=True)
                bucket = (h >> U(40)).astype(np.int32)
                found, first = np.unique(bucket, return_index=True)
                rows = []
                for b, x, y in zip(found.tolist(), first.tolist(), [*first[1:].tolist(), len(h)]):
                    low, c = h[x:y] & U((1 << 40) - 1), n[x:y]
                    one = c == 1
                    rows.append((b, _pack40(low[one]), _pack40(low[~one]), c[~one].astype("<u4").tobytes()))
                if rows:
                    b, ones, many, counts = zip(*rows)
                    yield pa.RecordBatch.from_arrays([pa.array(b, pa.int32()), *(pa.array(x, pa.binary()) for x in (ones, many, counts))], names=["bucket", "ones", "many", "counts"])

    return run


def _repeated(table: pa.Table) -> pa.Table:
    """One hash range's tokens in two documents or more: packed sorted keys and their document frequencies.

    Every row's keys are sorted, so the range is worked off in parts of its hashes, and only a part of it is unpacked at a time.
    """
    rows = [[np.frombuffer(x, np.uint8).reshape(-1, 5) for x in table.column(c).to_pylist()] for c in ("ones", "many")]
    counts = [np.frombuffer(x, "<u4") for x in table.column("counts").to_pylist()]
    parts = power_of_two(max(1, sum(len(x) for kind in rows for x in kind) // 500_000))
    heads = [[x[:, 4] for x in kind] for kind in rows]  # the keys' highest bytes
    keys, dfs = [], []
    for p in range(min(parts, 256)):
        low, high = p * 256 // min(parts, 256), (p + 1) * 256 // min(parts, 256)
        found, df = [], []
        for kind, head in zip(rows, heads):
            for i, (x, y) in enumerate(zip(kind, head)):
                a, b = np.searchsorted(y, low), np.searchsorted(y, high) if high < 256 else len(y)
                if a < b:
                    found.append(_unpack40(x[a:b].tobytes()))
                    df.append(np.ones(b - a, np.int64) if kind is rows[0] else counts[i][a:b].astype(np.int64))
        if not found:
            continue
        found, df = np.concatenate(found), np.concatenate(df)
        order = np.argsort(found, kind="stable")
        found, df = found[order], df[order]
        first = np.flatnonzero(np.concatenate([[True], found[1:] != found[:-1]]))
        df, found = np.add.reduceat(df, first), found[first]
        keys.append(_pack40(found[df > 1]))
        dfs.append(df[df > 1].astype("<u4").tobytes())
    return pa.table({"bucket": table.column("bucket")[:1], "keys": pa.array([b"".join(keys)], pa.binary()), "df": pa.array([b"".join(dfs)], pa.binary())})


def _filters(block_bits: int):
    """One hash range's filter blocks."""

    def block(low: np.ndarray) -> bytes:
        bits = np.zeros(block_bits, bool)
        for row in _probe(low, block_bits):
            bits[row] = True
        return np.packbits(bits, bitorder="little").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bucket, keys, df in zip(*(batch.column(c).to_pylist() for c in ("bucket", "keys", "df"))):
                keys, df, frequent = _unpack40(keys), np.frombuffer(df, "<u4"), 3
                while np.count_nonzero(df >= frequent) > block_bits // 8:
                    frequent = power_of_two(frequent + 1)
                yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([block(keys)], pa.binary()), pa.array([block(keys[df >= frequent])], pa.binary())], names=["bucket", "shared", "frequent"])

    return run


def _classes(h: np.ndarray, shared: np.ndarray, frequent: np.ndarray, bucket_bits: int, block_bits: int) -> np.ndarray:
    """0: in one document, 1: rare, 2: frequent."""
    key = h >> U(64 - bucket_bits - 40)
    at = _probe(key & U((1 << 40) - 1), block_bits) + ((key >> U(40)).astype(np.int64) * block_bits)[None, :]
    out = np.zeros(len(h), np.int8)
    alive = np.arange(len(h))
    for f in (shared, frequent):
        for row in at:
            p = row[alive]
            alive = alive[(f[p >> 3] >> (p & 7).astype(np.uint8)) & 1 == 1]
        out[alive] += 1
    return out


def signatures(tokens: np.ndarray, cls: np.ndarray, percent: int) -> np.ndarray:
    """Signatures of one sorted set with its tokens' classes; see the module."""
    n = len(tokens)
    need = n - -(-percent * n // 100) + 1 - int(np.count_nonzero(cls == 0))
    if need <= 0:
        return np.zeros(0, U)
    rare = tokens[cls == 1]
    if need <= len(rare):
        return rare[:need]
    out, frequent, need = [rare], tokens[cls == 2], need - len(rare)
    brackets = _brackets(percent)
    bracket = int(np.searchsorted(brackets, n, "right")) - 1
    for j in {bracket, max(bracket - 1, 0)}:
        tag = U((2 * j + 1) * 0x632BE59BD9B4E019 & (1 << 64) - 1)
        if brackets[j] < FEW:
            out.append(textnp.mix(frequent[:need] ^ tag))
            continue
        sub = (textnp.mix(frequent) % U(max(1, int(brackets[j] / 10)))).astype(np.int64)
        order = np.argsort(sub, kind="stable")
        begin = np.concatenate([[True], sub[order][1:] != sub[order][:-1]])
        at = np.arange(len(sub))
        rank = np.empty(len(sub), np.int64)
        rank[order] = at - np.maximum.accumulate(np.where(begin, at, 0))
        stop = int(np.searchsorted(np.cumsum(rank > 0), need)) + 1
        order = order[order < stop]
        t, s = frequent[order], sub[order]
        for d in range(1, len(t)):
            same = s[d:] == s[:-d]
            if not same.any():
                break
            a, b = t[:-d][same], t[d:][same]
            out.append(textnp.mix(textnp.mix(a ^ tag) * U(0xD1342543DE82EF95) + b))
    return np.concatenate(out)


def _digest(tokens: np.ndarray) -> list[int]:
    """128 bits of a set, as two longs."""
    return np.frombuffer(xxhash.xxh3_128_digest(tokens.tobytes()), np.int64).tolist()


def _sets(shingle: int, percent: int, shared, frequent, bucket_bits: int, block_bits: int):
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = textnp.shingle_sets(textnp.words(*text_buffer(batch.column("text"))), shingle)
        sizes = np.array([len(s) for s in sets], np.int64)
        cls = _classes(np.concatenate(sets), shared.value, frequent.value, bucket_bits, block_bits)
        at = np.concatenate([[0], np.cumsum(sizes)])
        h1, h2, sigs, packed, own = [], [], [], [], []
        for i, s in enumerate(sets):
            if not len(s):
                h1.append(None), h2.append(None), sigs.append(None), packed.append(None), own.append(0)
                continue
            d = _digest(s)
            found = signatures(s, cls[at[i] : at[i + 1]], percent)
            h1.append(d[0]), h2.append(d[1])
            sigs.append(found.view(np.int64) if len(found) else None)
            packed.append(s.tobytes() if len(found) else None)
            own.append(int(np.count_nonzero(cls[at[i] : at[i + 1]] == 0)))
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(sigs, pa.list_(pa.int64())), pa.array(packed, pa.binary()), pa.array(own, pa.int64())], names=["doc_id", "n", "h1", "h2", "sigs", "tokens", "own"])

    return over_texts(run, limit=SLICE)


def _verify(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, left, right = [], [], None, None
            for x, y, s, t in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), batch.column("s"), batch.column("t")):
                left, right = np.frombuffer(s.as_buffer(), U), np.frombuffer(t.as_buffer(), U)
                if len(left) > len(right):
                    left, right = right, left
                at = np.searchsorted(right, left)
                both = int(np.count_nonzero(right[np.minimum(at, len(right) - 1)] == left))
                if 100 * both >= percent * (len(left) + len(right) - both):
                    a.append(x), b.append(y)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def _near(percent: int):
    return (F.lit(100) * F.least("n_a", "n_b") >= F.lit(percent) * F.greatest("n_a", "n_b"))


def _compare_blocks(percent: int):
    """Over rows sorted by (g, side): each block of left sets against a block of right sets; links that span what is linked."""

    def links(rows: list) -> list[tuple[int, int]]:
        left, right = ([r for r in rows if r[0] == s] for s in (0, 1))
        if not left or not right:
            return []
        sets = [np.frombuffer(r[3], U) for r in (*left, *right)]
        sizes = np.array([len(x) for x in sets])
        a, b = sizes[: len(left), None], sizes[None, len(left) :]
        maybe = (100 * np.minimum(a, b) >= percent * np.maximum(a, b)) & (np.array([r[2] for r in left])[:, None] != np.array([r[2] for r in right])[None, :])
        if not maybe.any():
            return []
        flat, inverse, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        owner, both = np.repeat(np.arange(len(sets)), sizes), np.zeros(maybe.shape)
        shared = np.flatnonzero(count > 1)
        place = np.full(len(flat), -1)
        place[shared] = np.arange(len(shared))
        column = place[inverse]
        for at in range(0, len(shared), 1 << 15):  # a bounded number of tokens at a time
            now = np.flatnonzero((column >= at) & (column < at + (1 << 15)))
            m = np.zeros((len(sets), min(1 << 15, len(shared) - at)), np.float32)
            m[owner[now], column[now] - at] = 1
            both += m[: len(left)] @ m[len(left) :].T
        near = maybe & (100 * both >= percent * (a + b - both))
        parent: dict = {}

        def find(x):
            while parent.setdefault(x, x) != x:
                x = parent[x]
            return x

        out = []
        for i, j in zip(*np.nonzero(near)):
            x, y = find(left[i][2]), find(right[j][2])  # their components
            if x != y:
                parent[x] = y
                out.append((left[i][2], right[j][2]))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, rows, found = None, [], []
        for batch in batches:
            for g, side, doc, component, tokens in zip(*(batch.column(c).to_pylist() for c in ("g", "side", "doc_id", "component", "tokens"))):
                if g != last:
                    found += links(rows)
                    last, rows = g, []
                rows.append((side, doc, component, tokens))
        found += links(rows)
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64())], names=["a", "b"])

    return run


def jaccard_components(sets: DataFrame, scratch: Scratch, percent: int) -> DataFrame:
    """(node, component) of all sets with links; ``sets`` is a written table of distinct sets (doc_id, n, own, sigs, tokens)."""
    postings = sets.select("doc_id", "n", "own", F.explode("sigs").alias("sig")).distinct()
    sized = postings.groupBy("sig").agg(F.count("*").alias("m"), F.min(F.struct("own", "doc_id", "n")).alias("pivot")).where("m > 1")
    postings = scratch.stash(postings.join(sized, "sig").select("sig", "doc_id", "n", "m", F.col("pivot.doc_id").alias("pivot"), F.col("pivot.n").alias("n_pivot")), "postings")
    small, large = postings.where(F.col("m") <= SMALL), postings.where(F.col("m") > SMALL)
    side = lambda s: small.select("sig", F.col("doc_id").alias(s), F.col("n").alias(f"n_{s}"))
    pairs = side("a").join(side("b"), "sig").where("a < b").where(_near(percent)).select("a", "b")
    stars = large.where("doc_id <> pivot").select(F.col("doc_id").alias("a"), F.col("n").alias("n_a"), F.col("pivot").alias("b"), F.col("n_pivot").alias("n_b")).where(_near(percent)).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    packed = sets.select("doc_id", "tokens")
    candidates = pairs.union(stars).distinct()
    with_b = candidates.join(packed.select(F.col("doc_id").alias("b"), F.col("tokens").alias("t")), "b")
    both = with_b.join(packed.select(F.col("doc_id").alias("a"), F.col("tokens").alias("s")), "a")
    links = scratch.stash(both.select("a", "b", "s", "t").mapInArrow(tidy(_verify(percent)), "a long, b long"), "links")
    components = connected_components(links, scratch)
    scratch.drop(links)

    labelled = large.join(components.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("sig", "doc_id", "pivot", F.coalesce("component", "doc_id").alias("component"))
    unsettled = labelled.groupBy("sig").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("sig")
    rest = scratch.stash(labelled.join(unsettled, "sig", "left_semi").select("doc_id", "pivot", "component").distinct(), "rest")
    scratch.drop(postings)
    if rest.isEmpty():
        return components
    clusters = connected_components(rest.select(F.col("doc_id").alias("a"), F.col("pivot").alias("b")), scratch)
    members = rest.select("doc_id", "component").distinct().join(clusters.toDF("doc_id", "cluster"), "doc_id")
    sizes = members.groupBy("cluster", "component").agg(F.count("*").alias("n"))
    main = sizes.groupBy("cluster").agg(F.max(F.struct("n", "component")).alias("top")).select("cluster", F.col("top.component").alias("main"))
    bracket = F.floor(F.log(F.col("n").cast("double")) / float(np.log(max(100 / percent, 1.02))) + 1e-9).cast("int")  # neighbours as in _brackets
    members = members.join(sets.select("doc_id", bracket.alias("bracket")), "doc_id").join(main, "cluster")
    members = scratch.stash(members.select("cluster", "doc_id", "component", "bracket", (F.col("component") != F.col("main")).alias("other")), "members")
    others = members.where("other").select("cluster", "doc_id", "component", F.explode(F.array(*[F.col("bracket") + i for i in (-1, 0, 1)])).alias("bracket"))
    blocks = lambda df, name: df.groupBy("cluster", "bracket").agg(F.greatest(F.lit(1), F.ceil(F.count("*") / BLOCK)).cast("long").alias(name))
    grid = blocks(others, "xs").join(blocks(members, "ys"), ["cluster", "bracket"])
    cut = lambda n, salt: F.pmod(F.xxhash64("doc_id", F.lit(salt)), F.col(n))
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    left = others.join(grid, ["cluster", "bracket"]).select("cluster", "bracket", "doc_id", "component", cut("xs", 1).alias("x"), upto("ys").alias("y"), F.lit(0).alias("side"))
    right = members.join(grid, ["cluster", "bracket"]).select("cluster", "bracket", "doc_id", "component", upto("xs").alias("x"), cut("ys", 2).alias("y"), F.lit(1).alias("side"))
    rows = left.unionByName(right).select(F.xxhash64("cluster", "bracket", "x", "y").alias("g"), "side", "doc_id", "component").join(packed, "doc_id")
    more = rows.repartition("g").sortWithinPartitions("g", "side").select("g", "side", "doc_id", "component", "tokens").mapInArrow(tidy(_compare_blocks(percent)), "a long, b long")
    more = scratch.stash(more, "more")
    scratch.drop(members, rest, clusters)
    if more.isEmpty():
        return components
    joined = connected_components(more, scratch).toDF("component", "whole")  # over components
    relabelled = components.join(joined, "component", "left").select("node", F.coalesce("whole", "component").alias("component"))
    single = joined.join(components.select(F.col("node").alias("component")), "component", "left_anti").select(F.col("component").alias("node"), F.col("whole").alias("component"))
    whole = scratch.stash(relabelled.unionByName(single), "components")
    scratch.drop(more, components)
    return whole


def _linked_sets(documents: DataFrame, shingle: int, percent: int, scratch: Scratch, by_text: bool) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n, h1, h2) of every row, and (h1, h2, component) of every distinct set.

    A set's node is the smallest doc_id that has it, so that an id's sets count as one document; with ``by_text`` a number of its own.
    """
    spark = documents.sparkSession
    _brackets(percent)  # raises here rather than in a task
    source = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    bucket_bits = _bucket_bits(spark)
    counted = source.mapInArrow(tidy(_count_tokens(shingle, bucket_bits)), "bucket int, ones binary, many binary, counts binary")
    repeated = scratch.stash(counted.groupBy("bucket").applyInArrow(_repeated, "bucket int, keys binary, df binary"), "repeated")
    most = repeated.agg(F.max(F.length("df") / 4)).first()[0] or 0
    block_bits = min(FILTER_BITS >> bucket_bits, max(1 << 12, power_of_two(int(most) * 16)))
    both = np.zeros((2, (block_bits << bucket_bits) // 8), np.uint8)
    for row in repeated.mapInArrow(tidy(_filters(block_bits)), "bucket int, shared binary, frequent binary").toLocalIterator():  # FILTER_BITS bits twice at most
        for i, raw in enumerate((row.shared, row.frequent)):
            both[i, row.bucket * (block_bits // 8) : (row.bucket + 1) * (block_bits // 8)] = np.frombuffer(raw, np.uint8)
    scratch.drop(repeated)
    shared, frequent = (spark.sparkContext.broadcast(x) for x in both)
    sets = scratch.stash(source.mapInArrow(_sets(shingle, percent, shared, frequent, bucket_bits, block_bits), "doc_id long, n long, h1 long, h2 long, sigs array<long>, tokens binary, own long"), "sets")
    shared.destroy(), frequent.destroy()
    del both
    reps = sets.where("h1 is not null").groupBy("h1", "h2").agg(F.min("doc_id").alias("doc"))
    # the numbers hold once the table is written
    reps = scratch.stash(reps.withColumn("node", F.monotonically_increasing_id() if by_text else F.col("doc")), "reps")
    chosen = sets.where("sigs is not null").join(reps, ["h1", "h2"]).where("doc_id = doc").dropDuplicates(["doc_id", "h1", "h2"])
    chosen = scratch.stash(chosen.select(F.col("node").alias("doc_id"), "n", "sigs", "tokens", "own"), "chosen")
    ids = scratch.stash(sets.select("doc_id", "n", "h1", "h2"), "ids")
    scratch.drop(sets)
    components = jaccard_components(chosen, scratch, percent)
    scratch.drop(chosen)
    return ids, reps.join(components, "node", "left").select("h1", "h2", F.coalesce("component", "node").alias("component"))


def ngram_groups(documents: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (the smallest doc_id reachable by links)."""
    ids, labels = _linked_sets(documents, shingle, percent, Scratch(documents.sparkSession, "ngrams"), by_text=False)
    # a doc_id with several sets can be linked through each of them
    out = ids.join(labels, ["h1", "h2"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def one_of_each_group(documents: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """One row of each group of linked texts: of those with the smallest doc_id the one with the smallest set digest.

    Rows are told apart by doc_id and set, so rows that share a doc_id go only where their texts are linked or have equal sets; of rows
    that are alike in both, the one with the smallest hash of its columns stays. Rows without a doc_id, and texts without words, stay.
    """
    names = documents.columns
    id_, again_, h1, h2, x1, x2 = fresh(names, "id", "again", "h1", "h2", "x1", "x2")
    scratch = Scratch(documents.sparkSession, "groups")
    ids, labels = _linked_sets(documents, shingle, percent, scratch, by_text=True)
    labelled = ids.where("doc_id is not null").join(labels, ["h1", "h2"], "left").groupBy("doc_id", "h1", "h2").agg(F.first("component").alias("component"), F.count("*").alias("n"))
    labelled = scratch.stash(labelled, "labelled")
    first = labelled.where("h1 is not null").groupBy("component").agg(F.min(F.struct("doc_id", "h1", "h2")).alias("first"))
    stays = scratch.stash(first.select("first.*"), "stays")
    rows = labelled.join(stays.withColumn("stay", F.lit(1)), ["doc_id", "h1", "h2"], "left").groupBy("doc_id").agg(F.sum("n").alias("n"), F.max(F.col("stay").isNull() & F.col("h1").isNotNull()).alias("gone"))
    special = scratch.stash(rows.where("n > 1 or gone").select(F.col("doc_id").alias(id_), (F.col("n") > 1).alias(again_)), "special")
    small = special.count() <= BROADCAST_ROWS  # then no text is shuffled
    marked = documents.join(F.broadcast(special) if small else special, documents["doc_id"] == special[id_], "left")
    plain = marked.where(F.col(id_).isNull()).select(*names)
    if special.where(again_).isEmpty():
        return plain

    def digests(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [_digest(s) if len(s) else (None, None) for s in textnp.shingle_sets(textnp.words(*text_buffer(batch.column(text_at))), shingle)]
        return pa.RecordBatch.from_arrays([*batch.columns, *(pa.array([d[i] for d in found], pa.int64()) for i in (0, 1))], names=[*names, h1, h2])

    text_at, schema = names.index("text"), documents.schema
    again = marked.where(again_).select(*names).mapInArrow(over_texts(digests), StructType([*schema.fields, *(StructField(h, LongType()) for h in (h1, h2))]))
    wordless = again.where(F.col(h1).isNull()).select(*names)
    held = again.join(stays.toDF(id_, x1, x2), (F.col("doc_id") == F.col(id_)) & (F.col(h1) == F.col(x1)) & (F.col(h2) == F.col(x2)), "left_semi")
    hashed = [f.name for f in schema.fields if "map<" not in f.dataType.simpleString()]
    one = held.groupBy("doc_id", h1, h2).agg(F.min_by(F.struct(*names), F.xxhash64(*hashed)).alias(again_)).select(f"{again_}.*")
    return plain.unionByName(wordless).unionByName(one)
