"""Embedding near-duplicates by NN-descent: a neighbour graph refined through neighbours of neighbours.

1. Rows without a label or with an unusable vector link with nothing. Equal vectors of a label become one node with its number of copies.
2. First lists: trees of random hyperplanes (their depth follows the label's size) put near vectors into one leaf; leaves larger than
   ``BLOCK`` are cut at random, anew in each tree. A block's cosines are one matrix product; each node keeps its ``K`` best.
3. Refinement (Dong et al., 2011): around each node its neighbours, and those that name it (sampled where they are many), are compared
   with each other; lists take in what is better. Rounds end when few lists change.
4. Ties: every block of 2 and 3 also sends a spanning forest of its own links >= threshold, which no list's length cuts, so that what a
   block has seen linked is in one component, however full the lists are.
5. A list is saturated when all its ``K`` are over the threshold, so more may be. The components of lists and ties that hold a saturated
   node have their lists enlarged to the component, in blocks against blocks: each node counts its links there, no pairs are sent.
6. Audit: the nodes that hold a vec_id divisible by 50 are compared with all nodes of their label, in blocks, and their links counted at last
   (after 5) with those. While the share found of a label is below ``TARGET``, more trees and rounds follow, at most ``MORE`` times;
   labels still below it are counted whole, all blocks against all.

Every cosine is of double precision. Links found have cosine >= threshold; recall is what the audit says (see ``_audit``).

Defined cases: null vectors, zero vectors, vectors with null or non-finite parts, and rows with a null label get 0 links and are their
own component. Vectors of different lengths don't link. Rows that share a vec_id are different vectors under one name: nodes are known
by label and vector, never by vec_id, a row's links count rows, and its component's id is the smallest vec_id that its own vector
reaches. A row with a null vec_id has its component's id too (null without one), and is not kept. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from embedlens.llm.components import connected_components
from embedlens.llm.shared import Scratch, tidy

K = 12
TREES = 6
LEAF = 128
BLOCK = 384
ROUNDS = 2
TARGET, MORE = 0.95, 2
LINKS = "u long, v long, sim double, tie boolean"


def _usable(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds a 128-bit key and the double-precision unit vector (null: links with nothing)."""
    for batch in batches:
        n, column = batch.num_rows, batch.column("embedding")
        keys, units = [None] * n, [None] * n
        size = pa.compute.fill_null(column.value_lengths(), 0).to_numpy()
        flat = pa.compute.fill_null(column.flatten(), float("nan")).to_numpy()
        first, labelled = np.cumsum(size) - size, np.asarray(batch.column("label").is_valid())
        for d in np.unique(size[size > 0]):
            mine = np.flatnonzero((size == d) & labelled)
            x = flat[first[mine][:, None] + np.arange(d)[None, :]]
            top = np.abs(x).max(1, initial=0)
            good = np.isfinite(x).all(1) & (top > 0)
            mine, x, top = mine[good], x[good], top[good]
            with np.errstate(over="ignore"):
                square = (x * x).sum(1)
            odd = (square == 0) | ~np.isfinite(square)  # squares out of range
            x[odd] /= top[odd][:, None]
            norm = np.sqrt((x * x).sum(1))
            for i, row, u in zip(mine.tolist(), x, x / norm[:, None]):
                keys[i], units[i] = xxhash.xxh3_128_digest(row.tobytes()), u.tobytes()
        yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(keys, pa.binary()), pa.array(units, pa.binary())], names=["vec_id", "label", "key", "unit"])


def _matrix(col: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), np.float64).reshape(len(col), -1)


def _groups(f, out_names: list[str]):
    """mapInArrow over rows sorted by ``g``: calls ``f`` with each group's rows, and sends on its columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last, out, size = None, [], 0

        def flush() -> None:
            nonlocal held, size
            if held:
                found = f(pa.Table.from_batches(held).combine_chunks())
                if found is not None and len(found[0]):
                    out.append(found)
                    size += len(found[0])
                held = []

        def send() -> pa.RecordBatch:
            nonlocal out, size
            columns = [np.concatenate(x) for x in zip(*out)]
            out, size = [], 0
            return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=out_names)

        for batch in batches:
            if not batch.num_rows:
                continue
            g = batch.column("g").to_numpy()
            cut = np.concatenate([[0], np.flatnonzero(g[1:] != g[:-1]) + 1, [len(g)]])
            for a, b in zip(cut[:-1].tolist(), cut[1:].tolist()):
                if g[a] != last:
                    flush()
                    last = g[a]
                held.append(batch.slice(a, b - a))
                if size > 100_000:
                    yield send()
        flush()
        if out:
            yield send()

    return run


def _forest(near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(child, parent) of a spanning forest of a symmetric boolean matrix."""
    child, parent = [], []
    left = near.any(1)
    while left.any():
        front = np.array([left.argmax()])
        left[front] = False
        while len(front):
            reached = near[front] & left
            new = np.flatnonzero(reached.any(0))
            child.append(new)
            parent.append(front[reached[:, new].argmax(0)])
            left[new] = False
            front = new
    return (np.concatenate(child), np.concatenate(parent)) if child else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _best(table: pa.Table, keep: int, threshold: float):
    """Each node's best ``keep`` others within a group, and the group's ties."""
    ids = table.column("id").to_numpy()
    if len(ids) < 2:
        return None
    x = _matrix(table.column("unit").combine_chunks() if isinstance(table.column("unit"), pa.ChunkedArray) else table.column("unit"))
    s = x @ x.T
    np.fill_diagonal(s, -2)
    s[ids[:, None] == ids[None, :]] = -2
    k = min(keep, len(ids) - 1)
    at = np.argpartition(-s, k - 1, axis=1)[:, :k]
    u, sim = np.repeat(ids, k), np.take_along_axis(s, at, 1).reshape(-1)
    v = ids[at].reshape(-1)
    good = sim > -2
    near = s >= threshold
    child, parent = _forest(near | near.T)
    tie = np.repeat([False, True], [int(good.sum()), len(child)])
    return np.concatenate([u[good], ids[child]]), np.concatenate([v[good], ids[parent]]), np.concatenate([sim[good], np.maximum(s[child, parent], s[parent, child])]), tie


def _grouped(rows: DataFrame, f, names: list[str], schema: str) -> DataFrame:
    """``rows`` has (g, id, unit, ...); groups are bounded by construction."""
    return rows.repartition("g").sortWithinPartitions("g", "id").mapInArrow(tidy(_groups(f, names)), schema)


def _top(links: DataFrame, keep: int) -> DataFrame:
    """Best ``keep`` of each u, and its ties beyond them, as arrays: (u, best and ties array<struct<far, v, tie>>)."""
    found = links.groupBy("u", "v").agg(F.max("sim").alias("sim"), F.max("tie").alias("tie"))
    found = found.groupBy("u").agg(F.array_sort(F.collect_list(F.struct((-F.col("sim")).alias("far"), "v", "tie"))).alias("all"))
    return found.select("u", F.slice("all", 1, keep).alias("best"), F.filter("all", lambda x, i: (i >= keep) & x["tie"]).alias("ties"))


def _flat(lists: DataFrame, ties: bool = False) -> DataFrame:
    return lists.select("u", F.explode(F.concat("best", "ties") if ties else F.col("best")).alias("b")).select("u", F.col("b.v").alias("v"), (-F.col("b.far")).alias("sim"), F.col("b.tie").alias("tie"))


def _leaves(nodes: DataFrame, sizes: DataFrame, trees: range) -> DataFrame:
    """(g, id, unit): g is a tree's leaf, cut into blocks where it is large."""

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            raw, n = batch.column("unit").to_pylist(), batch.column("n").to_numpy()
            depth = np.ceil(np.log2(np.maximum(n / LEAF, 1))).astype(np.int64)
            width = np.array([len(r) // 8 for r in raw])
            for t in trees:
                code = np.zeros(len(raw), np.int64)
                for d in np.unique(width):
                    mine = np.flatnonzero(width == d)
                    planes = np.random.default_rng([t, int(d)]).standard_normal((int(d), 40))
                    x = np.frombuffer(b"".join([raw[i] for i in mine]), np.float64).reshape(len(mine), -1)
                    bits = (x @ planes > 0).astype(np.int64)
                    use = np.arange(40)[None, :] < depth[mine][:, None]
                    code[mine] = ((bits * use) << np.arange(40)[None, :]).sum(1)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(raw), t, np.int32)), batch.column("space"), pa.array(code), batch.column("id")], names=["tree", "space", "code", "id"])

    coded = nodes.join(sizes, "space").select("space", "id", "unit", "n").mapInArrow(codes, "tree int, space long, code long, id long")
    leaf = coded.groupBy("tree", "space", "code").agg(F.count("*").alias("size"))
    cut = coded.join(leaf, ["tree", "space", "code"]).select("id", F.xxhash64("tree", "space", "code", F.pmod(F.xxhash64("id", "tree"), F.ceil(F.col("size") / BLOCK))).alias("g"))
    return cut.join(nodes.select("id", "unit"), "id").select("g", "id", "unit")


def _refine(lists: DataFrame, nodes: DataFrame, keep: int, turn: int, threshold: float) -> DataFrame:
    """Links found around each node among its neighbours and a sample of those that name it."""
    forward = _flat(lists).select(F.col("u").alias("g"), F.col("v").alias("id"))
    named = forward.groupBy(F.col("id").alias("name")).agg(F.count("*").alias("n"))
    back = forward.join(named, F.col("id") == F.col("name")).where(F.pmod(F.xxhash64("g", "id", F.lit(turn)), F.col("n")) < keep).select(F.col("id").alias("g"), F.col("g").alias("id"))
    around = forward.union(back).union(lists.select(F.col("u").alias("g"), F.col("u").alias("id"))).distinct()
    # in the mean 2 * keep + 1 rows a group; what a sample gives beyond that is small
    rows = around.join(nodes.select("id", "unit"), "id").select("g", "id", "unit")
    return _grouped(rows, lambda t: _best(t, 4, threshold), ["u", "v", "sim", "tie"], LINKS)


def _blocks(left: DataFrame, right: DataFrame, threshold: float, ties: bool = False) -> DataFrame:
    """left(part, id, unit, w), right(part, id, unit, w) in blocks of a part: (id, rows, nodes) linked to each left row; with ``ties``
    also ``other``: its row is a link of a block's spanning forest where that is another node's id, and has no counts.

    Right rows are dealt to blocks; each left block meets each right block of its part in one group.
    """
    block = lambda df, n: df.withColumn("block", F.pmod(F.xxhash64("id", F.lit(n)), F.greatest(F.lit(1), F.ceil(F.col("size") / 2048))).cast("long"))
    size = lambda df: df.join(df.groupBy("part").agg(F.count("*").alias("size")), "part")
    a, b = block(size(left), 1), block(size(right), 2)
    blocks_b = b.groupBy("part").agg(F.max("block").alias("last_b"))
    blocks_a = a.groupBy("part").agg(F.max("block").alias("last_a"))
    a = a.join(blocks_b, "part").select("part", "id", "unit", "w", F.col("block").alias("x"), F.explode(F.sequence(F.lit(0), F.col("last_b"))).alias("y"), F.lit(0).alias("side"))
    b = b.join(blocks_a, "part").select("part", "id", "unit", "w", F.explode(F.sequence(F.lit(0), F.col("last_a"))).alias("x"), F.col("block").alias("y"), F.lit(1).alias("side"))
    both = a.unionByName(b).select(F.xxhash64("part", "x", "y").alias("g"), "id", "unit", "w", "side")

    def compare(t: pa.Table):
        ids, w, side = (t.column(c).to_numpy() for c in ("id", "w", "side"))
        if (side == 0).all() or (side == 1).all():
            return None
        x = _matrix(t.column("unit").combine_chunks())
        near = (x[side == 0] @ x[side == 1].T) >= threshold
        near &= ids[side == 0][:, None] != ids[side == 1][None, :]
        a, b = ids[side == 0], ids[side == 1]
        counts = near.astype(np.int64) @ w[side == 1], near.sum(1)
        if not ties:
            return a, *counts
        whole = np.zeros((len(ids), len(ids)), bool)
        whole[: len(a), len(a) :], whole[len(a) :, : len(a)] = near, near.T
        child, parent = _forest(whole)
        sides, none = np.concatenate([a, b]), np.zeros(len(child), np.int64)
        return np.concatenate([a, sides[child]]), np.concatenate([counts[0], none]), np.concatenate([counts[1], none]), np.concatenate([a, sides[parent]])

    names = ["id", "rows", "nodes", *["other"][: int(ties)]]
    return _grouped(both, compare, names, ", ".join(f"{c} long" for c in names))


def _descended(lists: DataFrame | None, nodes: DataFrame, sizes: DataFrame, scratch: Scratch, threshold: float, keep: int, trees: range, rounds: int = ROUNDS) -> DataFrame:
    """Lists of NN-descent out of the given trees and the lists before."""
    first = _grouped(_leaves(nodes, sizes, trees), lambda t: _best(t, keep, threshold), ["u", "v", "sim", "tie"], LINKS)
    lists = scratch.stash(_top(first if lists is None else first.union(_flat(lists, ties=True)), keep), "lists")
    state = F.sum(F.xxhash64("u", F.transform("best", lambda b: b["v"])).cast("decimal(38,0)"))
    before = lists.agg(state).first()[0]
    for turn in range(rounds):
        lists, old = scratch.stash(_top(_flat(lists, ties=True).union(_refine(lists, nodes, keep, turn, threshold)), keep), "lists"), lists
        scratch.drop(old)
        after = lists.agg(state).first()[0]
        if after == before:
            break
        before = after
    return lists


def _counted(lists: DataFrame, nodes: DataFrame, scratch: Scratch, threshold: float, keep: int) -> tuple[DataFrame, DataFrame]:
    """Links of each node (id, links: rows, nodes), and (node, component)."""
    links = scratch.stash(_flat(lists, ties=True).where(F.col("sim") >= threshold).select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).distinct(), "links")
    components = connected_components(links, scratch)
    full = lists.where((F.size("best") >= keep) & (-F.element_at("best", -1)["far"] >= threshold)).select(F.col("u").alias("node"))
    dense = components.join(full, "node", "left_semi").select("component").distinct()
    members = components.join(dense, "component", "left_semi").join(nodes.withColumnRenamed("id", "node"), "node")
    members = scratch.stash(members.select(F.col("component").alias("part"), F.col("node").alias("id"), "unit", F.col("copies").alias("w")), "members")
    enlarged = _blocks(members, members, threshold).groupBy("id").agg(F.sum("rows").alias("links"), F.sum("nodes").alias("others"))
    both = links.select(F.col("a").alias("id"), F.col("b").alias("other")).union(links.select("b", "a"))
    sparse = both.join(members.select("id"), "id", "left_anti").join(nodes.select(F.col("id").alias("other"), "copies"), "other").groupBy("id").agg(F.sum("copies").alias("links"), F.count("*").alias("others"))
    counts = scratch.stash(sparse.union(enlarged), "counts")
    scratch.drop(links, members)
    return counts, components


def _audit(counts: DataFrame, true: DataFrame) -> list:
    """(label, found, all): links counted, and all there are, of the queries in ``true``."""
    both = true.join(counts.select("id", "others"), "id", "left")
    return both.groupBy("label").agg(F.sum(F.least(F.coalesce("others", F.lit(0)), "true")).alias("found"), F.sum("true").alias("all")).collect()  # a row a label


def link_counts(nodes: DataFrame, scratch: Scratch, threshold: float, keep: int = K, trees: int = TREES, report: dict | None = None) -> tuple[DataFrame, DataFrame]:
    """Links of each node and the components, audited; ``nodes`` has (space, id, unit, copies, label, asked)."""
    sizes = nodes.groupBy("space").agg(F.count("*").alias("n"))
    all_rows = nodes.select(F.col("space").alias("part"), "id", "unit", F.col("copies").alias("w"))
    asked = nodes.where("asked").select(F.col("space").alias("part"), "id", "unit", F.col("copies").alias("w"))
    true = _blocks(asked, all_rows, threshold).groupBy("id").agg(F.sum("nodes").alias("true"))
    true = scratch.stash(true.join(nodes.select("id", "label"), "id"), "true")
    lists = None
    for attempt in range(1 + MORE):
        lists = _descended(lists, nodes, sizes, scratch, threshold, keep, range(attempt * trees, (attempt + 1) * trees))
        counts, components = _counted(lists, nodes, scratch, threshold, keep)
        audited = _audit(counts, true)
        short = [r["label"] for r in audited if r["found"] < TARGET * r["all"]]
        if not short:
            break
    if short:
        mine = nodes.join(F.broadcast(nodes.sparkSession.createDataFrame([(x,) for x in short], "label long")), "label", "left_semi")
        mine = mine.select(F.col("space").alias("part"), "id", "unit", F.col("copies").alias("w"))
        blocks = scratch.stash(_blocks(mine, mine, threshold, ties=True), "exact")
        exact = blocks.groupBy("id").agg(F.sum("rows").alias("links"), F.sum("nodes").alias("others"))
        counts = scratch.stash(counts.join(mine.select("id"), "id", "left_anti").union(exact), "counts")
        links = blocks.where("other <> id").select(F.col("id").alias("a"), F.col("other").alias("b"))
        components = connected_components(links.union(components.select("node", "component")), scratch)
        audited = _audit(counts, true)
    if report is not None:
        report["found"], report["all"], report["exact_labels"] = sum(r["found"] for r in audited), sum(r["all"] for r in audited), len(short)
    return counts, components


def embedding_groups(embeddings: DataFrame, threshold: float = 0.98, keep: int = K, report: dict | None = None) -> DataFrame:
    """vec_id, n_links, component_id, kept. ``report`` gets the audit's counts."""
    spark = embeddings.sparkSession
    scratch = Scratch(spark, "vectors")
    source = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows = scratch.stash(source.mapInArrow(tidy(_usable), "vec_id long, label long, key binary, unit binary"), "rows")
    nodes = rows.where("key is not null").groupBy("label", "key").agg(F.count("*").alias("copies"), F.min("vec_id").alias("least"), F.bool_or(F.coalesce(F.col("vec_id") % 50 == 0, F.lit(False))).alias("asked"), F.first("unit").alias("unit"))
    nodes = scratch.stash(nodes.select(F.xxhash64("label", F.length("unit")).alias("space"), F.xxhash64("label", "key").alias("id"), "unit", "copies", "label", "key", "least", "asked"), "nodes")
    counts, components = link_counts(nodes, scratch, threshold, keep, report=report)
    counted = nodes.select("label", "key", "id", "copies", "least").join(counts.select("id", "links"), "id", "left").join(components.withColumnRenamed("node", "id"), "id", "left")
    counted = scratch.stash(counted.select("label", "key", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "id").alias("component"), "least"), "counted")
    names = counted.groupBy("component").agg(F.min("least").alias("component_id"))
    found = counted.join(names, "component").select("label", "key", "n_links", "component_id", F.lit(True).alias("linkable"))
    out = rows.select("vec_id", "label", "key").join(found, ["label", "key"], "left")
    component = F.when(F.col("linkable"), F.col("component_id")).otherwise(F.col("vec_id"))
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
