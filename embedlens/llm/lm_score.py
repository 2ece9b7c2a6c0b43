"""Language-model scoring: a log-bilinear model trained with noise-contrastive estimation in numpy.

1. Words are known by 64-bit hash. Tasks merge their counts of the training documents' words, Spark sums them.
2. Every counted word is in a class with vectors: about ``8 * V**(1/3)`` most frequent words in one of their own, all others in the class
   of their ending (hash of the last three bytes), of which there are as many; the end of a text is one more, and unseen words, which
   count once as in the base score, are the last. Classes thus grow with the vocabulary, and the context of rare words is learnt through
   their endings; as a context, an unseen word is of its ending's class too.
3. The prediction for a place is C1 q(w-1) + C2 q(w-2); a class's score is its product with the class's target vector, plus a bias (Mnih
   and Hinton, 2007). In every round each task starts from the same parameters and passes over its slices' distinct (context, target)
   triples, weighted by their counts, in mini-batches with shared noise. The tasks' parameters are averaged by their tokens, in shards and
   in levels of ``FAN`` tasks, so no group grows with the input. Biases start at the classes' log shares, which is the base score.
4. With two context words the score is a sum of two matrix products, A1[w-1] + A2[w-2] + b, and its normaliser over all contexts is one
   more product, exp(A1 + b) exp(A2)^T: probabilities of classes are normalised exactly. A word has its class's probability times its
   smoothed share (c + 0.1) of the class.

Counts of at most ``HOT_WORDS`` most frequent words are broadcast; where there are more, the rarer words of a document are joined to
theirs.

Defined cases: null or empty text is one end token. Null doc_id counts as the empty text in the fold rule. Each row is scored by itself,
also where doc_ids repeat. Without training documents N and V are 0, and all scores are 0 (one type has all the mass). An empty table
gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from embedlens.llm import textnp
from embedlens.llm.shared import Scratch, doc_crc, remembered, slices, text_buffer, tidy

U = np.uint64
DIM = 48
HOT_WORDS = 1 << 20
ROUNDS = 2
BATCH, NOISE, RATE = 4096, 128, 0.15
#: Bytes of text of which a task takes the distinct triples at a time.
SLICE = 2 << 20
#: Tasks that are averaged at once, and pieces that parameters are averaged in.
FAN, SHARDS = 16, 8


def _words(part: pa.RecordBatch) -> tuple[textnp.Words, np.ndarray]:
    """The words, and for each the 31-bit hash of its ending."""
    data, offsets = text_buffer(part.column("text"))
    w = textnp.words(data, offsets)
    return w, (textnp.span_hash(textnp._LOWER[data], np.maximum(w.start, w.end - 3), w.end) >> U(33)).astype(np.int32)


def _word_counts(batches: Iterator[pa.RecordBatch], limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """(h, ending, c): a task's counts, sent whenever there are more than ``limit`` distinct words."""
    held: list = []

    def merged() -> int:
        h, e, n = (np.concatenate(x) for x in zip(*held))
        keys, first, place = np.unique(h, return_index=True, return_inverse=True)
        held[:] = [(keys, e[first], np.bincount(place, n).astype(np.int64))]
        return len(keys)

    def send() -> Iterator[pa.RecordBatch]:
        if held:
            merged()
            h, e, n = held.pop()
            for a in range(0, len(h), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(x[a : a + 100_000]) for x in (h.view(np.int64), e, n)], names=["h", "ending", "c"])

    size = 0
    for batch in batches:
        for part in slices(batch):
            w, ending = _words(part)
            keys, first, n = np.unique(w.hash, return_index=True, return_counts=True)
            held.append((keys, ending[first], n))
            size += len(keys)
            if size > limit:
                size = merged()
                if size > limit // 2:
                    yield from send()
                    size = 0
    yield from send()


class Vocabulary:
    """Broadcast part of the counts: sorted hashes with counts and classes; N, V; masses of classes.

    Classes are the words of their own, the endings, the end, unseen words. ``complete``: words that are not among the hashes are unseen.
    """

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, own: np.ndarray, own_endings: np.ndarray, endings: int, ending_mass: np.ndarray, ending_words: np.ndarray, docs: int, complete: bool):
        order = np.argsort(hashes)
        self.hashes, self.counts, self.complete, self.docs = hashes[order], counts[order], complete, docs
        self.own, self.endings = len(own), endings
        self.size = len(own) + endings + 2
        self.end, self.unseen = self.size - 2, self.size - 1
        self.n, self.v = int(ending_mass.sum()) + docs, int(ending_words.sum()) + (docs > 0)
        self.cls = np.full(len(hashes), -1, np.int32)
        at = np.searchsorted(self.hashes, own)
        self.cls[at] = np.arange(len(own))
        mass = ending_mass - np.bincount(own_endings, self.counts[at], endings) if len(own) else ending_mass
        kinds = ending_words - np.bincount(own_endings, minlength=endings)
        tail = mass + 0.1 * kinds
        self.mass = np.concatenate([self.counts[at] + 0.1, tail, [docs + 0.1 * (docs > 0)], [0.1]])
        self.log_mass = np.log10(np.maximum(tail, 1e-300))
        self.z = self.n + 0.1 * (self.v + 1)

    def look(self, h: np.ndarray, ending: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Classes and counts; count -1 where the word is not among the broadcast ones, if they are not all."""
        tail = self.own + (ending % self.endings).astype(np.int32)
        if not len(self.hashes):
            return tail, np.full(len(h), 0 if self.complete else -1)
        keys, inverse = np.unique(h, return_inverse=True)
        at = np.minimum(np.searchsorted(self.hashes, keys), len(self.hashes) - 1)
        hit = self.hashes[at] == keys
        cls = np.where(hit, self.cls[at], -1)[inverse]
        return np.where(cls < 0, tail, cls), np.where(hit, self.counts[at], 0 if self.complete else -1)[inverse]


def tokens(part: pa.RecordBatch, vocabulary: Vocabulary):
    """Of a slice: hashes with an end (0) after each text, classes, counts, and the first token of each text."""
    w, ending = _words(part)
    n = len(w.first) - 1
    cls, count = vocabulary.look(w.hash, ending)
    at = np.arange(len(w.hash)) + w.doc()
    total = len(w.hash) + n
    h, c, k = np.zeros(total, U), np.full(total, vocabulary.end, np.int64), np.full(total, vocabulary.docs, np.int64)
    h[at], c[at], k[at] = w.hash, cls, count
    return h, c, k, w.first + np.arange(n + 1)


def contexts(c: np.ndarray, first: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Classes of the two tokens before each; before a text stand ends."""
    one = np.concatenate([[end], c[:-1]])
    two = np.concatenate([[end] * 2, c[:-2]])[: len(c)]
    starts = first[:-1]
    one[starts] = end
    two[starts] = end
    second = starts + 1
    two[second[second < first[1:]]] = end
    return one, two


class LogBilinear:
    """``q1``, ``q2``: context vectors with their matrices C1, C2 multiplied in; ``r``: targets; ``b``: biases; one row for each class."""

    def __init__(self, mass: np.ndarray, seed: int = 11):
        rng, self.size = np.random.default_rng(seed), len(mass)
        self.p = [(rng.standard_normal((self.size, DIM)) * s).astype(np.float32) for s in (0.01, 0.01, 0.1)]
        self.share = np.maximum(mass, 1e-6) / np.maximum(mass, 1e-6).sum()
        self.p.append(np.log(self.share).astype(np.float32))

    @property
    def parameters(self) -> np.ndarray:
        return np.concatenate([x.reshape(-1) for x in self.p])

    @parameters.setter
    def parameters(self, flat: np.ndarray) -> None:
        at = 0
        for i, x in enumerate(self.p):
            self.p[i] = flat[at : at + x.size].reshape(x.shape).astype(np.float32)
            at += x.size

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A1 + b, A2 (natural logs), and log normalisers of all contexts."""
        q1, q2, r, b = self.p
        a1, a2 = q1 @ r.T + b, q2 @ r.T
        m2, z = a2.max(1, keepdims=True), np.empty((self.size, self.size), np.float32)
        e2 = np.exp(a2 - m2).T
        for i in range(0, self.size, 256):
            some = a1[i : i + 256]
            m1 = some.max(1, keepdims=True)
            z[i : i + 256] = np.log(np.exp(some - m1) @ e2) + m1 + m2.T
        return a1, a2, z

    def train(self, code: np.ndarray, weight: np.ndarray, state: list, rng) -> None:
        """One pass over (w-2, w-1, w) triples, packed base ``size``, with their counts; AdaGrad steps. Large results of a batch go into the
        same memory for all batches."""
        q1, q2, r, b = self.p
        cumulative, k = np.cumsum(self.share), self.size
        log_noise = np.log(NOISE * self.share).astype(np.float32)
        order = rng.permutation(len(code))
        for a in range(0, len(order), BATCH):
            order[a : a + BATCH].sort()  # so w-2 are sorted
        code, weight = code[order], weight[order].astype(np.float32)
        pairs = code // k
        all_w, all_c2 = code - pairs * k, pairs // k
        all_c1 = pairs - all_c2 * k
        most = min(BATCH, len(code))
        room = [np.empty((most + more, width), np.float32) for more, width in ((0, DIM + 1), (0, DIM), (0, DIM), (NOISE, DIM), (NOISE, DIM), (0, NOISE))]
        rn = np.empty((NOISE, DIM + 1), np.float32)  # with the biases, which meet a 1 in the context
        for a in range(0, len(code), BATCH):
            w, c1, c2, m = (x[a : a + BATCH] for x in (all_w, all_c1, all_c2, weight))
            n = len(w)
            context, rw, g, gr, held, t = (x[: n + more] for x, more in zip(room, (0, 0, 0, NOISE, NOISE, 0)))
            noise = np.minimum(np.searchsorted(cumulative, rng.random(NOISE) * cumulative[-1]), k - 1)
            np.add(_taken(q1, c1, rw), _taken(q2, c2, g), out=context[:, :DIM])
            context[:, DIM] = 1
            _taken(r, w, rw)
            rn[:, :DIM], rn[:, DIM] = r[noise], b[noise] - log_noise[noise]
            with np.errstate(over="ignore"):  # then the share is 0
                gs = m / (1 + np.exp(np.einsum("ij,ij->i", context[:, :DIM], rw) + (b[w] - log_noise[w])))  # weight * (1 - sigmoid)
                np.exp(np.matmul(context, -rn.T, out=t), out=t)
            t += 1
            np.divide(-m[:, None], t, out=t)
            np.matmul(t, rn[:, :DIM], out=g)
            g_noise = t.T @ context
            rw *= gs[:, None]
            g += rw
            np.multiply(context[:, :DIM], gs[:, None], out=gr[:n])
            gr[n:] = g_noise[:, :DIM]
            scale = np.float32(1 / m.sum())
            for c, x, q, h in ((c1, g, q1, state[0]), (c2, g, q2, state[1]), (np.concatenate([w, noise]), gr, r, state[2])):
                rows, x = _summed(c, x, k, held[: len(c)])  # only rows that the batch touches
                x *= scale
                square = x * x
                square += h[rows]
                h[rows] = square
                square += np.float32(1e-8)
                np.sqrt(square, out=square)
                x *= np.float32(RATE)
                x /= square
                x += q[rows]
                q[rows] = x
            g_b = (np.bincount(w, gs, k) + np.bincount(noise, g_noise[:, DIM], k)).astype(np.float32) * scale
            state[3] += g_b * g_b
            b += 0.2 * RATE * g_b / np.sqrt(state[3] + 1e-8)


def _taken(x: np.ndarray, at: np.ndarray, out: np.ndarray) -> np.ndarray:
    """Rows of ``x``; ``at`` is inside its bounds."""
    return np.take(x, at, axis=0, out=out, mode="clip")


def _summed(at: np.ndarray, g: np.ndarray, k: int, room: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values of ``at``, all below ``k``, and for each the sum of its rows of ``g``; ``room`` has the shape of ``g``."""
    keys = at
    if (at[1:] < at[:-1]).any():
        order = np.argsort(at.astype(np.uint16) if k <= 1 << 16 else at, kind="stable")  # 16 bits are sorted by radix
        keys, g = at[order], _taken(g, order, room)
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(g.view(np.complex64), first, axis=0).view(np.float32)  # two columns at once


def _mean(table: pa.Table) -> pa.Table:
    """One shard of a group's parameters, weighted."""
    weight, total = table.column("weight").to_numpy(), 0.0
    for w, p in zip(weight, table.column("parameters")):
        total = total + w * np.frombuffer(p.as_buffer(), np.float32).astype(np.float64)
    return pa.table({"part": table.column("group")[:1], "shard": table.column("shard")[:1], "weight": [float(weight.sum())], "parameters": pa.array([(total / weight.sum()).astype(np.float32).tobytes()], pa.binary())})


def averaged(parts: DataFrame, fan: int = FAN) -> DataFrame:
    """(part, shard, weight, parameters) of all parts, down to one part: ``fan`` parts a level."""
    top = parts.agg(F.max("part")).first()[0] or 0
    while top > 0:
        parts = parts.withColumn("group", F.floor(F.col("part") / fan).cast("int")).groupBy("group", "shard").applyInArrow(_mean, "part int, shard int, weight double, parameters binary")
        top //= fan
    return parts


def fit(source: DataFrame, vocabulary: Vocabulary, broadcast, scratch: Scratch, rounds: int) -> LogBilinear:
    """The model of the rows of ``source(text)``. Its tokens' classes are written once, for all rounds."""
    model, spark = LogBilinear(vocabulary.mass), source.sparkSession
    kind = np.uint16 if vocabulary.size <= 1 << 16 else np.int32

    def classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, limit=SLICE):
                _, c, _, first = tokens(part, broadcast.value)
                yield pa.RecordBatch.from_arrays([pa.array([c.astype(kind).tobytes()], pa.binary()), pa.array([first.astype(np.int64).tobytes()], pa.binary())], names=["c", "first"])

    coded = scratch.stash(source.mapInArrow(tidy(classes), "c binary, first binary"), "classes")
    for turn in range(rounds):
        start = spark.sparkContext.broadcast(model.parameters)

        def task(batches: Iterator[pa.RecordBatch], turn=turn, start=start) -> Iterator[pa.RecordBatch]:
            part_no, v = TaskContext.get().partitionId(), broadcast.value
            mine = LogBilinear(v.mass)
            mine.parameters = start.value
            state = [np.zeros_like(x) for x in mine.p]
            rng, seen = np.random.default_rng([turn, part_no]), 0
            for batch in batches:
                for c, first in zip(*(batch.column(x) for x in ("c", "first"))):
                    c, first = np.frombuffer(c.as_buffer(), kind).astype(np.int64), np.frombuffer(first.as_buffer(), np.int64)
                    one, two = contexts(c, first, v.end)
                    code, weight = np.unique((two * v.size + one) * v.size + c, return_counts=True)
                    mine.train(code, weight, state, rng)
                    seen += len(c)
            if seen:
                shards = np.array_split(mine.parameters.astype(np.float32), SHARDS)
                yield pa.RecordBatch.from_arrays([pa.array([part_no] * SHARDS, pa.int32()), pa.array(range(SHARDS), pa.int32()), pa.array([float(seen)] * SHARDS), pa.array([x.tobytes() for x in shards], pa.binary())], names=["part", "shard", "weight", "parameters"])

        parts = scratch.stash(coded.mapInArrow(tidy(task), "part int, shard int, weight double, parameters binary"), "parameters")
        start.destroy()
        found = sorted(averaged(parts).collect(), key=lambda r: r.shard)  # one set of parameters
        if not found:
            break
        model.parameters = np.concatenate([np.frombuffer(bytes(r.parameters), np.float32) for r in found])
        scratch.drop(parts)
    scratch.drop(coded)
    return model


def count_words(source: DataFrame, scratch: Scratch) -> DataFrame:
    """(h, ending, c) of every word of ``source(text)``."""
    rows = source.mapInArrow(tidy(_word_counts), "h long, ending int, c long")
    return scratch.stash(rows.groupBy("h").agg(F.min("ending").alias("ending"), F.sum("c").alias("c")), "counts")


def vocabulary_of(counts: DataFrame, docs: int) -> tuple[Vocabulary, int]:
    """The vocabulary, and the least count of a word that is broadcast."""
    # the least count at which the words fit HOT_WORDS: one row for each count below 65,536, and one for each power of two from there
    least, room, complete = 1 << 62, HOT_WORDS, True
    power = F.expr("shiftleft(1L, length(bin(c)) - 1)")
    sizes = [(r.c, r.n) for r in counts.groupBy(F.when(F.col("c") < 1 << 16, F.col("c")).otherwise(power).alias("c")).agg(F.count("*").alias("n")).collect()]
    for c, n in sorted(sizes, reverse=True):
        if n > room:
            complete = False
            break
        least, room = c, room - n
    half = max(16, int(np.ceil(8 * sum(n for _, n in sizes) ** (1 / 3))))
    mass, kinds = np.zeros(half, np.int64), np.zeros(half, np.int64)
    for r in counts.groupBy((F.col("ending") % half).alias("e")).agg(F.sum("c").alias("c"), F.count("*").alias("n")).collect():  # half rows
        mass[r.e], kinds[r.e] = r.c, r.n
    hot = counts.where(F.col("c") >= least).select("h", "ending", "c").toArrow()
    h, ending, c = (hot[x].to_numpy() for x in ("h", "ending", "c"))
    own = np.lexsort((h, -c))[:half]
    return Vocabulary(h.view(U), c, h[own].view(U), ending[own] % half, half, mass, kinds, docs, complete), least


def score(documents: DataFrame, rounds: int = ROUNDS, report: dict | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score. ``report`` gets the vocabulary and the model."""
    spark = documents.sparkSession
    scratch = Scratch(spark, "lm")
    source = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", (doc_crc("doc_id") % 10 == 0).alias("held_out"))
    training = source.where("not held_out").select("text")
    counts = count_words(training, scratch)
    vocabulary, least = vocabulary_of(counts, training.count())
    shared = spark.sparkContext.broadcast(vocabulary)
    model = fit(training, vocabulary, shared, scratch, rounds)
    if report is not None:
        report.update(vocabulary=vocabulary, model=model)
    parameters = spark.sparkContext.broadcast(model.parameters)
    key = scratch.root

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared.value
        tables = remembered("tables")
        if key not in tables:
            tables.clear()
            m = LogBilinear(v.mass)
            m.parameters = parameters.value
            tables[key] = m.tables()
        a1, a2, z = tables[key]
        uid = TaskContext.get().partitionId() << 36
        for batch in batches:
            for part in slices(batch):
                h, c, k, first = tokens(part, v)
                one, two = contexts(c, first, v.end)
                n = part.num_rows
                doc = np.repeat(np.arange(n), np.diff(first))
                sum_by = lambda x: np.bincount(doc, x, n)
                hot = k >= 0
                log_c = np.where(hot, np.log10(np.maximum(k, 0) + 0.1), 0.0)
                tail = (c >= v.own) & (c < v.end)
                known = (a1[one, c] + a2[two, c] - z[one, two]).astype(np.float64) / np.log(10) + np.where(tail, log_c - v.log_mass[np.where(tail, c - v.own, 0)], 0.0)  # of rare words without log_c
                unseen, maybe = np.zeros(len(c)), np.flatnonzero(k <= 0)
                unseen[maybe] = (a1[one[maybe], v.unseen] + a2[two[maybe], v.unseen] - z[one[maybe], two[maybe]]).astype(np.float64) / np.log(10)
                lm = np.where(k == 0, unseen, known)
                rows = uid + np.arange(n)
                uid += n
                rare = np.flatnonzero(~hot)
                words, word = np.unique(h[rare], return_inverse=True)
                at, place, tf = np.unique(doc[rare] * max(len(words), 1) + word, return_inverse=True, return_counts=True)
                at, word = np.divmod(at, max(len(words), 1))
                m = len(tf)
                both = lambda x, y, kind: pa.concat_arrays([pa.array(x, kind), pa.nulls(m, kind) if y is None else pa.array(y, kind)])
                word_sum = lambda x: np.bincount(place, x[rare], m)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.concatenate([rows, rows[at]])),
                    pa.concat_arrays([part.column("doc_id"), pa.nulls(m, pa.int64())]),
                    pa.concat_arrays([part.column("held_out"), pa.nulls(m, pa.bool_())]),
                    both(np.diff(first), None, pa.int64()), both(sum_by(hot & (k > 0)).astype(np.int64), None, pa.int64()), both(sum_by(log_c), None, pa.float64()),
                    both(sum_by(np.where(hot, lm, 0.0)) if v.n else np.zeros(n), word_sum(known), pa.float64()),
                    both(np.zeros(n), word_sum(unseen), pa.float64()),
                    pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array(words[word].view(np.int64))]), pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array(tf.astype(np.int64))]),
                ], names=["uid", "doc_id", "held_out", "n_tokens", "n_known", "base", "lm", "unseen", "h", "tf"])

    rows = source.mapInArrow(tidy(run, "tables"), "uid long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, lm double, unseen double, h long, tf long")
    z, n = float(np.log10(vocabulary.z)), F.lit(vocabulary.n).cast("long").alias("train_tokens")
    if vocabulary.complete:  # no word's count is left to join
        return rows.select("doc_id", "held_out", "n_tokens", "n_known", n, (F.col("base") - F.col("n_tokens") * z).alias("base_score"), F.col("lm").alias("score"))
    rows = scratch.stash(rows, "rows")
    words = rows.where("h is not null").select("uid", "h", "tf", "lm", "unseen").join(counts.where(F.col("c") < least).select("h", "c"), "h", "left")
    known, log_c = F.col("c").isNotNull(), F.col("tf") * F.log10(F.coalesce("c", F.lit(0)) + F.lit(0.1))
    found = words.groupBy("uid").agg(F.sum(F.when(known, F.col("tf")).otherwise(0)).alias("more_known"), F.sum(log_c).alias("more_base"), F.sum(F.when(known, F.col("lm") + log_c).otherwise(F.col("unseen"))).alias("more_lm"))
    out = rows.where("h is null").join(found, "uid", "left")
    plus = lambda a, b: F.col(a) + F.coalesce(b, F.lit(0))
    return out.select("doc_id", "held_out", "n_tokens", plus("n_known", "more_known").alias("n_known"), n, (plus("base", "more_base") - F.col("n_tokens") * z).alias("base_score"), plus("lm", "more_lm").alias("score"))
