"""Quality rules: base counts, and character n-gram perplexity under modified Kneser-Ney models of each language.

1. Spark counts the code point trigrams of every language, over all whole texts (a run of white space is one space). A gram packs into
   63 bits, so all characters of all languages are told apart. Tasks merge their own counts; Spark sums them.
2. Counts become a modified Kneser-Ney model (Chen and Goodman, 1998) in Spark: continuation counts, discounts, back-off weights and
   interpolated probabilities are groupings and joins of the gram tables by language. An entry's key is the 64-bit hash of language, kind
   and gram; a model is sorted arrays of such hashes with their values, and is searched.
3. A model of at most ``MODEL_ENTRIES`` entries is broadcast. Beyond that, texts are dealt by language and salt, each group preceded by its
   language's entries, so that a task holds one language's arrays.
4. A text's log10 perplexity is the negative mean log10 probability of its characters. Of the texts that pass the base rules each language
   has a histogram (steps of 0.001), from which its band is: median -/+ ``spread`` times the distance from the median to the outer
   quartiles, widened for short texts in proportion to 1/sqrt(characters). Outside its band a document is rejected.

Defined cases: null text has no words and fails the base rules. A null lang is a language of its own. A language without texts that
pass has no band and rejects nothing. Equal rows and rows that share a doc_id are judged each by itself; an empty table gives no rows.
Columns of any other names are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from embedlens.llm import textnp
from embedlens.llm.shared import Scratch, fresh, release, slices, text_buffer, tidy

U = np.uint64
SYMBOLS = b"#*$%&|<>"
#: Width of a band in distances from the median to the quartile on that side, and what short texts get besides.
SPREAD, SHORT = 5.0, 0.5
STEP = 0.001
#: Entries (12 bytes each) of a model that is broadcast.
MODEL_ENTRIES = 4 << 20
#: Texts of one language that share a copy of its entries where the model is not broadcast.
GROUP_TEXTS = 100_000
SLICE = 1 << 20
#: A code point's bits, and kinds of entries: probabilities of each order, back-off weights of contexts of two and one, unseen characters.
BITS = 21
TRIGRAM, BIGRAM, UNIGRAM, BACK2, BACK1, UNSEEN = range(6)
COUNTS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, lang_key long, chars long, log_perplexity double"


def base_counts(col: pa.Array) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of each text."""
    data, offsets = text_buffer(col)
    w = textnp.words(data, offsets, lower=False)
    n_words = np.diff(w.first)
    inner = np.searchsorted(np.flatnonzero((data & 0xC0) == 0x80), offsets)  # of a character's bytes all but the first; none is white space
    chars = np.concatenate([[0], np.cumsum(w.end - w.start)])
    symbol = np.zeros(256, bool)
    symbol[list(SYMBOLS)] = True
    symbols = np.searchsorted(np.flatnonzero(symbol[data]), offsets)
    at, h = textnp.windows(w, 5)
    doc = w.doc()[at]
    _, inverse, count = np.unique(textnp.mix(h + doc.astype(U) * U(0x9E3779B97F4A7C15)), return_inverse=True, return_counts=True)
    twice = at[count[inverse] > 1]
    cover = np.zeros(len(w.hash) + 1, np.int64)
    np.add.at(cover, twice, 1)
    np.add.at(cover, twice + 5, -1)
    covered = np.concatenate([[0], np.cumsum(np.cumsum(cover[:-1]) > 0)])
    dup = []
    raw = data.tobytes()
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        lines = [x for x in raw[a:b].split(b"\n") if x.strip(b" \t\n\x0b\x0c\r")]
        dup.append(len(lines) - len(set(lines)))
    return {"n_words": n_words, "word_chars": chars[w.first[1:]] - chars[w.first[:-1]] - np.diff(inner), "n_symbols": np.diff(symbols), "n_dup_lines": np.array(dup, np.int64), "n_repeat_words": covered[w.first[1:]] - covered[w.first[:-1]]}


def base_failed(n_words: np.ndarray, n_repeat_words: np.ndarray) -> np.ndarray:
    return (n_words < 10) | (100 * n_repeat_words > 20 * n_words)


def characters(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, white space runs as one space; and which text each is of."""
    data, offsets = text_buffer(col)
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32).copy()
    doc = np.repeat(np.arange(len(offsets) - 1, dtype=np.int32), np.diff(textnp.code_points(data)[offsets]))
    points[(points >= 9) & (points <= 13)] = 32
    keep = np.ones(len(points), bool)
    keep[1:] = (points[1:] != 32) | (points[:-1] != 32) | (doc[1:] != doc[:-1])
    return points[keep], doc[keep]


def _distinct(two: np.ndarray, one: np.ndarray, now: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed distinct trigrams, the place of each trigram among them, and their counts."""
    seen = np.flatnonzero(np.bincount(now, minlength=33))
    seen = np.union1d(seen, [32])
    k = len(seen)
    if k**3 <= 1 << 24:  # few characters: counted in a table instead of sorted
        small = np.zeros(int(seen[-1]) + 1, np.int32)
        small[seen] = np.arange(k)
        code = (small[two] * k + small[one]) * k + small[now]
        count = np.bincount(code, minlength=k**3)
        found = np.flatnonzero(count)
        place = np.zeros(k**3, np.int32)
        place[found] = np.arange(len(found))
        a, b, c = (seen[x].astype(np.int64) for x in (found // (k * k), found // k % k, found % k))
        return (a << 2 * BITS) | (b << BITS) | c, place[code], count[found]
    packed = (two.astype(np.int64) << 2 * BITS) | (one.astype(np.int64) << BITS) | now
    return np.unique(packed, return_inverse=True, return_counts=True)


def trigrams(part: pa.RecordBatch, block: int = 1 << 20) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Of rows sorted by lang_key, for each language and ``block`` characters: (lang_key, distinct trigrams, their counts, each trigram's
    place among them, its text). The two characters before a text's start are spaces."""
    points, doc = characters(part.column("text"))
    lang = part.column("lang_key").to_numpy()
    starts = np.flatnonzero(np.concatenate([[True], lang[1:] != lang[:-1]]))
    at = np.searchsorted(doc, [*starts, len(lang)])
    for i, first, end in zip(starts, at[:-1].tolist(), at[1:].tolist()):
        for a in range(first, end, block):
            b, low = min(a + block, end), max(a - 2, 0)
            pad = 2 - (a - low)
            p = np.concatenate([np.full(pad, 32, np.uint32), points[low:b]])
            d = np.concatenate([np.full(pad, -1, np.int32), doc[low:b]])
            two, one = np.where(d[:-2] == d[2:], p[:-2], np.uint32(32)), np.where(d[1:-1] == d[2:], p[1:-1], np.uint32(32))
            grams, place, count = _distinct(two, one, p[2:])
            yield int(lang[i]), grams, count, place, d[2:]


def _sorted_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, limit=SLICE):
            yield part.take(pa.array(np.argsort(part.column("lang_key").to_numpy(), kind="stable")))


def _count(batches: Iterator[pa.RecordBatch], limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """(lang_key, gram, n): a task's counts, sent whenever there are more than ``limit`` distinct ones."""
    held: dict[int, list] = {}

    def merged() -> int:
        for lang, found in held.items():
            grams, place = np.unique(np.concatenate([g for g, _ in found]), return_inverse=True)
            held[lang] = [(grams, np.bincount(place, np.concatenate([n for _, n in found])).astype(np.int64))]
        return sum(len(found[0][0]) for found in held.values())

    def send() -> Iterator[pa.RecordBatch]:
        merged()
        for lang, [(grams, n)] in held.items():
            for a in range(0, len(grams), 100_000):
                part = grams[a : a + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), lang)), pa.array(part), pa.array(n[a : a + 100_000])], names=["lang_key", "gram", "n"])
        held.clear()

    size = 0
    for part in _sorted_slices(batches):
        for lang, grams, n, _, _ in trigrams(part):
            held.setdefault(lang, []).append((grams, n))
            size += len(grams)
        if size > limit:
            size = merged()
            if size > limit // 2:
                yield from send()
                size = 0
    yield from send()


def _order(counts: DataFrame, context: Column) -> tuple[DataFrame, DataFrame]:
    """Of (lang_key, gram, n): (lang_key, gram, context, own) with the discounted share, and (lang_key, context, back)."""
    c = counts.withColumn("context", context)
    n = [F.count_if(F.col("n") == i) for i in (1, 2, 3, 4)]
    found = c.groupBy("lang_key").agg(*[x.alias(f"n{i}") for i, x in enumerate(n, 1)])
    y = F.when(F.col("n1") > 0, F.col("n1") / (F.col("n1") + 2 * F.col("n2"))).otherwise(F.lit(0.5))
    discount = lambda i: F.least(F.lit(float(i)), F.greatest(F.lit(0.05), F.when(F.col(f"n{i}") > 0, i - (i + 1) * y * F.col(f"n{i + 1}") / F.col(f"n{i}")).otherwise(F.lit(0.5))))
    discounts = found.select("lang_key", *[discount(i).alias(f"d{i}") for i in (1, 2, 3)])
    cut = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
    c = c.join(discounts, "lang_key").withColumn("cut", cut)
    totals = c.groupBy("lang_key", "context").agg(F.sum("n").alias("total"), (F.sum("cut") / F.sum("n")).alias("back"))
    own = c.join(totals, ["lang_key", "context"]).select("lang_key", "gram", "context", ((F.col("n") - F.col("cut")) / F.col("total")).alias("own"))
    return own, totals.select("lang_key", "context", "back")


def kneser_ney(counts: DataFrame, scratch: Scratch) -> DataFrame:
    """(lang_key, kind, gram, value): the entries of all models, values in log10; ``counts`` has (lang_key, gram, n) of trigrams."""
    gram, low = F.col("gram"), lambda x, k: x.bitwiseAND(F.lit((1 << k * BITS) - 1))
    bigrams = scratch.stash(counts.groupBy("lang_key", low(gram, 2).alias("gram")).agg(F.count("*").alias("n")), "bigrams")
    unigrams = bigrams.groupBy("lang_key", low(gram, 1).alias("gram")).agg(F.count("*").alias("n"))
    own1, back0 = _order(unigrams, F.lit(0).cast("long"))
    kinds = unigrams.groupBy("lang_key").agg((F.count("*") + 1).alias("kinds"))
    floor = back0.join(kinds, "lang_key").select("lang_key", (F.col("back") / F.col("kinds")).alias("floor"))  # what an unseen character has
    p1 = scratch.stash(own1.join(floor, "lang_key").select("lang_key", "gram", (F.col("own") + F.col("floor")).alias("p")), "p1")
    own2, back1 = _order(bigrams, F.shiftrightunsigned(gram, BITS))
    back1 = scratch.stash(back1, "back1")
    rest = p1.select("lang_key", F.col("gram").alias("last"), F.col("p").alias("rest"))
    p2 = own2.withColumn("last", low(gram, 1)).join(back1, ["lang_key", "context"]).join(rest, ["lang_key", "last"]).select("lang_key", "gram", (F.col("own") + F.col("back") * F.col("rest")).alias("p"))
    p2 = scratch.stash(p2, "p2")
    own3, back2 = _order(counts, F.shiftrightunsigned(gram, BITS))
    back2 = scratch.stash(back2, "back2")
    rest = p2.select("lang_key", F.col("gram").alias("last"), F.col("p").alias("rest"))
    p3 = own3.withColumn("last", low(gram, 2)).join(back2, ["lang_key", "context"]).join(rest, ["lang_key", "last"]).select("lang_key", "gram", (F.col("own") + F.col("back") * F.col("rest")).alias("p"))
    parts = [(TRIGRAM, p3, "gram", "p"), (BIGRAM, p2, "gram", "p"), (UNIGRAM, p1, "gram", "p"), (BACK2, back2, "context", "back"), (BACK1, back1, "context", "back"), (UNSEEN, floor.withColumn("gram", F.lit(0).cast("long")), "gram", "floor")]
    out = None
    for kind, df, key, value in parts:
        one = df.select("lang_key", F.lit(kind).alias("kind"), F.col(key).alias("gram"), F.log10(value).cast("float").alias("value"))
        out = one if out is None else out.unionByName(one)
    model = scratch.stash(out, "model")
    scratch.drop(bigrams, p1, p2, back1, back2)
    return model


def entry_hash(lang: np.ndarray | int, kind: np.ndarray | int, gram: np.ndarray) -> np.ndarray:
    salt = textnp.mix(np.atleast_1d(np.asarray(lang, np.int64)).view(U) + np.asarray(kind).astype(U) * U(0x9E3779B97F4A7C15))
    return textnp.mix(textnp.mix(np.asarray(gram, np.int64).view(U)) + salt)


class Model:
    """Sorted hash arrays of entries."""

    def __init__(self, hashes: np.ndarray, values: np.ndarray):
        order = np.argsort(hashes)
        self.hashes, self.values = hashes[order], values[order].astype(np.float32)

    @classmethod
    def of(cls, table: pa.Table) -> Model:
        lang, kind, gram, value = (table.column(c).to_numpy() for c in ("lang_key", "kind", "gram", "value"))
        return cls(entry_hash(lang, kind, gram), value)

    def look(self, lang: int, kind: int, gram: np.ndarray, missing: float | np.ndarray) -> np.ndarray:
        h = entry_hash(lang, kind, gram)
        if not len(self.hashes):
            return np.full(len(h), missing, np.float64)
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        return np.where(self.hashes[at] == h, self.values[at].astype(np.float64), missing)

    def log10(self, lang: int, grams: np.ndarray) -> np.ndarray:
        """log10 probability of each packed trigram's last character after its first two."""
        out = self.look(lang, TRIGRAM, grams, np.nan)
        miss = np.flatnonzero(np.isnan(out))
        if len(miss):
            g = grams[miss]
            two = self.look(lang, BIGRAM, g & ((1 << 2 * BITS) - 1), np.nan)
            no = np.flatnonzero(np.isnan(two))
            if len(no):
                unseen = self.look(lang, UNSEEN, np.zeros(1, np.int64), -12.0)[0]
                last = g[no] & ((1 << BITS) - 1)
                two[no] = self.look(lang, BACK1, (g[no] >> BITS) & ((1 << BITS) - 1), 0.0) + self.look(lang, UNIGRAM, last, unseen)
            out[miss] = two + self.look(lang, BACK2, g >> BITS, 0.0)
        return out


def judge(part: pa.RecordBatch, model: Model) -> dict[str, np.ndarray]:
    """The columns of ``COUNTS`` of rows that are sorted by lang_key."""
    out = base_counts(part.column("text"))
    n, total = np.zeros(part.num_rows, np.int64), np.zeros(part.num_rows)
    for lang, grams, _, place, doc in trigrams(part):
        n += np.bincount(doc, minlength=part.num_rows)
        total -= np.bincount(doc, model.log10(lang, grams)[place], minlength=part.num_rows)
    return out | {"base_failed": base_failed(out["n_words"], out["n_repeat_words"]), "lang_key": part.column("lang_key").to_numpy(), "chars": n, "log_perplexity": total / np.maximum(n, 1)}


def _with_language(documents: DataFrame, name: str) -> DataFrame:
    lang = F.col("lang").cast("string")
    return documents.withColumn(name, F.when(lang.isNull(), F.lit(0).cast("long")).otherwise(F.xxhash64(lang)))


def fit_model(documents: DataFrame, scratch: Scratch) -> DataFrame:
    """The entries of ``kneser_ney`` over all texts."""
    source = _with_language(documents.select("lang", "text").where("text is not null"), "lang_key").select("lang_key", "text")
    counts = source.mapInArrow(tidy(_count), "lang_key long, gram long, n long").groupBy("lang_key", "gram").agg(F.sum("n").alias("n"))
    counts = scratch.stash(counts, "counts")
    model = kneser_ney(counts, scratch)
    scratch.drop(counts)
    return model


def scored(documents: DataFrame, scratch: Scratch, limit: int = MODEL_ENTRIES, group_texts: int = GROUP_TEXTS) -> tuple[DataFrame, str]:
    """The input's rows with a struct column of ``COUNTS``, and that column's name."""
    entries = fit_model(documents, scratch)
    names = documents.columns
    result, lang_key, salt, table = fresh([*names, "text", "lang_key"], "judged", "lang", "salt", "entries")
    schema = T.StructType([*documents.schema.fields, T.StructField(result, T._parse_datatype_string(COUNTS))])

    def judged_rows(part: pa.RecordBatch, model: Model) -> pa.RecordBatch:
        lang = part.column(part.schema.get_field_index(lang_key))
        found = judge(pa.RecordBatch.from_arrays([part.column("text"), lang], names=["text", "lang_key"]), model)
        struct = pa.StructArray.from_arrays([pa.array(v) for v in found.values()], names=list(found))
        return pa.RecordBatch.from_arrays([*(part.column(c) for c in names), struct], names=[*names, result])

    def by_language(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for part in slices(batch, limit=SLICE):
            yield part.take(pa.array(np.argsort(part.column(part.schema.get_field_index(lang_key)).to_numpy(), kind="stable")))

    source = _with_language(documents, lang_key)
    if entries.count() <= limit:
        shared = documents.sparkSession.sparkContext.broadcast(Model.of(entries.toArrow()))
        release(documents.sparkSession)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in by_language(batch):
                    yield judged_rows(part, shared.value)

        return source.mapInArrow(tidy(run), schema), result

    sizes = source.groupBy(lang_key).agg(F.greatest(F.lit(1), F.ceil(F.count("*") / group_texts)).cast("long").alias(salt))
    packed = entries.groupBy("lang_key", F.pmod(F.xxhash64("gram"), F.lit(64)).alias("cut")).agg(F.collect_list(F.struct("kind", "gram", "value")).alias(table))
    packed = packed.join(sizes.select(F.col(lang_key).alias("lang_key"), F.explode(F.sequence(F.lit(0).cast("long"), F.col(salt) - 1)).alias(salt)), "lang_key")
    packed = packed.select(F.col("lang_key").alias(lang_key), salt, table)
    texts = source.join(F.broadcast(sizes.withColumnRenamed(salt, salt + "n")) if sizes.count() <= 100_000 else sizes.withColumnRenamed(salt, salt + "n"), lang_key)
    texts = texts.withColumn(salt, F.pmod(F.xxhash64("doc_id", "text"), F.col(salt + "n"))).drop(salt + "n")
    both = texts.unionByName(packed, allowMissingColumns=True).repartition(lang_key, salt).sortWithinPartitions(lang_key, salt, F.col(table).isNull())

    def run_dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each (language, salt) brings its entries first, then its texts."""
        model, held, now = None, [], None
        for batch in batches:
            lang, cut = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in (lang_key, salt))
            entries_ = batch.column(batch.schema.get_field_index(table))
            kind = np.asarray(entries_.is_valid())
            change = np.flatnonzero((lang[1:] != lang[:-1]) | (cut[1:] != cut[:-1]) | (kind[1:] != kind[:-1])) + 1
            for a, b in zip([0, *change], [*change, len(lang)]):
                if a == b:
                    continue
                if (lang[a], cut[a]) != now:
                    now, held, model = (lang[a], cut[a]), [], None
                if kind[a]:
                    flat = entries_.slice(a, b - a).flatten()
                    k, g, v = flat.flatten()
                    held.append((entry_hash(int(lang[a]), k.to_numpy(), g.to_numpy()), v.to_numpy()))
                    continue
                if model is None:
                    model, held = Model(*(np.concatenate(x) for x in zip(*held))) if held else Model(np.zeros(0, U), np.zeros(0)), []
                for part in by_language(batch.slice(a, b - a)):
                    yield judged_rows(part, model)

    return both.mapInArrow(tidy(run_dealt), schema), result


def bands(passed: DataFrame, spread: float) -> DataFrame:
    """(lang_key, low, high) of rows (lang_key, log_perplexity), from a histogram of at most 12 / STEP bins a language."""
    bins = passed.groupBy("lang_key", F.round(F.least("log_perplexity", F.lit(12.0)) / STEP).cast("int").alias("bin")).agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("lang_key").orderBy("bin"))
    bins = bins.select("lang_key", "bin", upto.alias("upto"), F.sum("n").over(Window.partitionBy("lang_key")).alias("all"))
    quartile = lambda q: F.min(F.when(F.col("upto") >= q * F.col("all"), F.col("bin"))) * STEP
    q = bins.groupBy("lang_key").agg(*[quartile(x).alias(c) for x, c in ((0.25, "q1"), (0.5, "q2"), (0.75, "q3"))])
    width = lambda a, b: spread * F.greatest(F.col(a) - F.col(b), F.lit(3 * STEP))
    return q.select("lang_key", (F.col("q2") - width("q2", "q1")).alias("low"), (F.col("q2") + width("q3", "q2")).alias("high"))


def judged(documents: DataFrame, spread: float = SPREAD, short: float = SHORT, keep_rows: bool = False, limit: int = MODEL_ENTRIES) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, lang, log_perplexity; with
    ``keep_rows`` the input's rows that are kept instead. ``limit``: see ``MODEL_ENTRIES``."""
    scratch = Scratch(documents.sparkSession, "quality")
    names = documents.columns
    source = documents if keep_rows else documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), "text")
    rows, result = scored(source, scratch, limit)
    rows = scratch.stash(rows if keep_rows else rows.drop("text"), "scored")  # texts go along only where rows are asked for
    r = F.col(result)
    band = scratch.stash(bands(rows.select(f"{result}.*").where("not base_failed").select("lang_key", "log_perplexity"), spread), "bands")
    low, high, key = fresh([*rows.columns], "low", "high", "key")
    band = band.select(F.col("lang_key").alias(key), F.col("low").alias(low), F.col("high").alias(high))
    both = rows.join(F.broadcast(band) if band.count() <= 100_000 else band, r["lang_key"] == F.col(key), "left")  # a row a language
    more = F.lit(short) / F.sqrt(F.greatest(r["chars"], F.lit(1)))
    inside = (r["log_perplexity"] >= F.coalesce(low, F.lit(float("-inf"))) - more) & (r["log_perplexity"] <= F.coalesce(high, F.lit(float("inf"))) + more)
    kept = ~r["base_failed"] & inside
    if keep_rows:
        return both.where(kept).select(*names)
    return both.select("doc_id", *[r[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")], kept.alias("kept"), "lang", r["log_perplexity"].alias("log_perplexity"))
