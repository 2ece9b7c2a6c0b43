"""Queries of alignment, erasure, assignment and saliency."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from embedlens.functions import columns as C
from embedlens.operators import moments as G
from embedlens.operators import patches, retrieval
from embedlens.plans import bindings as B
from embedlens.plans.q_corpus import STRIP, WORDS
from embedlens.plans.q_retrieval import DOT, paired_sql
from embedlens.plans.registry import query
from embedlens.sources.shared import written


def view_pair(spark, sf_dir):
    return G.paired(B.crops(spark, sf_dir), B.encoder_b(spark, sf_dir))


def one_row(spark, **values):
    names = ", ".join(f"{k} {'long' if isinstance(v, int) else 'double'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], names)


# n x n kernels, as the definition has them; Spark never makes them
KERNEL = f"""
k AS (SELECT a.crop_id AS i, b.crop_id AS j, {DOT}(a.v, b.v) AS kx, {DOT}(c.v, d.v) AS kz FROM vec a JOIN vecb c ON a.crop_id = c.crop_id, vec b JOIN vecb d ON b.crop_id = d.crop_id)"""
BIASED = """, rowm AS (SELECT i, avg(kx) AS mx, avg(kz) AS mz FROM k GROUP BY i), allm AS (SELECT avg(kx) AS gx, avg(kz) AS gz, sqrt(count(*)) AS n FROM k)
SELECT round(sum((kx - a.mx - b.mx + gx) * (kz - a.mz - b.mz + gz)) / pow(any_value(n) - 1, 2), 6) AS hsic FROM k JOIN rowm a ON k.i = a.i JOIN rowm b ON k.j = b.i, allm"""


@query(B.with_ctes("vec vecb", "").rstrip() + "," + KERNEL + BIASED)
def hsic_biased(spark, sf_dir):
    return one_row(spark, hsic=round(G.hsic_biased(view_pair(spark, sf_dir)), 6))


def _unbiased(x: str, z: str, name: str) -> str:
    return f"""{name} AS (SELECT (sum({x} * {z}) + sum({x}) * sum({z}) / ((any_value(n) - 1) * (any_value(n) - 2)) - 2 * (SELECT sum(p * q) FROM (SELECT sum({x}) AS p, sum({z}) AS q FROM k WHERE i <> j GROUP BY i)) / (any_value(n) - 2)) / (any_value(n) * (any_value(n) - 3)) AS h FROM k, (SELECT count(*)::DOUBLE AS n FROM vec) WHERE i <> j)"""


UNBIASED = B.with_ctes("vec vecb", "").rstrip() + "," + KERNEL + ", " + ", ".join([_unbiased("kx", "kz", "xz"), _unbiased("kx", "kx", "xx"), _unbiased("kz", "kz", "zz")])


@query(UNBIASED + " SELECT round((SELECT h FROM xz) * 1e6::DOUBLE, 3) AS xz_millionths, round((SELECT h FROM xx), 6) AS xx, round((SELECT h FROM zz), 6) AS zz")
def hsic_unbiased(spark, sf_dir):
    h = G.hsic_unbiased_all(view_pair(spark, sf_dir))
    return one_row(spark, xz_millionths=round(h["xz"] * 1e6, 3), xx=round(h["xx"], 6), zz=round(h["zz"], 6))


@query(UNBIASED + " SELECT round((SELECT h FROM xz) / sqrt((SELECT h FROM xx) * (SELECT h FROM zz)), 6) AS cka")
def cka(spark, sf_dir):
    return one_row(spark, cka=round(G.cka(view_pair(spark, sf_dir)), 6))


@query()
def procrustes(spark, sf_dir):
    return one_row(spark, distance=round(G.procrustes(view_pair(spark, sf_dir)), 6))


def _knn(name: str, t: str, k: int) -> str:
    return f"{name} AS (SELECT q, id FROM (SELECT a.crop_id AS q, b.crop_id AS id, row_number() OVER (PARTITION BY a.crop_id ORDER BY round({DOT}(a.v, b.v), 9) DESC, b.crop_id) AS r FROM {t} a, {t} b WHERE a.crop_id <> b.crop_id) WHERE r <= {k})"


@query(B.with_ctes("vec vec2", "").rstrip() + f", {_knn('ka', 'vec', 10)}, {_knn('kb', 'vec2', 10)} SELECT 10::BIGINT AS k, any_value(n) AS n, round(count(*) / (any_value(n) * 10)::DOUBLE, 6) AS overlap FROM ka JOIN kb ON ka.q = kb.q AND ka.id = kb.id, (SELECT count(*) AS n FROM vec)")
def mutual_knn(spark, sf_dir):
    return G.mutual_knn(B.crops(spark, sf_dir), B.masked(spark, sf_dir), 10)


def _grid_sql() -> str:
    views = {"full": "vec", "half": "vech", "masked": "vec2"}
    head = B.with_ctes("vec vecb vec2", "").rstrip() + f", vech AS (SELECT crop_id, page_id, {B.unit('v')} AS v FROM vecb)" + "".join(f", {_knn('k_' + n, t, 10)}" for n, t in views.items())
    parts, names = [], sorted(views)
    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            t = f"{a}_{b}"
            k = f"k_{t} AS (SELECT a.crop_id AS i, b.crop_id AS j, {DOT}(a.v, b.v) AS kx, {DOT}(c.v, d.v) AS kz FROM {views[a]} a JOIN {views[b]} c ON a.crop_id = c.crop_id, {views[a]} b JOIN {views[b]} d ON b.crop_id = d.crop_id)"
            head += ", " + k + "".join(", " + _unbiased(x, z, f"{n}_{t}").replace(" FROM k ", f" FROM k_{t} ").replace(" FROM k,", f" FROM k_{t},") for x, z, n in (("kx", "kz", "xz"), ("kx", "kx", "xx"), ("kz", "kz", "zz")))
            parts.append(f"SELECT '{a}' AS enc_a, '{b}' AS enc_b, 'cka' AS metric, round((SELECT h FROM xz_{t}) / sqrt((SELECT h FROM xx_{t}) * (SELECT h FROM zz_{t})), 6) AS value")
            parts.append(f"SELECT '{a}', '{b}', 'knn_10', (SELECT round(count(*) / ((SELECT count(*) FROM vec) * 10)::DOUBLE, 6) FROM k_{a} x JOIN k_{b} y ON x.q = y.q AND x.id = y.id)")
    return head + " " + " UNION ALL ".join(parts)


@query(_grid_sql())
def alignment_grid(spark, sf_dir):
    return G.alignment_grid({"full": B.crops(spark, sf_dir), "masked": B.masked(spark, sf_dir), "half": B.encoder_b(spark, sf_dir)})


def masked_pair(spark, sf_dir):
    return G.paired(B.crops(spark, sf_dir), B.masked(spark, sf_dir))


@query()
def delta_pca(spark, sf_dir):
    """Share of variance of the first directions of what masking takes away."""
    _, share = G.delta_pca(masked_pair(spark, sf_dir), 8)
    return spark.createDataFrame([(i, round(float(s), 6)) for i, s in enumerate(share)], "rank long, explained double")


def eraser(spark, sf_dir, rank: int) -> G.Eraser:
    return G.delta_erasers(masked_pair(spark, sf_dir), [rank])[rank]


@query()
def concept_erase_fit(spark, sf_dir):
    e = eraser(spark, sf_dir, 4)
    return spark.createDataFrame([(i, round(float(np.linalg.norm(r)), 6)) for i, r in enumerate(e.matrix)], "dim long, row_norm double")


@query()
def concept_erase_apply(spark, sf_dir):
    return eraser(spark, sf_dir, 4).apply(B.crops(spark, sf_dir)).select("crop_id", "page_id", F.round(C.norm(F.col("v")), 6).alias("norm"), F.round(F.col("v")[0], 6).alias("first"))


@query()
def erase_residual(spark, sf_dir):
    """Mean |x . direction| before and after erasure."""
    pair = masked_pair(spark, sf_dir)
    directions, _ = G.delta_pca(pair, 1)
    w = F.array(*[F.lit(float(x)) for x in directions[:, 0]])
    mean = lambda df: df.agg(F.round(F.avg(F.abs(C.dot(F.col("v"), w))), 6)).first()[0]
    c = B.crops(spark, sf_dir)
    return one_row(spark, before=mean(c), after=mean(eraser(spark, sf_dir, 1).apply(c)))


@query()
def erase_sweep(spark, sf_dir):
    """Leave-one-out recall before, masked, and erased at growing rank, with the change from before."""
    c, out = B.crops(spark, sf_dir), None
    erasers = G.delta_erasers(masked_pair(spark, sf_dir), [1, 4, 8])
    views = [("before", 0, c), ("masked", 0, B.masked(spark, sf_dir))] + [("erased", r, e.apply(c)) for r, e in erasers.items()]
    for name, rank, df in views:
        one = retrieval.recall_loo_groups(df).select(F.lit(name).alias("view"), F.lit(rank).cast("long").alias("rank"), "k", "hits", "total", "recall")
        out = one if out is None else out.unionByName(one)
    out = written(out, "sweep")
    first = out.where("view = 'before'").select("k", F.col("recall").alias("first"))
    return out.join(first, "k").select("view", "rank", "k", "hits", "total", "recall", F.round(F.col("recall") - F.col("first"), 6).alias("delta"))


@query(B.with_ctes("vec vec2", "WITH_SCORES").replace("WITH_SCORES", """SELECT a.crop_id, round(sum((a.x - b.x - m.mu) * (a.x - b.x - m.mu)), 6) AS energy FROM
(SELECT crop_id, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM vec) a JOIN (SELECT crop_id, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM vec2) b ON a.crop_id = b.crop_id AND a.i = b.i
JOIN (SELECT c.i, avg(c.x - d.x) AS mu FROM (SELECT crop_id, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM vec) c JOIN (SELECT crop_id, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM vec2) d ON c.crop_id = d.crop_id AND c.i = d.i GROUP BY c.i) m ON a.i = m.i GROUP BY a.crop_id"""))
def delta_scores(spark, sf_dir):
    """Scores of what masking takes away on all principal directions; a row's squares sum to its centred squared length."""
    pair = B.crops(spark, sf_dir).select("crop_id", F.col("v").alias("x")).join(B.masked(spark, sf_dir).select("crop_id", F.col("v").alias("z")), "crop_id")
    return G.delta_scores(pair, "crop_id").groupBy("crop_id").agg(F.round(F.sum(F.col("z") * F.col("z")), 6).alias("energy"))


@query(B.with_ctes("vec vec2", "SELECT count(*) FILTER (WHERE a.crop_id IS NULL) AS only_b, count(*) FILTER (WHERE b.crop_id IS NULL) AS only_a, count(*) FILTER (WHERE a.page_id <> b.page_id) AS group_mismatch, count(*) FILTER (WHERE len(a.v) <> len(b.v)) AS dim_mismatch, count(*) AS ids FROM vec a FULL JOIN vec2 b ON a.crop_id = b.crop_id"))
def paired_view_check(spark, sf_dir):
    return G.paired_view_check(B.crops(spark, sf_dir), B.masked(spark, sf_dir))


@query()
def linear_probe(spark, sf_dir):
    c = B.crops(spark, sf_dir)
    classes = c.agg(F.max("page_id")).first()[0] + 1
    one_hot = F.transform(F.sequence(F.lit(0), F.lit(classes - 1)), lambda i: (i == F.col("page_id")).cast("double"))
    e = G.fit_eraser(G.moments(c.select(F.col("v").alias("x"), one_hot.alias("z"))))
    return one_row(spark, before=round(G.linear_probe(c, "page_id", classes), 6), after=round(G.linear_probe(e.apply(c, normalise=False), "page_id", classes), 6))


@query()
def linear_adapter(spark, sf_dir):
    """A ridge map from the masked view to the full one, held against the identity by paired recall."""
    full, masked = B.crops(spark, sf_dir), B.masked(spark, sf_dir)
    m, before, after = G.linear_adapter(G.paired(masked, full))
    views = (("without", masked), ("with", G.apply_matrix(masked, m, before, after)))
    out = [retrieval.recall_paired(v, full).withColumn("adapter", F.lit(n)) for n, v in views]
    return out[0].unionByName(out[1])


HALF = "(SELECT crop_id, page_id, " + B.unit("w") + " AS v FROM (SELECT crop_id, page_id, v[1:32] AS w FROM vec))"


@query(paired_sql("vec vecb", HALF, "(SELECT crop_id, page_id, " + B.unit("v") + " AS v FROM vecb)"))
def adapter_baseline(spark, sf_dir):
    cut = B.crops(spark, sf_dir).withColumn("v", C.dims(F.col("v"), 1, 32))
    return retrieval.recall_paired(G.unit(cut), G.unit(B.encoder_b(spark, sf_dir)))


# patches: the eight tokens of a crop; scores against four clusters are the tokens' first four components, times four
def scores(spark, sf_dir):
    t = B.tokens(spark, sf_dir)
    return t.select(F.col("crop_id").alias("item"), F.col("token_id").alias("patch"), F.posexplode(F.slice("t", 1, 4)).alias("cluster", "score")).withColumn("score", F.col("score") * 4)


def features(spark, sf_dir):
    return B.tokens(spark, sf_dir).select(F.col("crop_id").alias("item"), F.col("token_id").alias("patch"), F.col("t").alias("f"))


def _ot_sql(iterations: int = 3) -> str:
    out = "s0 AS (SELECT crop_id AS item, token_id AS patch, (i - 1)::BIGINT AS cluster, t[i] * 4 AS m FROM tok, range(1, 5) r(i) UNION ALL SELECT crop_id, token_id, 4, 0.5::DOUBLE FROM tok)"
    lse = "mx + ln(sum(exp(m - mx)) OVER (PARTITION BY item, {0}))"
    for i in range(iterations):
        rows = f"SELECT item, patch, cluster, m - ({lse.format('cluster')}) + CASE WHEN cluster = 4 THEN ln(4) ELSE 0 END AS m FROM (SELECT *, max(m) OVER (PARTITION BY item, cluster) AS mx FROM s{i})"
        out += f", r{i} AS ({rows}), s{i + 1} AS (SELECT item, patch, cluster, m - ({lse.format('patch')}) AS m FROM (SELECT *, max(m) OVER (PARTITION BY item, patch) AS mx FROM r{i}))"
    return out + f", p AS (SELECT item, patch, cluster, exp(m) AS p FROM s{iterations})"


OT = B.with_ctes("vec tok", "").rstrip() + ", " + _ot_sql()


def assigned(spark, sf_dir):
    return patches.ot_assign(scores(spark, sf_dir), 4, 8, 0.5)


@query(OT + " SELECT item, patch, cluster, round(p, 6) AS p FROM p")
def ot_assign(spark, sf_dir):
    return assigned(spark, sf_dir).select("item", "patch", F.col("cluster").cast("long").alias("cluster"), F.round("p", 6).alias("p"))


@query(OT + " SELECT item, round(sum(p) FILTER (WHERE cluster = 4) / sum(p), 6) AS dustbin FROM p GROUP BY item")
def dustbin_mass(spark, sf_dir):
    return patches.dustbin_mass(assigned(spark, sf_dir), 4)


@query(B.with_ctes("vec tok", "SELECT item, patch, cluster, round(exp(s) / sum(exp(s)) OVER (PARTITION BY item, patch), 6) AS p FROM (SELECT crop_id AS item, token_id AS patch, (i - 1)::BIGINT AS cluster, t[i] * 4 AS s FROM tok, range(1, 5) r(i))"))
def softmax_assign(spark, sf_dir):
    return patches.softmax_assign(scores(spark, sf_dir)).select("item", "patch", F.col("cluster").cast("long").alias("cluster"), F.round("p", 6).alias("p"))


@query(OT + """, c AS (SELECT item, cluster, d, sum(p * x) AS x FROM (SELECT p.item, p.cluster, p.p, unnest(t.t) AS x, generate_subscripts(t.t, 1) AS d FROM p JOIN tok t ON p.item = t.crop_id AND p.patch = t.token_id WHERE p.cluster < 4) GROUP BY item, cluster, d),
g AS (SELECT item, 1 AS part, cluster AS c, d, x / greatest(sqrt(sum(x * x) OVER (PARTITION BY item, cluster)), 1e-12::DOUBLE) AS x FROM c UNION ALL SELECT crop_id, 0, 0, generate_subscripts(u, 1), unnest(u) FROM (SELECT crop_id, """ + B.unit("v") + """ AS u FROM vec))
SELECT item, row_number() OVER (PARTITION BY item ORDER BY part, c, d) - 1 AS i, round(x / greatest(sqrt(sum(x * x) OVER (PARTITION BY item)), 1e-12::DOUBLE), 6) AS value FROM g""")
def weighted_aggregate(spark, sf_dir):
    whole = B.crops(spark, sf_dir).select(F.col("crop_id").alias("item"), F.col("v").alias("g"))
    return patches.weighted_aggregate(assigned(spark, sf_dir), features(spark, sf_dir), 4, whole).withColumn("value", F.round("value", 6))


@query(OT + " SELECT item, cluster FROM (SELECT item, cluster, row_number() OVER (PARTITION BY item ORDER BY round(sum(p), 9) DESC, cluster) AS r FROM p GROUP BY item, cluster) WHERE r = 1")
def top_cluster(spark, sf_dir):
    return patches.top_cluster(assigned(spark, sf_dir)).withColumn("cluster", F.col("cluster").cast("long"))


@query(OT + " SELECT item, round(avg(p), 6) AS mean, round(max(p), 6) AS max, round(-sum(p * ln(greatest(p, 1e-12::DOUBLE))), 6) AS entropy FROM p GROUP BY item")
def weight_stats(spark, sf_dir):
    return patches.weight_stats(assigned(spark, sf_dir), "item", "p")


SAL = B.with_ctes("vec tok", "").rstrip() + f""", m AS (SELECT crop_id, list(x ORDER BY i) AS g FROM (SELECT crop_id, i, sum(x) AS x FROM (SELECT crop_id, unnest(t) AS x, generate_subscripts(t, 1) AS i FROM tok) GROUP BY crop_id, i) GROUP BY crop_id),
sal AS (SELECT t.crop_id AS item, t.token_id AS patch, {DOT}(t.t, m.g) / greatest(sqrt({DOT}(t.t, t.t)) * sqrt({DOT}(m.g, m.g)), 1e-12::DOUBLE) AS s FROM tok t JOIN m ON t.crop_id = m.crop_id)"""


def saliency(spark, sf_dir):
    summary = retrieval.mean_pool(B.tokens(spark, sf_dir), F.lit(True)).select(F.col("crop_id").alias("item"), "g")
    return patches.patch_saliency(features(spark, sf_dir), summary)


@query(SAL + " SELECT item, patch, round(s, 6) AS saliency FROM sal")
def patch_saliency(spark, sf_dir):
    return saliency(spark, sf_dir).withColumn("saliency", F.round("saliency", 6))


@query(SAL + """, cell AS (SELECT item, patch // 4 AS r, patch % 4 AS c, coalesce((s - min(s) OVER (PARTITION BY item)) / nullif(max(s) OVER (PARTITION BY item) - min(s) OVER (PARTITION BY item), 0), 0) AS v FROM sal),
box AS (SELECT crop_id AS item, b AS box, x0, y0, x0 + 1.5::DOUBLE AS x1, y0 + 0.75::DOUBLE AS y1 FROM (SELECT crop_id, b, b * 1.25::DOUBLE AS x0, (crop_id % 3) * 0.5::DOUBLE AS y0 FROM vec, range(0, 3) q(b))),
hit AS (SELECT b.item, b.box, c.v, (least(x1, c + 1) - greatest(x0, c)) * (least(y1, r + 1) - greatest(y0, r)) AS a FROM box b JOIN cell c ON b.item = c.item AND c.c < x1 AND c.c + 1 > x0 AND c.r < y1 AND c.r + 1 > y0)
SELECT b.item, b.box, round(coalesce(sum(a * v) / sum(a), 0), 6) AS value FROM box b LEFT JOIN hit h ON b.item = h.item AND b.box = h.box GROUP BY b.item, b.box""")
def region_mean(spark, sf_dir):
    cells = saliency(spark, sf_dir).select("item", F.floor(F.col("patch") / 4).alias("r"), (F.col("patch") % 4).alias("c"), F.col("saliency").alias("value"))
    boxes = B.crops(spark, sf_dir).select(F.col("crop_id").alias("item"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(2).cast("long"))).alias("box"))
    boxes = boxes.withColumn("x0", F.col("box") * 1.25).withColumn("y0", F.col("item") % 3 * 0.5).withColumn("x1", F.col("x0") + 1.5).withColumn("y1", F.col("y0") + 0.75)
    return patches.region_mean(cells, boxes)


WORDS_SQL = f"wt AS (SELECT {{k}}, pos, word FROM (SELECT {{k}}, pos - 1 AS pos, trim(lower(ws[pos]), {STRIP}) AS word FROM (SELECT {{k}}, ws, unnest(range(1, len(ws) + 1)) AS pos FROM (SELECT {{k}}, {WORDS} AS ws FROM {{t}}))) WHERE word <> '')"
FIRST = "fw AS (SELECT doc_id, word, arg_min(pos * 1.0::DOUBLE / 256, pos) AS value FROM wt GROUP BY doc_id, word)"


def first_values(spark, sf_dir):
    docs = B.table(spark, sf_dir, "documents").select("doc_id", "text").repartition("doc_id")  # texts are sent, not a row for each word
    return patches.first_word_value(patches.word_table(docs, "doc_id", "text").withColumn("value", F.col("pos") / 256), "doc_id")


@query("WITH " + WORDS_SQL.format(k="doc_id", t="documents") + ", " + FIRST + " SELECT doc_id, word, round(value, 6) AS value FROM fw")
def first_word_value(spark, sf_dir):
    return first_values(spark, sf_dir).withColumn("value", F.round("value", 6))


BOXES = "bx AS (SELECT DISTINCT d.doc_id, w.word FROM (SELECT doc_id, (doc_id % (SELECT count(*) FROM benchmark)) AS item_id FROM documents) d JOIN (SELECT item_id, trim(lower(unnest(" + WORDS + f")), {STRIP}) AS word FROM benchmark) w ON d.item_id = w.item_id WHERE w.word <> '')"


@query("WITH " + WORDS_SQL.format(k="doc_id", t="documents") + ", " + FIRST + ", " + BOXES + """,
j AS (SELECT b.doc_id, b.word, f.value FROM bx b JOIN fw f ON b.doc_id = f.doc_id AND b.word = f.word WHERE b.doc_id IN (SELECT doc_id FROM bx GROUP BY 1 HAVING count(*) >= 5))
SELECT doc_id, word, round(value, 6) AS value FROM j WHERE doc_id IN (SELECT doc_id FROM j GROUP BY 1 HAVING count(*) >= 5)""")
def matched_words(spark, sf_dir):
    """Words of a benchmark item (dealt to every document by its id) that the document also has."""
    bench = B.table(spark, sf_dir, "benchmark")
    n = bench.count()
    words = patches.word_table(bench, "item_id", "text").select("item_id", "word").distinct()
    boxes = B.table(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") % n).alias("item_id")).join(words, "item_id").select("doc_id", "word")
    found = patches.word_table(B.table(spark, sf_dir, "documents"), "doc_id", "text").withColumn("item_id", F.col("doc_id") % n)
    asked = found.join(words, ["item_id", "word"], "left_semi").withColumn("value", F.col("pos") / 256)  # before anything is sent
    return patches.matched_words(boxes, patches.first_word_value(asked, "doc_id"), "doc_id").withColumn("value", F.round("value", 6))


_VOC = "list_distinct(list_filter(string_split(lower(regexp_replace(coalesce({0}, ''), '[ \\t\\n\\r\\x0b\\f]+', ' ', 'g')), ' '), lambda w: w <> ''))"


@query(f"SELECT conv_id, len(list_intersect({_VOC.format('u')}, {_VOC.format('a')})) AS matched FROM (SELECT conv_id, string_agg(text, ' ' ORDER BY turn) FILTER (WHERE role = 'user') AS u, string_agg(text, ' ' ORDER BY turn) FILTER (WHERE role = 'assistant') AS a FROM conversations GROUP BY conv_id)")
def matched_vocab(spark, sf_dir):
    """Words that both sides of a conversation use."""
    c = B.table(spark, sf_dir, "conversations")
    side = lambda r: c.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("role") == r, F.struct("turn", "text")))), lambda x: x["text"]), " ").alias("text"))
    return patches.matched_vocab(side("user"), side("assistant"), "conv_id")


_BY_NAME = B.with_ctes("vec tok", "").rstrip() + f""", s AS (
  SELECT 'first' AS name, crop_id, t AS g FROM tok WHERE token_id = 0
  UNION ALL SELECT 'mean', crop_id, list(x ORDER BY i) FROM (SELECT crop_id, i, sum(x) AS x FROM (SELECT crop_id, unnest(t) AS x, generate_subscripts(t, 1) AS i FROM tok) GROUP BY crop_id, i) GROUP BY crop_id
  UNION ALL SELECT 'strongest', crop_id, t FROM (SELECT crop_id, t, row_number() OVER (PARTITION BY crop_id ORDER BY round(sqrt({DOT}(t, t)), 9) DESC, token_id) AS r FROM tok) WHERE r = 1)
SELECT name, t.crop_id AS item, t.token_id AS patch, round({DOT}(t.t, s.g) / greatest(sqrt({DOT}(t.t, t.t)) * sqrt({DOT}(s.g, s.g)), 1e-12::DOUBLE), 6) AS saliency FROM tok t JOIN s ON t.crop_id = s.crop_id"""


@query(_BY_NAME)
def saliency_by_name(spark, sf_dir):
    """Every registered saliency over all patches."""
    out = None
    for name in sorted(patches.SALIENCY):
        one = patches.saliency_by_name(features(spark, sf_dir), name).select(F.lit(name).alias("name"), "item", "patch", F.round("saliency", 6).alias("saliency"))
        out = one if out is None else out.unionByName(one)
    return out
