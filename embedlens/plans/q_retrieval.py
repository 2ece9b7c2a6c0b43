"""Queries of retrieval and contrastive batches."""

from __future__ import annotations

from pyspark.sql import functions as F

from embedlens.functions import columns as C
from embedlens.operators import contrastive, retrieval, vectors
from embedlens.plans import bindings as B
from embedlens.plans.q_corpus import BATCH
from embedlens.plans.registry import query

KS = "(VALUES (1::BIGINT), (5::BIGINT), (10::BIGINT), (20::BIGINT)) ks(k)"
KS2 = "(VALUES (1::BIGINT), (5::BIGINT)) ks(k)"
DOT = "list_inner_product"


def recall_sql(names: str, ranks: str, ks: str = KS, more: str = "", extra: str = "") -> str:
    """``ranks`` is the body of a CTE r(rank), a row for each eligible query."""
    return B.with_ctes(names, "").rstrip() + f"{more}, r AS ({ranks}) SELECT k, count(*) FILTER (WHERE rank <= k) AS hits, count(*) AS total, round(coalesce(count(*) FILTER (WHERE rank <= k) / nullif(count(*), 0)::DOUBLE, 0), 6) AS recall{extra} FROM r, {ks} GROUP BY k"


@query(B.with_ctes("vec", "SELECT crop_id, round(list_sum(u), 6) AS total, round(sqrt(list_inner_product(u, u)), 6) AS norm FROM (SELECT crop_id, " + B.unit("v") + " AS u FROM vec)"))
def l2_normalize(spark, sf_dir):
    c = B.crops(spark, sf_dir).withColumn("u", C.l2_normalize(F.col("v")))
    return c.select("crop_id", F.round(C.total(F.col("u")), 6).alias("total"), F.round(C.norm(F.col("u")), 6).alias("norm"))


@query(B.with_ctes("vec", f"SELECT a.page_id AS page_a, b.page_id AS page_b, count(*) AS pairs, round(avg({DOT}(a.v, b.v)), 6) AS mean, round(max({DOT}(a.v, b.v)), 6) AS top FROM vec a, vec b WHERE a.crop_id <> b.crop_id GROUP BY 1, 2"))
def pairwise_cosine(spark, sf_dir):
    """All pairs, rolled up by their pages."""
    c = B.crops(spark, sf_dir).select(F.col("crop_id").alias("id"), F.col("page_id").alias("g"), "v")
    return vectors.pairwise_by_group(c).select(F.col("g_a").alias("page_a"), F.col("g_b").alias("page_b"), "pairs", F.round("mean", 6).alias("mean"), F.round("top", 6).alias("top"))


NEAR = f"near AS (SELECT q, id, sim, rank FROM (SELECT a.crop_id AS q, b.crop_id AS id, round({DOT}(a.v, b.v), 9) AS sim, row_number() OVER (PARTITION BY a.crop_id ORDER BY round({DOT}(a.v, b.v), 9) DESC, b.crop_id) AS rank FROM vec a, vec b WHERE a.crop_id <> b.crop_id) WHERE rank <= 20)"


@query(B.with_ctes("vec", "").rstrip() + f", {NEAR} SELECT q, id, sim, rank FROM near WHERE rank <= 10")
def topk_neighbours(spark, sf_dir):
    items = B.crops(spark, sf_dir).select(F.col("crop_id").alias("id"), "v")
    return vectors.topk(items, items, 10).select("q", "id", "sim", F.col("rank").cast("long").alias("rank"))


@query(recall_sql("vec", "SELECT min(n.rank) FILTER (WHERE b.page_id = a.page_id) AS rank FROM vec a LEFT JOIN near n ON n.q = a.crop_id LEFT JOIN vec b ON b.crop_id = n.id WHERE a.page_id IN (SELECT page_id FROM vec GROUP BY 1 HAVING count(*) > 1) GROUP BY a.crop_id", more=f", {NEAR}"))
def recall_items(spark, sf_dir):
    return retrieval.recall_items(B.crops(spark, sf_dir))


SANITY = f"SELECT avg(s) FILTER (WHERE same) AS a, avg(s) FILTER (WHERE NOT same) AS b FROM (SELECT {DOT}(x.v, y.v) AS s, x.page_id = y.page_id AS same FROM {{t}} x, {{t}} y WHERE x.crop_id <> y.crop_id)"


@query(B.with_ctes("vec", f"SELECT round(a, 6) AS same_mean, round(b, 6) AS diff_mean, round(coalesce(a - b, 0), 6) AS gap FROM ({SANITY.format(t='vec')})"))
def sim_sanity(spark, sf_dir):
    return retrieval.sim_sanity(B.crops(spark, sf_dir))


@query(recall_sql("vec", "SELECT min(n.rank) FILTER (WHERE b.page_id = a.page_id) AS rank FROM vec a LEFT JOIN near n ON n.q = a.crop_id LEFT JOIN vec b ON b.crop_id = n.id WHERE a.page_id IN (SELECT page_id FROM vec GROUP BY 1 HAVING count(*) > 1) GROUP BY a.crop_id", more=f", {NEAR}").replace(" SELECT k, count(*)", ", k AS (SELECT k, count(*)") + f"""),
steps AS (SELECT recall, lag(recall) OVER (ORDER BY k) AS before FROM k)
SELECT (SELECT count(*) FROM vec) AS crops, (SELECT count(DISTINCT page_id) FROM vec) AS pages, round(a, 6) AS same_mean, round(b, 6) AS diff_mean, round(coalesce(a - b, 0), 6) AS gap, (SELECT bool_and(before IS NULL OR recall + 1e-6::DOUBLE >= before) FROM steps) AS monotonic FROM ({SANITY.format(t='vec')})""")
def item_report(spark, sf_dir):
    return retrieval.item_report(B.crops(spark, sf_dir))


SUMS = "sums AS (SELECT page_id, list(s ORDER BY i) AS s, any_value(n) AS n FROM (SELECT page_id, i, sum(x) AS s, count(*) AS n FROM (SELECT page_id, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM vec) GROUP BY page_id, i) GROUP BY page_id)"
GALLERY = f"{SUMS}, gal AS (SELECT page_id, n, s, {B.unit('s')} AS g FROM sums)"


@query(B.with_ctes("vec", "").rstrip() + f", {GALLERY} SELECT page_id, i, round(x, 6) AS value FROM (SELECT page_id, unnest(g) AS x, generate_subscripts(g, 1) AS i FROM gal)")
def group_gallery(spark, sf_dir):
    return retrieval.group_gallery(B.crops(spark, sf_dir)).select("page_id", F.posexplode("g").alias("i", "x")).select("page_id", (F.col("i") + 1).cast("long").alias("i"), F.round("x", 6).alias("value"))


OWN = B.unit("list_transform(list_zip(g.s, c.v), lambda z: z[1] - z[2])")
LOO = f"""{GALLERY},
minus AS (SELECT c.crop_id, c.page_id, c.v, g.n, list_transform(list_zip(g.s, c.v), lambda z: z[1] - z[2]) AS m FROM vec c JOIN gal g ON c.page_id = g.page_id WHERE g.n > 1),
loo AS (SELECT crop_id, page_id, v, {DOT}(v, m) / sqrt(greatest({DOT}(m, m), 1e-24::DOUBLE)) AS own FROM minus),
cells AS (SELECT l.crop_id, l.page_id, l.own, g.page_id AS other, {DOT}(l.v, g.g) AS s FROM loo l, gal g WHERE g.page_id <> l.page_id)"""


@query(recall_sql("vec", "SELECT 1 + count(*) FILTER (WHERE round(c.s, 9) > round(l.own, 9) OR (round(c.s, 9) = round(l.own, 9) AND c.other < l.page_id)) AS rank FROM loo l LEFT JOIN cells c ON l.crop_id = c.crop_id GROUP BY l.crop_id", more=f", {LOO}"))
def recall_loo_groups(spark, sf_dir):
    return retrieval.recall_loo_groups(B.crops(spark, sf_dir))


@query(B.with_ctes("vec", "").rstrip() + f", {LOO}, per AS (SELECT l.crop_id, any_value(l.own) AS own, sum(c.s) / greatest(1, count(c.s)) AS other FROM loo l LEFT JOIN cells c ON l.crop_id = c.crop_id GROUP BY l.crop_id) SELECT count(*) AS queries, round(avg(own), 6) AS own_mean, round(avg(other), 6) AS other_mean, round(avg(own) - avg(other), 6) AS gap FROM per")
def loo_sanity(spark, sf_dir):
    return retrieval.loo_sanity(B.crops(spark, sf_dir))


@query(recall_sql("vec", f"SELECT rank FROM (SELECT c.crop_id, c.page_id, g.page_id AS p, row_number() OVER (PARTITION BY c.crop_id ORDER BY round({DOT}(c.v, g.g), 9) DESC, g.page_id) AS rank FROM vec c, gal g) WHERE p = page_id", more=f", {GALLERY}"))
def recall_group_mean(spark, sf_dir):
    return retrieval.recall_group_mean(B.crops(spark, sf_dir))


def triplet_sql(names: str, q: str, pool: str, micro: bool = False) -> str:
    mean = (lambda r: f"sum({r}_sum) / sum({r}_n)") if micro else (lambda r: f"avg({r}_avg)")
    aggregates = ", ".join(f"avg(sim) FILTER (WHERE role = '{r}') AS {r}_avg, sum(sim) FILTER (WHERE role = '{r}') AS {r}_sum, count(*) FILTER (WHERE role = '{r}') AS {r}_n" for r in ("pos", "neg"))
    return B.with_ctes(names, "").rstrip() + f""",
scored AS (SELECT anchor, role, sim, row_number() OVER (PARTITION BY anchor ORDER BY sim DESC, member) AS rank FROM (SELECT t.anchor, t.role, t.member, round({DOT}(a.v, b.v), 9) AS sim FROM trip t JOIN {q} a ON t.anchor = a.crop_id JOIN {pool} b ON t.member = b.crop_id)),
per AS (SELECT anchor, min(rank) FILTER (WHERE role = 'pos') AS rank, {aggregates} FROM scored GROUP BY anchor HAVING count(*) FILTER (WHERE role = 'pos') > 0 AND count(*) FILTER (WHERE role = 'neg') > 0)
SELECT k, count(*) FILTER (WHERE rank <= k) AS hits, count(*) AS total, round(count(*) FILTER (WHERE rank <= k) / count(*)::DOUBLE, 6) AS recall, round({mean("pos")}, 6) AS pos_mean, round({mean("neg")}, 6) AS neg_mean FROM per, {KS2} GROUP BY k"""


@query(triplet_sql("vec trip", "vec", "vec"))
def triplet_recall(spark, sf_dir):
    c = B.crops(spark, sf_dir)
    return retrieval.triplet_recall(B.triplets(spark, sf_dir), c, c)


@query(triplet_sql("vec trip", "there", "there").replace(",\nscored AS", ",\nthere AS (SELECT * FROM vec WHERE v[1] >= -0.1::DOUBLE),\nscored AS", 1).replace("\nSELECT k, count(*)", ",\nfound AS (SELECT k, count(*)") + """),
steps AS (SELECT recall, lag(recall) OVER (ORDER BY k) AS before FROM found),
asked AS (SELECT count(DISTINCT anchor) AS anchors, count(*) AS pool FROM trip)
SELECT anchors, pool, max(total) AS valid, anchors - max(total) AS skipped, max(pos_mean) AS pos_mean, max(neg_mean) AS neg_mean, round(coalesce(max(pos_mean) - max(neg_mean), 0), 6) AS gap, (SELECT bool_and(before IS NULL OR recall + 1e-6::DOUBLE >= before) FROM steps) AS monotonic FROM found, asked GROUP BY anchors, pool""")
def triplet_report(spark, sf_dir):
    """A triplet evaluation where some members don't exist: anchors, pool, skipped ones, means."""
    there = B.crops(spark, sf_dir).where(F.col("v")[0] >= -0.1)
    return retrieval.triplet_report(B.triplets(spark, sf_dir), there, there)


@query(triplet_sql("vec trip", "vec", "vec", micro=True))
def triplet_recall_micro(spark, sf_dir):
    c = B.crops(spark, sf_dir)
    return retrieval.triplet_recall(B.triplets(spark, sf_dir), c, c, micro=True)


@query(triplet_sql("vec vec2 trip", "vec", "vec2"))
def triplet_recall_cross(spark, sf_dir):
    return retrieval.triplet_recall(B.triplets(spark, sf_dir), B.crops(spark, sf_dir), B.masked(spark, sf_dir))


@query(f"SELECT a.k, a.recall AS original, b.recall AS perturbed, round(b.recall - a.recall, 6) AS delta FROM ({triplet_sql('vec trip', 'vec', 'vec')}) a JOIN ({triplet_sql('vec vec2 trip', 'vec2', 'vec2')}) b ON a.k = b.k")
def triplet_recall_delta(spark, sf_dir):
    return retrieval.triplet_recall_delta(B.triplets(spark, sf_dir), B.crops(spark, sf_dir), B.masked(spark, sf_dir))


def paired_sql(names: str, a: str, b: str) -> str:
    return B.with_ctes(names, "").rstrip() + f""", cells AS (SELECT a.crop_id AS q, b.crop_id AS id, {DOT}(a.v, b.v) AS s FROM {a} a, {b} b),
r AS (SELECT q, id, row_number() OVER (PARTITION BY q ORDER BY round(s, 9) DESC, id) AS rank FROM cells),
m AS (SELECT avg(s) FILTER (WHERE q = id) AS d, avg(s) FILTER (WHERE q <> id) AS o FROM cells)
SELECT k, count(*) FILTER (WHERE rank <= k) AS hits, count(*) AS total, round(count(*) FILTER (WHERE rank <= k) / count(*)::DOUBLE, 6) AS recall, round(any_value(d), 6) AS diag_mean, round(any_value(o), 6) AS off_mean, round(any_value(d) - any_value(o), 6) AS gap
FROM r, m, {KS} WHERE q = id GROUP BY k"""


@query(paired_sql("vec vec2", "vec", "vec2"))
def recall_paired(spark, sf_dir):
    return retrieval.recall_paired(B.crops(spark, sf_dir), B.masked(spark, sf_dir))


LATE = f"""
best AS (SELECT a.crop_id AS q, a.page_id AS q_page, a.token_id AS tok, b.page_id AS page_id, max({DOT}(a.t, b.t)) AS best FROM tok a, tok b WHERE a.crop_id <> b.crop_id GROUP BY ALL),
late AS (SELECT q, q_page, page_id, sum(best) AS score FROM best WHERE q_page IN (SELECT page_id FROM vec GROUP BY 1 HAVING count(*) > 1) GROUP BY ALL)"""


@query(recall_sql("vec tok", "SELECT 1 + count(*) FILTER (WHERE l.page_id <> l.q_page AND (round(l.score, 9) > round(m.score, 9) OR (round(l.score, 9) = round(m.score, 9) AND l.page_id < l.q_page))) AS rank FROM late l JOIN late m ON l.q = m.q AND m.page_id = m.q_page GROUP BY l.q", ks=KS2, more="," + LATE))
def late_interaction(spark, sf_dir):
    return retrieval.late_interaction(B.tokens(spark, sf_dir))


@query(B.with_ctes("vec tok", "").rstrip() + "," + LATE + " SELECT round(avg(score) FILTER (WHERE page_id = q_page), 6) AS own_mean, round(avg(score) FILTER (WHERE page_id <> q_page), 6) AS other_mean, round(avg(score) FILTER (WHERE page_id = q_page) - avg(score) FILTER (WHERE page_id <> q_page), 6) AS gap FROM late")
def late_sanity(spark, sf_dir):
    return retrieval.late_sanity(B.tokens(spark, sf_dir))


PARTS = {"token": (1, 16), "vlad": (17, 48), "whole": (1, 64)}


@query(B.with_ctes("vec", " UNION ALL ".join(f"SELECT '{n}' AS part, round(a, 6) AS same_mean, round(b, 6) AS diff_mean FROM ({SANITY.format(t=f'(SELECT crop_id, page_id, v[{s}:{s + m - 1}] AS v FROM vec)')})" for n, (s, m) in PARTS.items())))
def sim_decompose(spark, sf_dir):
    return retrieval.sim_decompose(B.crops(spark, sf_dir), PARTS)


@query(B.with_ctes("vec tok trip", "").rstrip() + f""",
pair AS (SELECT anchor AS pair, min(member) FILTER (WHERE role = 'pos') AS p, min(member) FILTER (WHERE role = 'neg') AS n FROM trip GROUP BY anchor HAVING p IS NOT NULL AND n IS NOT NULL),
s AS (SELECT x.pair, a.token_id AS patch, b.token_id AS o, b.crop_id = x.p AS pos, round({DOT}(a.t, b.t), 9) AS s FROM pair x JOIN tok a ON a.crop_id = x.pair JOIN tok b ON b.crop_id = x.p OR b.crop_id = x.n),
m AS (SELECT pair, patch, arg_max(o, s * 1000000 - o * 1e-7::DOUBLE) FILTER (WHERE pos) AS pos_patch, max(s) FILTER (WHERE pos) AS pos_sim, arg_min(o, s * 1000000 + o * 1e-7::DOUBLE) FILTER (WHERE NOT pos) AS neg_patch, min(s) FILTER (WHERE NOT pos) AS neg_sim FROM s GROUP BY pair, patch)
SELECT pair, patch, pos_patch, neg_patch, round(pos_sim, 6) AS pos_sim, round(neg_sim, 6) AS neg_sim, patch // 4 AS box_row, patch % 4 AS box_col FROM (SELECT *, row_number() OVER (PARTITION BY pair ORDER BY pos_sim DESC, patch) AS r FROM m) WHERE r <= 3""")
def patch_match(spark, sf_dir):
    t = B.triplets(spark, sf_dir)
    pick = lambda r: F.min(F.when(F.col("role") == r, F.col("member")))
    pair = t.groupBy(F.col("anchor").alias("pair")).agg(pick("pos").alias("p"), pick("neg").alias("n")).where("p is not null and n is not null")
    tok = B.tokens(spark, sf_dir).select("crop_id", F.col("token_id").alias("patch"), "t")
    side = lambda c: pair.select("pair", F.col(c).alias("crop_id")).join(tok, "crop_id").select("pair", "patch", "t")
    return retrieval.patch_match(pair.select("pair", F.col("pair").alias("crop_id")).join(tok, "crop_id").select("pair", "patch", "t"), side("p"), side("n"), 3, 4)


@query(B.with_ctes("vec tok", "").rstrip() + f", s AS (SELECT crop_id, list(x ORDER BY i) AS s FROM (SELECT crop_id, i, sum(x) AS x FROM (SELECT crop_id, unnest(t) AS x, generate_subscripts(t, 1) AS i FROM tok WHERE token_id < 6) GROUP BY crop_id, i) GROUP BY crop_id) SELECT crop_id, i, round(x, 6) AS value FROM (SELECT crop_id, unnest(g) AS x, generate_subscripts(g, 1) AS i FROM (SELECT crop_id, {B.unit('s')} AS g FROM s))")
def mean_pool(spark, sf_dir):
    return retrieval.mean_pool(B.tokens(spark, sf_dir), F.col("token_id") < 6).select("crop_id", F.posexplode("g").alias("i", "x")).select("crop_id", (F.col("i") + 1).cast("long").alias("i"), F.round("x", 6).alias("value"))


@query(B.with_ctes("vec vecb", f"SELECT crop_id, len(u) AS dims, round(list_sum(u), 6) AS total FROM (SELECT crop_id, {B.unit('w')} AS u FROM (SELECT a.crop_id, list_concat(a.v, b.v) AS w FROM vec a JOIN vecb b ON a.crop_id = b.crop_id))"))
def concat_features(spark, sf_dir):
    return retrieval.concat_features(B.crops(spark, sf_dir), B.encoder_b(spark, sf_dir), "crop_id").select("crop_id", F.size("v").cast("long").alias("dims"), F.round(C.total(F.col("v")), 6).alias("total"))


PAIRS = f"""pairs AS (SELECT x.batch_id, x.slot AS a, y.slot AS b, x.page_id = y.page_id AS same, {DOT}(p.v, q.v) AS s
FROM batch x JOIN batch y ON x.batch_id = y.batch_id AND x.slot <> y.slot JOIN vec p ON p.crop_id = x.crop_id JOIN vec q ON q.crop_id = y.crop_id)"""
HEAD = B.with_ctes("vec", "").rstrip() + "," + BATCH + ", " + PAIRS
STATS = """stats AS (SELECT p.batch_id, round(count(*) FILTER (WHERE same) / count(DISTINCT a)::DOUBLE, 6) AS positives, round(count(*) FILTER (WHERE NOT same) / count(DISTINCT a)::DOUBLE, 6) AS negatives,
 round(avg(s) FILTER (WHERE same), 6) AS pos_mean, round(avg(s) FILTER (WHERE NOT same), 6) AS neg_mean,
 round(count(*) FILTER (WHERE NOT same AND round(s, 9) > round(lim, 9)) / nullif(count(*) FILTER (WHERE NOT same), 0)::DOUBLE, 6) AS hard_fraction
FROM pairs p JOIN (SELECT batch_id, coalesce(avg(s) FILTER (WHERE same), 0) AS lim FROM pairs GROUP BY 1) t ON p.batch_id = t.batch_id GROUP BY p.batch_id)"""


@query(HEAD + ", " + STATS + " SELECT * FROM stats")
def batch_stats(spark, sf_dir):
    return contrastive.batch_stats(B.batches(spark, sf_dir))


@query(HEAD + ", " + STATS + " SELECT count(*) AS batches, " + ", ".join(f"round(avg({c}), 6) AS {c}" for c in ("positives", "negatives", "pos_mean", "neg_mean", "hard_fraction")) + " FROM stats")
def batch_stats_mean(spark, sf_dir):
    return contrastive.batch_stats_mean(contrastive.batch_stats(B.batches(spark, sf_dir)))


@query(HEAD + """, lse AS (SELECT batch_id, a, m + ln(sum(exp(z - m))) AS lse FROM (SELECT batch_id, a, s / 0.07::DOUBLE AS z, max(s / 0.07::DOUBLE) OVER (PARTITION BY batch_id, a) AS m FROM pairs WHERE NOT same) GROUP BY batch_id, a, m),
per AS (SELECT p.batch_id, p.a, avg(greatest(d, 0) + ln(1 + exp(-abs(d)))) AS l FROM (SELECT p.batch_id, p.a, l.lse - p.s / 0.07::DOUBLE AS d FROM pairs p JOIN lse l ON p.batch_id = l.batch_id AND p.a = l.a WHERE same) p GROUP BY 1, 2)
SELECT b.batch_id, round(coalesce(avg(l), 0), 6) AS loss FROM (SELECT DISTINCT batch_id FROM batch) b LEFT JOIN per ON b.batch_id = per.batch_id GROUP BY b.batch_id""")
def loss_infonce(spark, sf_dir):
    return contrastive.build_loss("infonce")(B.batches(spark, sf_dir))


@query(HEAD + """, mined AS (SELECT *, max(s) FILTER (WHERE NOT same) OVER (PARTITION BY batch_id, a) AS mn, min(s) FILTER (WHERE same) OVER (PARTITION BY batch_id, a) AS mp FROM pairs),
per AS (SELECT batch_id, a, sum(exp(-2 * (s - 0.5::DOUBLE))) FILTER (WHERE same AND round(s, 9) < round(mn + 0.1::DOUBLE, 9)) AS p, sum(exp(50 * (s - 0.5::DOUBLE))) FILTER (WHERE NOT same AND round(s, 9) > round(mp - 0.1::DOUBLE, 9)) AS n FROM mined GROUP BY 1, 2)
SELECT b.batch_id, round(coalesce(avg(ln(1 + p) / 2 + ln(1 + n) / 50), 0), 6) AS loss FROM (SELECT DISTINCT batch_id FROM batch) b LEFT JOIN (SELECT * FROM per WHERE p IS NOT NULL AND n IS NOT NULL) per ON b.batch_id = per.batch_id GROUP BY b.batch_id""")
def loss_multisim(spark, sf_dir):
    return contrastive.build_loss("multisim")(B.batches(spark, sf_dir))


@query(HEAD + """, per AS (SELECT batch_id, a, min(s) FILTER (WHERE same) AS p, max(s) FILTER (WHERE NOT same) AS n FROM pairs GROUP BY 1, 2)
SELECT b.batch_id, round(coalesce(avg(greatest(0, (1 - p) - (1 - n) + 0.2::DOUBLE)), 0), 6) AS loss FROM (SELECT DISTINCT batch_id FROM batch) b LEFT JOIN (SELECT * FROM per WHERE p IS NOT NULL AND n IS NOT NULL) per ON b.batch_id = per.batch_id GROUP BY b.batch_id""")
def loss_triplet(spark, sf_dir):
    return contrastive.build_loss("triplet")(B.batches(spark, sf_dir))


@query(B.with_ctes("vec vec2", "").rstrip() + "," + BATCH + f""", z AS (SELECT x.batch_id, x.slot AS i, y.slot AS j, {DOT}(p.v, q.v) / 0.07::DOUBLE AS z FROM batch x JOIN batch y ON x.batch_id = y.batch_id JOIN vec p ON p.crop_id = x.crop_id JOIN vec2 q ON q.crop_id = y.crop_id),
l AS (SELECT batch_id, i, j, z, ln(sum(exp(z)) OVER (PARTITION BY batch_id, i)) AS r, ln(sum(exp(z)) OVER (PARTITION BY batch_id, j)) AS c FROM z)
SELECT batch_id, round(avg((r + c) / 2 - z), 6) AS loss FROM l WHERE i = j GROUP BY batch_id""")
def loss_paired(spark, sf_dir):
    from embedlens.operators.sampling import batch_table

    members = batch_table(B.crops(spark, sf_dir), "page_id", "crop_id", 6, 2, "bat")
    view = lambda c: members.join(c.select("crop_id", "v"), "crop_id").select("batch_id", F.col("slot").alias("id"), "v")
    return contrastive.loss_paired(view(B.crops(spark, sf_dir)), view(B.masked(spark, sf_dir)))


@query(HEAD + ", best AS (SELECT batch_id, a, same, row_number() OVER (PARTITION BY batch_id, a ORDER BY round(s, 9) DESC, b) AS r FROM pairs) SELECT batch_id, count(*) FILTER (WHERE same) AS hits, count(*) AS total, round(count(*) FILTER (WHERE same) / count(*)::DOUBLE, 6) AS accuracy FROM best WHERE r = 1 GROUP BY batch_id")
def top1_accuracy(spark, sf_dir):
    return contrastive.top1_accuracy(B.batches(spark, sf_dir))
