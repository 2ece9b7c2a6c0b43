"""Queries of sources, preparation, sampling and tiling."""

from __future__ import annotations

from pyspark.sql import functions as F

from embedlens.functions import columns as C
from embedlens.functions import tables
from embedlens.functions.encode import encode_by_name
from embedlens.functions.encode import hash_encode as _hash_encode
from embedlens.operators import patches, sampling, tiling
from embedlens.plans import bindings as B
from embedlens.plans.registry import query
from embedlens.sources import cache, merkle
from embedlens.sources import manifest as M
from embedlens.sources.shared import shared_folder, spread

DOC = "doc AS (SELECT doc_id AS idx, doc_id::VARCHAR AS docid, source AS title, lang, text, n_chars FROM documents)"
MANIFEST_COLUMNS = "idx, docid, title, text_path, image_path, image_sha256"


def docs(spark, sf_dir):
    return B.table(spark, sf_dir, "documents")


def folder(spark, name: str) -> str:
    return shared_folder(spark, name)


def manifest(spark, sf_dir):
    d = docs(spark, sf_dir)
    return d.select(F.col("doc_id").alias("idx"), F.col("doc_id").cast("string").alias("docid"), F.col("source").alias("title"), C.blob_path(F.col("doc_id"), "texts", "txt").alias("text_path"), C.blob_path(F.col("doc_id")).alias("image_path"), F.sha2(F.col("text").cast("binary"), 256).alias("image_sha256"))


def path_sql(kind: str, suffix: str, idx: str = "doc_id") -> str:
    return f"printf('{kind}/%02d/%07d.{suffix}', ({idx} // 1000)::BIGINT, {idx})"


MANIFEST_SQL = f"SELECT doc_id AS idx, doc_id::VARCHAR AS docid, source AS title, {path_sql('texts', 'txt')} AS text_path, {path_sql('blobs', 'png')} AS image_path, sha256(text) AS image_sha256 FROM documents"


@query(MANIFEST_SQL)
def manifest_scan(spark, sf_dir):
    """The documents written as nested manifest documents, one a source, and read again."""
    path = folder(spark, "manifest")
    m = manifest(spark, sf_dir)
    nested = m.groupBy(F.pmod(F.xxhash64("idx"), F.greatest(F.lit(1), F.lit(16))).alias("part")).agg(F.collect_list(F.struct(*m.columns)).alias("rows"))
    nested.select(F.lit("documents").alias("dataset"), F.lit("1").alias("hf_revision"), F.lit("").alias("prefetched_at"), F.size("rows").cast("long").alias("num_rows"), "rows").write.json(path)
    return spark.read.schema(M.MANIFEST).json(path).selectExpr("inline(rows)").select(*M.ROW.names)


@query("SELECT event_id, user_id, value FROM events")
def jsonl_scan(spark, sf_dir):
    path = folder(spark, "jsonl")
    e = B.table(spark, sf_dir, "events").select("event_id", "user_id", "value")
    e.write.json(path)
    return M.jsonl_scan(spark, path, e.schema)


@query("SELECT title, idx, lang FROM (SELECT source AS title, doc_id AS idx, lang, row_number() OVER (PARTITION BY source ORDER BY doc_id DESC) AS r FROM documents) WHERE r = 1")
def metadata_latest(spark, sf_dir):
    return M.latest_by_key(docs(spark, sf_dir).select(F.col("source").alias("title"), F.col("doc_id").alias("idx"), "lang"), "title", F.col("idx"))


@query("SELECT page_id AS idx, strlen(html)::BIGINT AS length, sha256(html) AS digest FROM pages")
def blob_scan(spark, sf_dir):
    """Pages as numbered blobs: rows of a table take the place of files, as any store holds them."""
    p = B.table(spark, sf_dir, "pages").select(F.col("page_id").alias("idx"), F.col("html").cast("binary").alias("content"))
    return p.select("idx", F.octet_length("content").cast("long").alias("length"), F.sha2("content", 256).alias("digest"))


@query("SELECT source, rows, (sum(rows) OVER (ORDER BY source) - rows)::BIGINT AS start, (sum(rows) OVER (ORDER BY source))::BIGINT AS stop FROM (SELECT source, count(*) AS rows FROM documents GROUP BY source)")
def shard_offsets(spark, sf_dir):
    return M.shard_offsets(docs(spark, sf_dir), "source")


@query("SELECT doc_id, lang, n_chars FROM documents WHERE doc_id >= (SELECT max(doc_id) // 4 FROM documents) AND doc_id < (SELECT max(doc_id) // 2 FROM documents)")
def row_range(spark, sf_dir):
    d = docs(spark, sf_dir)
    top = d.agg(F.max("doc_id")).first()[0]
    return M.row_range(d.select("doc_id", "lang", "n_chars"), "doc_id", top // 4, top // 2)


@query("SELECT source, doc_id, (row_number() OVER (ORDER BY source, doc_id) - 1) AS idx FROM documents")
def reindex_shard(spark, sf_dir):
    return M.reindex_shard(docs(spark, sf_dir).select("source", "doc_id"), "source", "doc_id")


@query("SELECT doc_id, n_chars FROM documents WHERE n_chars >= 200 ORDER BY doc_id LIMIT 100")
def quota_take(spark, sf_dir):
    return M.quota_take(docs(spark, sf_dir).select("doc_id", "n_chars"), "doc_id", F.col("n_chars") >= 200, 100)


@query("""
SELECT source, requested, written, failed, bytes, CASE WHEN had = requested THEN 'already_complete' WHEN failed = 0 THEN 'complete' ELSE 'partial' END AS status
FROM (SELECT d.source, count(*) AS requested, count(*) FILTER (WHERE n_chars >= 200) AS written, count(*) FILTER (WHERE NOT n_chars >= 200) AS failed,
             coalesce(sum(n_chars) FILTER (WHERE n_chars >= 200), 0)::BIGINT AS bytes, count(*) FILTER (WHERE l.doc_id IS NOT NULL) AS had
      FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON d.doc_id = l.doc_id GROUP BY d.source)
""")
def load_summary(spark, sf_dir):
    had = B.table(spark, sf_dir, "labels").select("doc_id", F.lit(True).alias("had")).distinct()
    d = docs(spark, sf_dir).select("doc_id", "source", "n_chars").join(had, "doc_id", "left")
    return M.load_summary(d, "source", F.col("n_chars") >= 200, F.col("n_chars"), F.col("had").isNotNull())


@query("SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def resume_antijoin(spark, sf_dir):
    return M.resume(docs(spark, sf_dir).select("doc_id", "source"), B.table(spark, sf_dir, "labels"), "doc_id")


@query("SELECT d.doc_id AS idx, coalesce('toxic' || l.toxic::VARCHAR, d.lang) AS value FROM documents d LEFT JOIN (SELECT doc_id, max(toxic) AS toxic FROM labels GROUP BY doc_id) l ON d.doc_id = l.doc_id")
def merge_shards(spark, sf_dir):
    d = docs(spark, sf_dir).select(F.col("doc_id").alias("idx"), F.col("lang").alias("value"))
    ids = d.select("idx")
    labels = B.table(spark, sf_dir, "labels").groupBy(F.col("doc_id").alias("idx")).agg(F.max("toxic").alias("t"))
    old = labels.select("idx", F.lit("older").alias("value"))
    new = labels.select("idx", F.concat(F.lit("toxic"), F.col("t").cast("string")).alias("value"))
    return M.merge_shards(d, [old.join(ids, "idx", "left_semi"), new.join(ids, "idx", "left_semi")], "idx")


@query(MANIFEST_SQL)
def manifest_write(spark, sf_dir):
    m = manifest(spark, sf_dir)
    path = folder(spark, "corpus")
    M.manifest_write(m, path, "v1", "idx", dataset="documents")
    return M.manifest_read(spark, path, "v1", "idx", m.schema)


DIGEST = "sha256(to_json({'doc_id': doc_id, 'source': source, 'lang': lang, 'text_sha256': sha256(text)}))"


def digested():
    return F.col("doc_id"), F.col("source"), F.col("lang"), F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256")


@query(f"SELECT doc_id, {DIGEST} AS digest FROM documents")
def row_digest(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", M.row_digest(*digested()).alias("digest"))


@query(f"""
WITH r AS (SELECT doc_id, {DIGEST} AS d FROM documents),
b AS (SELECT doc_id // 1000 AS bucket, sha256(string_agg(d, '' ORDER BY doc_id)) AS d, count(*) AS n FROM r GROUP BY 1),
t AS (SELECT bucket // 1000 AS top, sha256(string_agg(d, '' ORDER BY bucket)) AS d, sum(n) AS n FROM b GROUP BY 1)
SELECT sha256(string_agg(d, '' ORDER BY top)) AS fingerprint, sum(n)::BIGINT AS num_rows FROM t
""")
def corpus_fingerprint(spark, sf_dir):
    return M.corpus_fingerprint(row_digest(spark, sf_dir), "doc_id", "digest")


MERKLE = f"""
WITH r AS (SELECT doc_id, {DIGEST} AS d FROM documents),
b AS (SELECT 0 AS level, doc_id // 100 AS node, sha256(string_agg(d, '' ORDER BY doc_id)) AS digest, count(*) AS rows FROM r GROUP BY 2),
t AS (SELECT 1 AS level, node // 100 AS node, sha256(string_agg(digest, '' ORDER BY node)) AS digest, sum(rows)::BIGINT AS rows FROM b GROUP BY 2),
u AS (SELECT 2 AS level, node // 100 AS node, sha256(string_agg(digest, '' ORDER BY node)) AS digest, sum(rows)::BIGINT AS rows FROM t WHERE (SELECT max(node) FROM t) > 0 GROUP BY 2)
SELECT * FROM b UNION ALL SELECT * FROM t WHERE (SELECT max(node) FROM b) > 0 UNION ALL SELECT * FROM u
"""


@query(MERKLE)
def merkle_tree(spark, sf_dir):
    """The stored tree over all documents, a hundred a node."""
    return merkle.tree(merkle.leaves(docs(spark, sf_dir), "doc_id", *digested()), size=100)


@query("SELECT d.doc_id AS idx, l.toxic = 1 AS altered FROM documents d JOIN (SELECT doc_id, max(toxic) AS toxic FROM labels GROUP BY doc_id) l ON d.doc_id = l.doc_id WHERE d.doc_id % 3 = 0 AND (l.toxic = 1 OR d.lang = 'de')")
def merkle_diff(spark, sf_dir):
    """A copy in which some labelled documents have an empty source for null, and others are gone, compared by its tree."""
    d = docs(spark, sf_dir).withColumn("source", F.lit(None).cast("string"))
    toxic = B.table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    hit = F.col("toxic").isNotNull() & (F.col("doc_id") % 3 == 0)
    copy = d.join(toxic, "doc_id", "left").where(~F.coalesce(hit & (F.col("toxic") != 1) & (F.col("lang") == "de"), F.lit(False)))
    copy = copy.withColumn("source", F.when(hit & (F.col("toxic") == 1), F.lit("")).otherwise(F.col("source"))).drop("toxic")
    a, b = (merkle.tree(merkle.leaves(x, "doc_id"), size=100) for x in (d, copy))
    found = merkle.changed_rows(d, copy, "doc_id", a, b, size=100)
    return found.select("idx", F.col("right").isNotNull().alias("altered"))


@query("SELECT d.doc_id, sha256(d.text) AS stored, sha256(CASE WHEN l.toxic = 1 THEN d.text || '!' ELSE d.text END) AS actual FROM documents d JOIN (SELECT doc_id, max(toxic) AS toxic FROM labels GROUP BY doc_id) l ON d.doc_id = l.doc_id WHERE l.toxic = 1")
def verify_digests(spark, sf_dir):
    """Texts of toxic documents are tampered with; just these must be found."""
    d = docs(spark, sf_dir).select("doc_id", "text")
    toxic = B.table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id").distinct().withColumn("bad", F.lit(True))
    blobs = d.join(toxic, "doc_id", "left").select("doc_id", F.when(F.col("bad"), F.concat("text", F.lit("!"))).otherwise(F.col("text")).alias("text"))
    stored = d.select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("sha"))
    return M.verify_digests(blobs, stored, "doc_id", "text", "sha")


@query(B.with_ctes("vec", "SELECT crop_id, page_id, round(sqrt(list_inner_product(v, v)), 6) AS norm FROM vec"))
def descriptor_cache(spark, sf_dir):
    cached = cache.bucketed(B.crops(spark, sf_dir), "crop_id", folder(spark, "descriptors"))
    return cached.select("crop_id", "page_id", F.round(C.norm(F.col("v")), 6).alias("norm"))


@query("SELECT lang, count(*) AS n FROM documents GROUP BY lang")
def report_sink(spark, sf_dir):
    path = folder(spark, "report")
    M.report_sink(docs(spark, sf_dir).groupBy("lang").agg(F.count("*").alias("n")), path, "csv")
    return spark.read.schema("lang string, n long").csv(path, header=True)


@query(B.with_ctes("vec trip", """,
existing AS (SELECT crop_id FROM vec WHERE v[1] >= -0.1::DOUBLE)
SELECT count(*) AS triplets, count(*) FILTER (WHERE ok) AS valid, count(*) FILTER (WHERE NOT ok) AS skipped, sum(kept)::BIGINT AS members FROM (
  SELECT t.anchor, bool_or(e.crop_id IS NOT NULL AND t.role = 'pos') AND bool_or(e.crop_id IS NOT NULL AND t.role = 'neg') AND bool_or(a.crop_id IS NOT NULL) AS ok, count(e.crop_id) AS kept
  FROM trip t LEFT JOIN existing e ON t.member = e.crop_id LEFT JOIN existing a ON t.anchor = a.crop_id GROUP BY t.anchor)""").replace("\n,\nexisting", ",\nexisting"))
def triplet_validity(spark, sf_dir):
    there = B.crops(spark, sf_dir).where(F.col("v")[0] >= -0.1).select("crop_id")
    t = B.triplets(spark, sf_dir)
    e, a = there.select(F.col("crop_id").alias("member"), F.lit(True).alias("e")), there.select(F.col("crop_id").alias("anchor"), F.lit(True).alias("a"))
    j = t.join(e, "member", "left").join(a, "anchor", "left")
    has = lambda r: F.bool_or(F.coalesce(F.col("e") & (F.col("role") == r), F.lit(False)))
    per = j.groupBy("anchor").agg((has("pos") & has("neg") & F.bool_or(F.coalesce("a", F.lit(False)))).alias("ok"), F.count("e").alias("kept"))
    return per.groupBy().agg(F.count("*").alias("triplets"), F.count_if("ok").alias("valid"), F.count_if(~F.col("ok")).alias("skipped"), F.sum("kept").alias("members"))


@query(B.with_ctes("page", "SELECT page_id, replace(coalesce(title, ''), '_', ' ') AS title_text, substring(replace(coalesce(title, ''), '_', ' ') || chr(10) || coalesce(url, ''), 1, 2000) AS body_text, coalesce(title, 'untitled') AS name FROM page"))
def item_text(spark, sf_dir):
    return B.pages(spark, sf_dir).select("page_id", C.item_title(F.col("title")).alias("title_text"), C.item_body(F.col("title"), F.col("url")).alias("body_text"), C.title_or_untitled(F.col("title")).alias("name"))


WORDS = "list_filter(string_split(regexp_replace(coalesce(text, ''), '[ \\t\\n\\r\\x0b\\f]+', ' ', 'g'), ' '), lambda w: w <> '')"
STRIP = "',.;:!?\"''()[]'"


@query(f"SELECT doc_id, pos, word FROM (SELECT doc_id, pos - 1 AS pos, trim(lower(ws[pos]), {STRIP}) AS word FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS pos FROM (SELECT doc_id, {WORDS} AS ws FROM documents))) WHERE word <> ''")
def word_table(spark, sf_dir):
    return patches.word_table(spread(docs(spark, sf_dir).select("doc_id", "text")), "doc_id", "text")


@query("SELECT page_id, coalesce(nullif(substring(regexp_replace(regexp_replace(lower(url), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 32), ''), 'run') AS slug FROM pages")
def slugify(spark, sf_dir):
    return B.table(spark, sf_dir, "pages").select("page_id", C.slugify(F.col("url")).alias("slug"))


@query(f"SELECT doc_id, {path_sql('blobs', 'png')} AS path FROM documents")
def blob_path(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", C.blob_path(F.col("doc_id")).alias("path"))


@query(B.with_ctes("log", "SELECT run_id, step, round(CASE WHEN step < 10 THEN (step + 1) / 10.0::DOUBLE ELSE 0.5::DOUBLE * (1 + cos(pi() * least(1.0::DOUBLE, greatest(0.0::DOUBLE, (step - 10) / 190.0::DOUBLE)))) END, 6) AS factor FROM log"))
def lr_curve(spark, sf_dir):
    return B.metrics(spark, sf_dir).select("run_id", "step", F.round(C.warmup_cosine(F.col("step"), 10, 200), 6).alias("factor"))


@query(B.with_ctes("vec vec2", "SELECT crop_id, round(list_sum(list_transform(v, lambda x: abs(x))), 6) AS l1, round(v[10], 6) AS first_kept, round(v[9], 6) AS last_blank FROM vec2"))
def blank_top(spark, sf_dir):
    m = B.masked(spark, sf_dir)
    return m.select("crop_id", F.round(C.total(F.transform("v", lambda x: F.abs(x))), 6).alias("l1"), F.round(F.col("v")[9], 6).alias("first_kept"), F.round(F.col("v")[8], 6).alias("last_blank"))


def _deck(seed: str, key: str = "doc_id", source: str = "documents") -> str:
    return f"(SELECT {key}, row_number() OVER (ORDER BY {B.h60(seed, key)}, {key}) AS rank FROM {source})"


@query(f"SELECT doc_id, rank, CASE WHEN rank <= n // 2 THEN 'train' ELSE 'eval' END AS split FROM {_deck('split')}, (SELECT count(*) AS n FROM documents) WHERE rank <= n // 2 + n // 5")
def seeded_split(spark, sf_dir):
    d = docs(spark, sf_dir).select("doc_id")
    n = d.count()
    return sampling.seeded_split(d, "doc_id", n // 2, n // 5, "split")


@query(f"SELECT doc_id, lang FROM documents ORDER BY {B.h60('sample', 'doc_id')}, doc_id LIMIT 50")
def sample_n(spark, sf_dir):
    """A sampling operator: 50 rows are its result."""
    return sampling.sample_n(docs(spark, sf_dir).select("doc_id", "lang"), "doc_id", 50, "sample")


@query(f"SELECT doc_id, rank, CASE WHEN rank <= n // 2 THEN 'train' ELSE 'eval' END AS part FROM {_deck('deck')}, (SELECT count(*) AS n FROM documents) WHERE rank > n // 10")
def deck_slices(spark, sf_dir):
    d = docs(spark, sf_dir).select("doc_id")
    n = d.count()
    return sampling.deck_slices(d, "doc_id", [("train", n // 10, n // 2), ("eval", n // 2, n)], "deck")


K_GROUP = """
ranked AS (SELECT {g} AS g, {k} AS k, row_number() OVER (PARTITION BY {g} ORDER BY {h}, {k}) AS r FROM {t}),
sized AS (SELECT g, least(count(*), {n}) AS n FROM ranked GROUP BY g),
members AS (SELECT s.g, i::BIGINT AS slot, r.k FROM sized s, range(0, {n}) x(i), ranked r WHERE r.g = s.g AND r.r = i % s.n + 1)"""


@query("WITH" + K_GROUP.format(g="source", k="doc_id", h=B.h60("kg", "doc_id"), t="documents", n=5) + " SELECT g AS source, slot, k AS doc_id FROM members")
def k_per_group(spark, sf_dir):
    return sampling.k_per_group(docs(spark, sf_dir), "source", "doc_id", 5, "kg")


BATCH = K_GROUP.format(g="page_id", k="crop_id", h=B.h60("bat", "crop_id"), t="vec", n=6) + f""",
shuffled AS (SELECT page_id, row_number() OVER (ORDER BY {B.h60("bat-g", "page_id")}, page_id) AS r FROM (SELECT DISTINCT page_id FROM vec)),
full_ AS (SELECT (r - 1) // 2 AS batch_id FROM shuffled GROUP BY 1 HAVING count(*) = 2),
batch AS (SELECT f.batch_id, ((s.r - 1) % 2) * 6 + m.slot AS slot, s.page_id, m.k AS crop_id FROM shuffled s JOIN full_ f ON (s.r - 1) // 2 = f.batch_id JOIN members m ON m.g = s.page_id)"""


@query(B.with_ctes("vec", "").rstrip() + "," + BATCH + " SELECT batch_id, slot, page_id, crop_id FROM batch")
def batch_table(spark, sf_dir):
    return sampling.batch_table(B.crops(spark, sf_dir), "page_id", "crop_id", 6, 2, "bat")


@query(B.with_ctes("vec trip", "SELECT anchor, role, member FROM trip WHERE anchor IN (SELECT DISTINCT anchor FROM trip ORDER BY anchor LIMIT 20)"))
def triplet_cap(spark, sf_dir):
    """The cap is the feature: the first 20 triplets."""
    t = B.triplets(spark, sf_dir)
    return t.join(t.select("anchor").distinct().orderBy("anchor").limit(20), "anchor", "left_semi")


@query(f"SELECT doc_id, md5(text) AS cluster, CASE WHEN {B.h60('leak', 'md5(text)')} % 100 < 20 THEN 'eval' ELSE 'train' END AS split FROM documents")
def leakfree_split(spark, sf_dir):
    d = docs(spark, sf_dir).select("doc_id", F.md5(F.col("text").cast("binary")).alias("cluster"))
    return sampling.leakfree_split(d, "cluster", 20, "leak")


STARTS = "CASE WHEN {s} <= {z} THEN [0] ELSE list_distinct(list_concat(range(0, ({s} - {z} + 1)::BIGINT, {st}), [({s} - {z})::BIGINT])) END"


@query(f"SELECT page_id, x::BIGINT AS x, unnest({STARTS.format(s='h', z=224, st=224)})::BIGINT AS y FROM (SELECT page_id, h, unnest({STARTS.format(s='w', z=224, st=224)}) AS x FROM (SELECT page_id, 200 + length(html) % 700 AS w, 200 + length(url) * 7 AS h FROM pages))")
def tile_grid(spark, sf_dir):
    p = B.table(spark, sf_dir, "pages").select("page_id", (200 + F.length("html") % 700).alias("w"), (200 + F.length("url") * 7).alias("h"))
    return tiling.tile_grid(p, "w", "h", 224).select("page_id", F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"))


def _tile_sql(ratio: float) -> str:
    starts = STARTS.format(s="length(t)", z=500, st=500)
    good = "length(chunk) > 0 AND coalesce(length(regexp_replace(chunk, '[ \\t\\n\\r\\x0b\\f]', '', 'g')) / length(chunk)::DOUBLE, 0) >= " + f"{ratio}::DOUBLE"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
tiles AS (SELECT doc_id, start, substring(t, start + 1, 500) AS chunk FROM (SELECT doc_id, t, unnest({starts})::BIGINT AS start FROM d)),
kept AS (SELECT doc_id, start, chunk FROM tiles WHERE {good}),
centre AS (SELECT doc_id, greatest(0, floor((length(t) - 500) / 2.0))::BIGINT AS start, t FROM d WHERE doc_id NOT IN (SELECT doc_id FROM kept))
SELECT doc_id, start, md5(chunk) AS chunk FROM (SELECT * FROM kept UNION ALL SELECT doc_id, start, substring(t, start + 1, 500) FROM centre)"""


@query(_tile_sql(0.83))
def tile_text(spark, sf_dir):
    return tiling.tile_text(spread(docs(spark, sf_dir).select("doc_id", "text")), "doc_id", "text", 500, min_ratio=0.83).withColumn("chunk", F.md5(F.col("chunk").cast("binary")))


@query(_tile_sql(0.0))
def tile_text_all(spark, sf_dir):
    return tiling.tile_text(spread(docs(spark, sf_dir).select("doc_id", "text")), "doc_id", "text", 500, min_ratio=0.0).withColumn("chunk", F.md5(F.col("chunk").cast("binary")))


@query(_tile_sql(0.83))
def tile_text_lateral(spark, sf_dir):
    """The same tiles by a table function in SQL."""
    tables.register(spark)
    return spark.sql("SELECT doc_id, start, md5(chunk) AS chunk FROM {docs}, LATERAL text_tiles(text, 500, 0.0D, 0.83D)", docs=spread(docs(spark, sf_dir).select("doc_id", "text")))


@query("SELECT user_id, event_id, value, place FROM (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY value DESC NULLS LAST, event_id) AS place FROM events) WHERE place <= 3")
def first_rows(spark, sf_dir):
    """Each user's three highest events by a table function over a partitioned table."""
    tables.register(spark)
    e = B.table(spark, sf_dir, "events").select("user_id", "event_id", "value")
    return spark.sql("SELECT * FROM first_rows(TABLE(SELECT * FROM {events}) PARTITION BY user_id ORDER BY (value DESC NULLS LAST, event_id), 3)", events=e)


def page_rasters(spark, sf_dir):
    """Images 64 pixels wide drawn from the pages' bytes: as many rows as hold them all, the last one filled up with zeros."""
    p = B.table(spark, sf_dir, "pages").select("page_id", F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("b"))
    width = 64
    p = p.withColumn("height", F.greatest(F.lit(1), F.ceil(F.octet_length("b") / (width * 3))).cast("int"))
    data = F.rpad("b", F.col("height") * width * 3, F.lit(b"\0"))
    image = F.struct(F.col("page_id").cast("string").alias("origin"), "height", F.lit(width).alias("width"), F.lit(3).alias("nChannels"), F.lit(16).alias("mode"), data.alias("data"))
    return p.select(image.alias("image"))


RASTER = "ra AS (SELECT page_id, 64 AS w, greatest(1, ceil(strlen(coalesce(html, '')) / 192.0))::BIGINT AS h FROM pages)"
_TILES = "CASE WHEN {s} <= 40 THEN [0] ELSE list_distinct(list_concat(range(0, ({s} - 40 + 1)::BIGINT, 40), [({s} - 40)::BIGINT])) END"


# a page's bytes are UTF-8, so hardly any pixel is near white and every tile has ink enough
@query(f"WITH {RASTER} SELECT page_id::VARCHAR AS origin, x::INTEGER AS x, unnest({_TILES.format(s='h')})::INTEGER AS y, 768 AS bytes FROM (SELECT page_id, h, unnest({_TILES.format(s='w')}) AS x FROM ra)")
def tile_images(spark, sf_dir):
    """Tiles of every page's raster, rows of Spark's image type."""
    tiles = tiling.tile_images(page_rasters(spark, sf_dir), size=40, target=16)
    return tiles.select("origin", "x", "y", F.octet_length("pixels").alias("bytes"))


@query(f"WITH {RASTER} SELECT page_id::VARCHAR AS origin, ((w - least(w, h)) // 2)::INTEGER AS x, ((h - least(w, h)) // 2)::INTEGER AS y, 432 AS bytes FROM ra")
def centre_squares(spark, sf_dir):
    """The largest centred square of every page's raster, resized."""
    return tiling.tile_images(page_rasters(spark, sf_dir), target=12, centre_only=True).select("origin", "x", "y", F.octet_length("pixels").alias("bytes"))


# no byte of UTF-8 is 255, so the white bytes are those of the blanked rows
@query(f"WITH {RASTER} SELECT page_id::VARCHAR AS origin, h::INTEGER AS height, (round(h * 0.15::DOUBLE) * 192)::BIGINT AS white FROM ra")
def blank_images(spark, sf_dir):
    """Rasters with the leading 15 % of their rows white."""
    blank = tiling.blank_images(page_rasters(spark, sf_dir), 0.15)
    white = (F.length(F.hex("image.data")) - F.length(F.replace(F.hex("image.data"), F.lit("FF"), F.lit("")))) / 2
    return blank.select("image.origin", "image.height", white.cast("long").alias("white"))


@query("SELECT doc_id, length(rest) AS n, md5(rest) AS digest FROM (SELECT doc_id, substring(text, round(length(text) * 0.15::DOUBLE)::BIGINT + 1) AS rest FROM documents WHERE text IS NOT NULL)")
def blank_title(spark, sf_dir):
    """Texts without their leading 15 % of characters."""
    d = docs(spark, sf_dir).where("text is not null").select("doc_id", C.drop_leading(F.col("text"), 0.15).alias("rest"))
    return d.select("doc_id", F.length("rest").cast("long").alias("n"), F.md5(F.col("rest").cast("binary")).alias("digest"))


@query("SELECT count(*) FILTER (WHERE page_id % 10 <> 3) AS hashed, count(*) FILTER (WHERE page_id % 10 = 3) AS failed FROM pages")
def image_hash(spark, sf_dir):
    """Perceptual hashes of all rasters; a tenth are cut short, as broken files are, and count as failed."""
    r = page_rasters(spark, sf_dir).select("image.*")
    data = F.when(F.col("origin").cast("long") % 10 == 3, F.substring("data", 2, 1 << 30)).otherwise(F.col("data"))
    images = r.withColumn("data", data).select(F.struct(*r.columns).alias("image"))
    return tiling.image_hash(images).groupBy().agg(F.count("hash").alias("hashed"), F.count_if(F.col("hash").isNull()).alias("failed"))


@query(B.with_ctes("vec", ", m AS (SELECT i, avg(x) AS mu, stddev_pop(x) AS sd FROM (SELECT unnest(v) AS x, generate_subscripts(v, 1) AS i FROM vec) GROUP BY i) SELECT crop_id, round(sum(z), 6) AS total, round(max(z), 6) AS top FROM (SELECT crop_id, (x - mu) / sd AS z FROM (SELECT crop_id, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM vec) JOIN m USING (i)) GROUP BY crop_id").replace("\n,", ","))
def channel_normalize(spark, sf_dir):
    c = B.crops(spark, sf_dir)
    stats = c.select(F.posexplode("v").alias("i", "x")).groupBy("i").agg(F.avg("x").alias("mu"), F.stddev_pop("x").alias("sd"))
    one = stats.groupBy().agg(F.array_sort(F.collect_list(F.struct("i", "mu", "sd"))).alias("s"))  # a row for each dimension
    one = one.select(F.transform("s", lambda x: x["mu"]).alias("mu"), F.transform("s", lambda x: x["sd"]).alias("sd"))
    z = tiling.channel_normalize(F.col("v"), F.col("mu"), F.col("sd"))
    return c.crossJoin(F.broadcast(one)).withColumn("z", z).select("crop_id", F.round(C.total(F.col("z")), 6).alias("total"), F.round(F.array_max("z"), 6).alias("top"))


@query(f"""
WITH g AS (SELECT item_id, substring(t, i::BIGINT, 3) AS gram, count(*) AS c FROM (SELECT item_id, lower(text) AS t, unnest(range(1, length(text) - 1)) AS i FROM benchmark WHERE length(text) >= 3) GROUP BY ALL),
h AS (SELECT item_id, {B.h60('enc', 'gram')} AS h, c FROM g),
s AS (SELECT item_id, h % 64 AS dim, sum(CASE WHEN (h // 64) % 2 = 0 THEN c ELSE -c END)::DOUBLE AS s FROM h GROUP BY ALL)
SELECT item_id, dim, round(s / sqrt(sum(s * s) OVER (PARTITION BY item_id)), 6) AS value FROM s WHERE s <> 0""")
def hash_encode(spark, sf_dir):
    return _hash_encode(B.table(spark, sf_dir, "benchmark"), "item_id", "text").withColumn("value", F.round("value", 6))


@query("""
WITH c AS (SELECT item_id, l AS dim, length(lower(coalesce(text, ''))) - length(replace(lower(coalesce(text, '')), chr(97 + l::INTEGER), '')) AS n FROM benchmark, range(0, 26) r(l))
SELECT item_id, dim, round(n / sqrt(sum(n * n) OVER (PARTITION BY item_id))::DOUBLE, 6) AS value FROM c WHERE n > 0""")
def named_encode(spark, sf_dir):
    """An encoder chosen by name, run in batches: letter counts, L2-normalised."""
    v = encode_by_name(B.table(spark, sf_dir, "benchmark"), "item_id", "text", "letters")
    return v.select("item_id", F.posexplode("embedding").alias("dim", "value")).where("value > 0").select("item_id", F.col("dim").cast("long").alias("dim"), F.round("value", 6).alias("value"))


FILE = 100  # documents in a file


def doc_files(spark, sf_dir, name: str, *columns):
    """The documents as files of ``FILE`` ids each."""
    d = docs(spark, sf_dir).select(F.lpad(F.floor(F.col("doc_id") / FILE).cast("string"), 9, "0").alias("file"), *columns)
    path = folder(spark, name)
    return d.repartition("file").sortWithinPartitions("file", "doc_id"), path


@query(f"SELECT doc_id // {FILE} AS idx, strlen(t) AS length, sha256(t) AS digest FROM (SELECT doc_id // {FILE} * {FILE} AS doc_id, string_agg(md5(text) || chr(10), '' ORDER BY doc_id) AS t FROM documents GROUP BY 1)")
def file_blobs(spark, sf_dir):
    """Files of lines, read as blobs by path and again as whole texts; both must agree."""
    d, path = doc_files(spark, sf_dir, "blobs", "doc_id", F.md5(F.col("text").cast("binary")).alias("value"))
    d.select("file", "value").write.partitionBy("file").text(path)
    number = F.regexp_extract("path", r"file=0*(\d+)/", 1).cast("long").alias("idx")
    blobs = M.blob_scan(spark, path, "*.txt").select(number, F.col("length").cast("long").alias("length"), F.sha2("content", 256).alias("digest"))
    texts = spark.read.text(path, wholetext=True).select(F.col("file").cast("long").alias("idx"), F.sha2(F.col("value").cast("binary"), 256).alias("again"))
    return blobs.join(texts, "idx").where("digest = again").drop("again")


@query(f"SELECT file, rows, (sum(rows) OVER (ORDER BY file) - rows)::BIGINT AS start, (sum(rows) OVER (ORDER BY file))::BIGINT AS stop FROM (SELECT doc_id // {FILE} AS file, count(*) AS rows FROM documents GROUP BY 1)")
def file_inventory(spark, sf_dir):
    """Rows and offsets of every file."""
    d, path = doc_files(spark, sf_dir, "inventory", "doc_id")
    d.write.partitionBy("file").parquet(path)
    found = M.file_inventory(spark.read.parquet(path))
    return found.withColumn("file", F.regexp_extract("file", r"file=0*(\d+)/", 1).cast("long"))


@query(f"SELECT doc_id, lang FROM documents WHERE doc_id // {FILE} IN (SELECT DISTINCT doc_id // {FILE} AS f FROM documents ORDER BY f LIMIT 2 OFFSET 1)")
def file_range(spark, sf_dir):
    """The range is the feature: files number 1 and 2."""
    d, path = doc_files(spark, sf_dir, "files", "doc_id", "lang")
    d.write.partitionBy("file").parquet(path)
    return M.file_range(spark.read.parquet(path), 1, 3).select("doc_id", "lang")


@query("SELECT coalesce(lang, 'none') AS shard, count(*) AS rows FROM documents GROUP BY 1")
def archive_shards(spark, sf_dir):
    """Shards merged into a new version, then moved to the archive, where they are counted."""
    path, archive = folder(spark, "shards"), folder(spark, "archive")
    docs(spark, sf_dir).select("doc_id", F.coalesce("lang", F.lit("none")).alias("shard")).write.partitionBy("shard").parquet(path)
    M.manifest_write(spark.read.parquet(path), folder(spark, "corpus"), "v2", "doc_id")
    M.archive_shards(spark, path, archive)
    return spark.read.parquet(archive).groupBy(F.col("shard").cast("string").alias("shard")).agg(F.count("*").alias("rows"))
