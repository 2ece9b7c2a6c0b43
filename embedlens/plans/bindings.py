"""The reference relations as derived from the given tables: once for Spark, once as SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from embedlens.functions import columns as C

VIEW_FRACTION = 9 / 64


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crops(spark, sf_dir: str) -> DataFrame:
    """(crop_id, page_id, v)."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("crop_id"), F.col("label").cast("long").alias("page_id"), C.doubles("embedding").alias("v"))


def masked(spark, sf_dir: str) -> DataFrame:
    """The second view of the same crops: 9 of 64 leading components blanked."""
    return crops(spark, sf_dir).withColumn("v", C.blank_leading(F.col("v"), VIEW_FRACTION))


def encoder_b(spark, sf_dir: str) -> DataFrame:
    """A second encoder of half the dimension: components 33 to 64."""
    return crops(spark, sf_dir).withColumn("v", C.dims(F.col("v"), 33, 32))


def tokens(spark, sf_dir: str) -> DataFrame:
    """(crop_id, page_id, token_id, t): eight unit tokens of eight components."""
    cut = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.slice(F.col("v"), i * 8 + 1, F.lit(8)))
    return crops(spark, sf_dir).select("crop_id", "page_id", F.posexplode(cut).alias("token_id", "t")).withColumn("token_id", F.col("token_id").cast("long")).withColumn("t", C.l2_normalize(F.col("t")))


def triplets(spark, sf_dir: str) -> DataFrame:
    """(anchor, role, member): for every crop 3 positives of its page and 4 negatives of others, lowest hash first."""
    c = crops(spark, sf_dir).select("crop_id", "page_id").withColumn("h", C.hash60("trip", F.col("crop_id")))
    ranked = c.withColumn("r", F.row_number().over(Window.partitionBy("page_id").orderBy("h", "crop_id"))).where("r <= 4")
    anchors = c.select(F.col("crop_id").alias("anchor"), "page_id")
    few = ranked.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("r", "crop_id"))).alias("few"))  # four a page at most
    mates = F.slice(F.filter(F.transform("few", lambda x: x["crop_id"]), lambda x: x != F.col("anchor")), 1, 3)
    pos = anchors.join(few, "page_id").select("anchor", F.explode(mates).alias("member"))
    # a page has four of these at most, so the eight smallest of all hold the four smallest of others for any page
    least = [F.struct(F.lit(r.page_id).cast("long").alias("page"), F.lit(r.crop_id).cast("long").alias("crop")) for r in ranked.where("page_id is not null").orderBy("h", "crop_id").limit(8).collect()]
    if not least:
        return pos.select("anchor", F.lit("pos").alias("role"), "member")
    others = F.slice(F.transform(F.filter(F.array(*least), lambda x: x["page"] != F.col("page_id")), lambda x: x["crop"]), 1, 4)
    neg = anchors.select("anchor", F.explode(others).alias("member"))
    return pos.select("anchor", F.lit("pos").alias("role"), "member").union(neg.select("anchor", F.lit("neg"), "member"))


def metrics(spark, sf_dir: str) -> DataFrame:
    """The metrics log: (run_id, step, event_type, value)."""
    e = table(spark, sf_dir, "events")
    step = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return e.select(F.col("user_id").alias("run_id"), step.cast("long").alias("step"), "event_id", "ts", "event_type", "value")


def batches(spark, sf_dir: str, groups: int = 2, k: int = 6) -> DataFrame:
    """Contrastive batches over the crops: (batch_id, id, page_id, v)."""
    from embedlens.operators.sampling import batch_table

    members = batch_table(crops(spark, sf_dir), "page_id", "crop_id", k, groups, "bat")
    return members.join(crops(spark, sf_dir).select("crop_id", "v"), "crop_id").select("batch_id", F.col("slot").alias("id"), "page_id", "v")


def pages(spark, sf_dir: str) -> DataFrame:
    """(page_id, title, url)."""
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", F.nullif(F.regexp_extract("html", r"<title>([^<]*)</title>", 1), F.lit("")).alias("title"), "url")


H60 = "('0x' || substr(md5({0}), 1, 15))::BIGINT"


def h60(seed: str, *parts: str) -> str:
    return H60.format(f"'{seed}:' || " + " || ':' || ".join(parts))


def unit(v: str) -> str:
    return f"list_transform({v}, lambda q: q / greatest(sqrt(list_inner_product({v}, {v})), 1e-12::DOUBLE))"


CTE = {
    "vec": "vec AS (SELECT vec_id AS crop_id, label::BIGINT AS page_id, embedding::DOUBLE[] AS v FROM embeddings)",
    "vec2": "vec2 AS (SELECT crop_id, page_id, " + unit("w") + " AS v FROM (SELECT crop_id, page_id, list_concat([0,0,0,0,0,0,0,0,0]::DOUBLE[], v[10:64]) AS w FROM vec))",
    "vecb": "vecb AS (SELECT crop_id, page_id, v[33:64] AS v FROM vec)",
    "tok": "tok AS (SELECT crop_id, page_id, token_id, " + unit("w") + " AS t FROM (SELECT crop_id, page_id, i::BIGINT AS token_id, v[8*i+1:8*i+8] AS w FROM vec, range(0, 8) r(i)))",
    "trip": f"""hashed AS (SELECT crop_id, page_id, {h60("trip", "crop_id")} AS h FROM vec),
trip AS (
  SELECT anchor, CASE WHEN same THEN 'pos' ELSE 'neg' END AS role, member FROM (
    SELECT a.crop_id AS anchor, b.crop_id AS member, a.page_id = b.page_id AS same,
           row_number() OVER (PARTITION BY a.crop_id, a.page_id = b.page_id ORDER BY b.h, b.crop_id) AS r
    FROM hashed a JOIN hashed b ON a.crop_id <> b.crop_id)
  WHERE r <= CASE WHEN same THEN 3 ELSE 4 END)""",
    "log": "log AS (SELECT user_id AS run_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS step, event_id, ts, event_type, value FROM events)",
    "page": "page AS (SELECT page_id, nullif(regexp_extract(html, '<title>([^<]*)</title>', 1), '') AS title, url FROM pages)",
}


def with_ctes(names: str, body: str) -> str:
    return "WITH " + ",\n".join(CTE[n] for n in names.split()) + "\n" + body
