"""Views of the driver's tables that the query plans share, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.runtime import read

#: Items with a label and a score: the event log, a user's events being a pool of a (country, template) cell.
ITEMS_SQL = """items AS (SELECT user_id AS pool_id, event_id AS idx, event_type AS label, value AS score, user_id % 8 AS country,
    (user_id // 8) % 2 AS template FROM events)"""
#: One row an image, its current score, the last reading of each reader, verification without copies.
IMAGES_SQL = """images AS (SELECT image_id, min(generator_id) AS generator_id, min(kind) AS kind, min(prompt_id) AS prompt_id, min(country) AS country,
    min(template) AS template, min(pool_seed) AS pool_seed, min(idx) AS idx, min(select_text) AS select_text, min(dish) AS dish FROM manifest GROUP BY image_id)"""
SCORED_SQL = """scored AS (SELECT image_id, score, text FROM (SELECT *, row_number() OVER (PARTITION BY image_id
    ORDER BY scored_at DESC NULLS LAST, score DESC NULLS LAST, text DESC NULLS LAST) AS r FROM scores) WHERE r = 1)"""
READINGS_SQL = """readings AS (SELECT image_id, reader, label, country, raw, in_vocab FROM (SELECT *, row_number() OVER (PARTITION BY image_id, reader
    ORDER BY labelled_at DESC NULLS LAST, received_at DESC NULLS LAST, label DESC NULLS LAST, country DESC NULLS LAST, raw DESC NULLS LAST,
    in_vocab DESC NULLS LAST) AS r FROM reader_labels) WHERE r = 1)"""
CHECKS_SQL = """checks AS (SELECT image_id, reader, bool_or(kept) AS kept, max(chosen) AS chosen, max(true_pos) AS true_pos, max(p_yes) AS p_yes,
    max(p_yes_decoy) AS p_yes_decoy FROM verify GROUP BY image_id, reader)"""
PHOTOS_SQL = """pictures AS (SELECT image_id, min(dish_id) AS dish_id, min(dish) AS dish, min(country) AS country, min(gt_label) AS gt_label,
    bool_or(gt_in_cspace) AS gt_in_cspace FROM photos GROUP BY image_id)"""


def items(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "events").select(
        F.col("user_id").alias("pool_id"),
        F.col("event_id").alias("idx"),
        F.col("event_type").alias("label"),
        F.col("value").alias("score"),
        (F.col("user_id") % 8).alias("country"),
        F.expr("(user_id DIV 8) % 2").alias("template"),
    )


def images(spark: SparkSession, sf: str) -> DataFrame:
    columns = ["generator_id", "kind", "prompt_id", "country", "template", "pool_seed", "idx", "select_text", "dish"]
    return read(spark, sf, "manifest").groupBy("image_id").agg(*[F.min(c).alias(c) for c in columns])


def scored(spark: SparkSession, sf: str) -> DataFrame:
    s = read(spark, sf, "scores").groupBy("image_id").agg(F.max(F.struct("scored_at", "score", "text")).alias("_"))
    return s.select("image_id", "_.score", "_.text")


def readings(spark: SparkSession, sf: str) -> DataFrame:
    """Each reader's last reading of each photo."""
    r = read(spark, sf, "reader_labels").groupBy("image_id", "reader")
    return r.agg(F.max(F.struct("labelled_at", "received_at", "label", "country", "raw", "in_vocab")).alias("_")).select("image_id", "reader", "_.label", "_.country", "_.raw", "_.in_vocab")


def checks(spark: SparkSession, sf: str) -> DataFrame:
    v = read(spark, sf, "verify").groupBy("image_id", "reader")
    return v.agg(F.bool_or("kept").alias("kept"), *[F.max(c).alias(c) for c in ("chosen", "true_pos", "p_yes", "p_yes_decoy")])


def pictures(spark: SparkSession, sf: str) -> DataFrame:
    p = read(spark, sf, "photos").groupBy("image_id")
    return p.agg(*[F.min(c).alias(c) for c in ("dish_id", "dish", "country", "gt_label")], F.bool_or("gt_in_cspace").alias("gt_in_cspace"))


def vectors(spark: SparkSession, sf: str, pools: int = 10) -> DataFrame:
    """Embeddings with a label, dealt into pools, with a reproducible score."""
    score = F.conv(F.substring(F.md5(F.concat_ws("#", F.lit("score"), "vec_id")), 1, 8), 16, 10).cast("double") / 4294967296.0
    return read(spark, sf, "embeddings").select((F.col("vec_id") % pools).alias("pool_id"), F.col("vec_id").alias("idx"), "embedding", "label", score.alias("score"))


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, so that engines that differ in the last place agree."""
    return df.select(*[(F.round(c, digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])
