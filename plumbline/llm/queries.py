"""Queries of the training-data operators over the driver's tables, and their SQL where SQL can say the same."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import canonical, consensus, encode, frequency, leakage, topn, truncation, varied
from plumbline.runtime import materialize, read, salted_join

QUERIES, ORACLE_SQL = {}, {}


def _query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return add


# ---- 4: the best-scored images of each pool


def ranked_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row an image with its pool, position and current score (that of the latest scored_at)."""
    m = read(spark, sf_dir, "manifest").groupBy("image_id").agg(F.min(F.struct("pool_seed", "idx")).alias("at"))
    s = read(spark, sf_dir, "scores").groupBy("image_id").agg(F.max(F.struct("scored_at", "score")).alias("now"))
    return m.join(s, "image_id").select("image_id", "at.pool_seed", "at.idx", "now.score")


@_query(
    "p4_found",
    """
    WITH m AS (SELECT DISTINCT pool_seed, image_id, idx FROM manifest),
    s AS (SELECT image_id, score FROM (SELECT image_id, score,
            row_number() OVER (PARTITION BY image_id ORDER BY scored_at DESC NULLS LAST, score DESC NULLS LAST) r FROM scores) WHERE r = 1),
    ranked AS (SELECT m.pool_seed, m.image_id,
            row_number() OVER (PARTITION BY m.pool_seed ORDER BY s.score DESC, m.idx, m.image_id) r
        FROM m JOIN s ON m.image_id = s.image_id WHERE s.score IS NOT NULL AND NOT isnan(s.score))
    SELECT pool_seed, image_id FROM ranked WHERE r <= 5
    """,
)
def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = topn.top_n_per_group(ranked_images(spark, sf_dir), "pool_seed", "image_id", "score", "idx", 5)
    return best.select("pool_seed", "image_id")


# ---- 5: frequency of terms and values


_P5_SQL = """
    WITH r AS (SELECT DISTINCT * FROM reader_labels),
    vals AS (SELECT 'label' AS field, label AS v FROM r WHERE label IS NOT NULL
             UNION ALL SELECT 'country', country FROM r WHERE country IS NOT NULL),
    numbered AS (SELECT field, v, row_number() OVER () AS id FROM vals),
    terms AS (
        SELECT field, id, unnest(regexp_extract_all(nfc_normalize(lower(nfc_normalize(v))), '[\\p{L}\\p{Nd}]+')) AS term
        FROM numbered WHERE field = 'label'
        UNION ALL
        SELECT field, id, trim(regexp_replace(lower(v), '\\s+', ' ', 'g')) FROM numbered WHERE field = 'country'),
    n AS (SELECT field, count(*) AS n FROM numbered GROUP BY field),
    c AS (SELECT field, term, count(*) AS occurrences, count(DISTINCT id) AS records FROM terms WHERE term <> '' GROUP BY field, term)
    SELECT c.field, c.term, c.occurrences, c.records, n.n AS field_records,
           CASE WHEN c.records <= 2 THEN 'rare' WHEN c.records * 100 >= n.n * 5 THEN 'common' END AS mark
    FROM c JOIN n USING (field)
"""


def _frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Copies are equal in every column: rows with the same two hashes and the same columns null. Only these and the two fields are shuffled.
    rows = read(spark, sf_dir, "reader_labels")
    nulls = sum((F.when(F.col(c).isNull(), 1 << k).otherwise(0) for k, c in enumerate(rows.columns)), F.lit(0))
    keys = [F.xxhash64(*rows.columns).alias("h1"), F.xxhash64(F.lit("copy"), *reversed(rows.columns)).alias("h2"), nulls.alias("nulls")]
    rows = rows.select("label", "country", *keys).groupBy("h1", "h2", "nulls").agg(F.first("label").alias("label"), F.first("country").alias("country"))
    return frequency.term_frequencies(rows, {"label": frequency.letter_digit_terms, "country": frequency.whole_value})


@_query("p5_frequencies", _P5_SQL)
def p5_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _frequencies(spark, sf_dir)


@_query("p5_found", f"SELECT field, term, mark FROM ({_P5_SQL}) WHERE mark IS NOT NULL")
def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _frequencies(spark, sf_dir).where("mark IS NOT NULL").select("field", "term", "mark")


# ---- 6: token ids of every page


def tokenizer_path(name: str) -> str:
    """The place of a public tokenizer's file: in the folder PLUMBLINE_TOKENIZERS, else the one installed."""
    folder = os.environ.get("PLUMBLINE_TOKENIZERS", "/opt/tokenizers")
    return os.path.join(folder, name)


@_query("p6_ids")
def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode.encode_corpus(read(spark, sf_dir, "documents"), "doc_id", "text", tokenizer_path("byte_bpe_50k.json"))


# ---- 8: pages that lack their end


@_query("p8_found")
def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = truncation.find_truncated(read(spark, sf_dir, "documents"), "doc_id", "text", "source", "line_boxes")
    return found.where("cut").select("doc_id")


@_query("p8_sources")
def p8_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation.truncation_by_source(read(spark, sf_dir, "documents"), "doc_id", "text", "source", "line_boxes")


@_query("p8_reasons")
def p8_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many pages of each source are cut for what reason."""
    found = truncation.find_truncated(read(spark, sf_dir, "documents"), "doc_id", "text", "source", "line_boxes")
    return found.where("cut").groupBy("source", "reason").agg(F.count("*").alias("pages"))


# ---- 7: held-out passages in the pages


def _leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.find_leaks(read(spark, sf_dir, "documents"), "doc_id", "text", read(spark, sf_dir, "benchmark"), "item_id", "text")


@_query("p7_found")
def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _leaks(spark, sf_dir).select("doc_id", "item_id")


@_query("p7_leaked_items")
def p7_leaked_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The items that leaked, with the number of pages that hold them."""
    return _leaks(spark, sf_dir).groupBy("item_id").agg(F.countDistinct("doc_id").alias("pages"), F.max("span").alias("longest_run"))


# ---- 3: the dish that each typed value stands for


def typed_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    photos = read(spark, sf_dir, "photos").select(F.array("dish", "gt_label").alias("own"), "aliases")
    own = photos.select(F.explode(F.concat("own", F.coalesce("aliases", F.array().cast("array<string>")))).alias("entered"))
    return own.unionByName(read(spark, sf_dir, "reader_labels").select(F.col("raw").alias("entered")))


@_query("p3_found")
def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = canonical.map_values(typed_values(spark, sf_dir), "entered", read(spark, sf_dir, "vocab"), "vocab_id", "name", "aliases", "country")
    return found.select("entered", F.col("entry_id").alias("vocab_id"))


@_query("p3_candidates")
def p3_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every entry within the distance of each typed value, with its edits."""
    found = canonical.map_values(typed_values(spark, sf_dir), "entered", read(spark, sf_dir, "vocab"), "vocab_id", "name", "aliases", "country")
    return found.select("entered", F.explode("candidates").alias("c")).select("entered", F.col("c.entry_id").alias("vocab_id"), "c.edits")


# ---- 1: what the readers of a photo agree on

MISSING = ["", "none", "n/a", "nan", "unknown"]


def _written(values: DataFrame, column: str, entries: DataFrame, aliases: str | None) -> DataFrame:
    """``(written, value)``: each writing of a value with the reference's own writing; none if it is no entry's."""
    found = canonical.map_values(values, column, entries, "id", "name", aliases).where("entry_id >= 0")
    named = found.join(entries, F.col("entry_id") == F.col("id")).select(F.col("entered").alias("written"), F.col("name").alias("value"))
    return materialize(named, "written")


def photo_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(field, image_id, reader, value)`` of label, country and kept, in the writing of the vocabulary."""
    vocab = read(spark, sf_dir, "vocab")
    dishes = vocab.select(F.col("vocab_id").alias("id"), "name", "aliases")
    countries = vocab.where("country IS NOT NULL").groupBy(F.col("country").alias("name")).agg(F.min("vocab_id").alias("id"))
    # A reader's row with the latest labelled_at counts, even if its value is missing; of several, one that has values.
    last = F.max(F.struct("labelled_at", "received_at", "label", "country")).alias("last")
    latest = materialize(
        read(spark, sf_dir, "reader_labels").groupBy("image_id", "reader").agg(last).select("image_id", "reader", "last.label", "last.country"), "latest"
    )
    parts = []
    for field, entries, aliases in (("label", dishes, "aliases"), ("country", countries, None)):
        value = F.col(field)
        rows = latest.select("image_id", "reader", value.alias("written")).where(~F.lower(F.trim(F.regexp_replace("written", r"[\s\p{Z}]+", " "))).isin(MISSING))
        names = _written(rows, "written", entries, aliases)
        folded = F.trim(F.regexp_replace(F.lower("written"), r"[^\p{L}\p{M}\p{N}]+", " "))
        parts.append(salted_join(rows, names, ["written"], names.count(), 256, "left").select(F.lit(field).alias("field"), "image_id", "reader", F.coalesce("value", folded).alias("value")))
    kept = read(spark, sf_dir, "verify").where("kept IS NOT NULL").select(F.lit("kept").alias("field"), "image_id", "reader", F.col("kept").cast("string").alias("value"))
    return parts[0].unionByName(parts[1]).unionByName(kept)


def _fit(spark: SparkSession, sf_dir: str) -> consensus.Consensus:
    return consensus.fit_consensus(photo_readings(spark, sf_dir), "field", "image_id", "reader", "value")


@_query("p1_found")
def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = _fit(spark, sf_dir).consensus().where("annotators >= 3 AND distinct_values > 1")
    return cases.select(F.col("item").alias("image_id"), "field", F.col("value").alias("consensus"))


@_query("p1_consensus")
def p1_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every photo and field with its consensus and its agreement."""
    return _fit(spark, sf_dir).consensus()


@_query("p1_readers")
def p1_readers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each reader's reliability by field, with posterior intervals."""
    return _fit(spark, sf_dir).reliability()


@_query("p1_alpha")
def p1_alpha(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Krippendorff's alpha of each field."""
    return consensus.krippendorff_alpha(
        consensus.clean_readings(photo_readings(spark, sf_dir), "field", "image_id", "reader", "value")
    )


# ---- 2: a varied subset of the images

SUBSET = 500


#: How far from the origin pools, subjects, countries and looks lie.
P2_WEIGHTS, P2_LOOKS = {"pool_seed": 0.8, "subject": 0.6, "country": 0.3}, 0.5


def image_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row an image: its pool, subject (the dish, elsewhere the prompt), country, and its look where there is one."""
    m = read(spark, sf_dir, "manifest").select("image_id", "pool_seed", F.coalesce("dish", "prompt_id").alias("subject"), "country")
    m = m.groupBy("image_id").agg(F.min(F.struct("pool_seed", "subject", "country")).alias("x")).select("image_id", "x.*")
    looks = read(spark, sf_dir, "embed").where("embedding IS NOT NULL").groupBy("image_id").agg(F.min("embedding").alias("embedding"))
    return m.join(looks, "image_id", "left")


@_query("p2_varied_subset")
def p2_varied_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """500 images that cover pools, dishes (elsewhere prompts) and looks."""
    chosen = varied.varied_subset(image_features(spark, sf_dir), "image_id", SUBSET, "embedding", P2_WEIGHTS, vector_dims=16, vector_weight=P2_LOOKS)
    return chosen.withColumn("pool_seed", F.element_at(F.split("image_id", "#"), -2).cast("long"))


@_query(
    "p2_coverage",
    f"""
    SELECT least({SUBSET}, count(DISTINCT image_id)) AS images, least({SUBSET}, count(DISTINCT image_id)) AS different,
        true AS pools_as_random, true AS subjects_as_random FROM manifest WHERE image_id IS NOT NULL
    """,
)
def p2_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the subset has its size, each image once, and covers at least as many pools and subjects as images taken by md5."""
    rows = materialize(image_features(spark, sf_dir).select("image_id", "pool_seed", "subject"), "images")
    chosen = p2_varied_subset(spark, sf_dir).select("image_id")
    random = rows.orderBy(F.md5("image_id"), "image_id").limit(SUBSET)

    def covers(df: DataFrame, name: str) -> DataFrame:
        return df.agg(F.countDistinct("pool_seed").alias(f"{name}_pools"), F.countDistinct("subject").alias(f"{name}_subjects"))

    size = chosen.agg(F.count("*").alias("images"), F.countDistinct("image_id").alias("different"))
    both = size.crossJoin(covers(chosen.join(rows, "image_id"), "own")).crossJoin(covers(random, "random"))  # one row each
    return both.select(
        "images", "different", (F.col("own_pools") >= F.col("random_pools")).alias("pools_as_random"),
        (F.col("own_subjects") >= F.col("random_subjects")).alias("subjects_as_random"),
    )
