"""Queries of joins, checks, sources and wording."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from plumbline.catalog import query
from plumbline.functions import text as X
from plumbline.operators import integrity as C
from plumbline.operators import matching as K
from plumbline.plans.base import CHECKS_SQL, IMAGES_SQL, ITEMS_SQL, PHOTOS_SQL, READINGS_SQL, SCORED_SQL, checks, images, items, pictures, readings, rounded, scored
from plumbline.runtime import read
from plumbline.sources.stores import read_vocabulary


@query(
    "j1_items_with_scores",
    f"""WITH {IMAGES_SQL}, {SCORED_SQL} SELECT i.kind, count(*) AS items, count(s.image_id) AS scored, count(*) FILTER (WHERE s.text IS DISTINCT FROM i.select_text AND s.image_id IS NOT NULL) AS text_differs
    FROM images i LEFT JOIN scored s USING (image_id) GROUP BY i.kind""",
)
def j1(spark, sf):
    s = scored(spark, sf).withColumn("has", F.lit(True))
    j = images(spark, sf).join(s, "image_id", "left")
    differs = F.col("has").isNotNull() & ~F.col("text").eqNullSafe(F.col("select_text"))
    return j.groupBy("kind").agg(F.count("*").alias("items"), F.count("has").alias("scored"), F.count_if(differs).alias("text_differs"))


@query(
    "j3_known_verification",
    f"""WITH {PHOTOS_SQL}, {CHECKS_SQL} SELECT p.country, count(*) AS rows, count(c.image_id) AS verified, count(*) FILTER (WHERE coalesce(c.kept, c.p_yes >= 0.5)) AS kept
    FROM pictures p LEFT JOIN checks c USING (image_id) GROUP BY p.country""",
)
def j3(spark, sf):
    """Keep if kept, else if the yes-probability is at least a half."""
    c = checks(spark, sf).withColumn("has", F.lit(True))
    j = pictures(spark, sf).join(c, "image_id", "left")
    return j.groupBy("country").agg(F.count("*").alias("rows"), F.count("has").alias("verified"), F.count_if(F.coalesce("kept", F.col("p_yes") >= 0.5)).alias("kept"))


@query(
    "j4_items_with_vectors",
    f"""WITH {IMAGES_SQL}, e AS (SELECT image_id, min(embedding) AS e FROM embed WHERE embedding IS NOT NULL GROUP BY image_id)
    SELECT i.pool_seed, count(*) AS items, round(sum(sqrt(list_sum([x::DOUBLE * x::DOUBLE for x in e]))), 3) AS norm FROM images i JOIN e USING (image_id) GROUP BY i.pool_seed""",
)
def j4(spark, sf):
    from plumbline.operators.selection import dot

    e = read(spark, sf, "embed").where("embedding IS NOT NULL").groupBy("image_id").agg(F.min("embedding").alias("e"))
    j = images(spark, sf).select("image_id", "pool_seed").join(e, "image_id")
    return rounded(j.groupBy("pool_seed").agg(F.count("*").alias("items"), F.sum(F.sqrt(dot(F.col("e"), F.col("e")))).alias("norm")), 3)


@query("j5_resume", f"WITH {IMAGES_SQL} SELECT image_id FROM images WHERE image_id NOT IN (SELECT image_id FROM scores WHERE image_id IS NOT NULL)")
def j5(spark, sf):
    return C.resume(images(spark, sf).select("image_id"), read(spark, sf, "scores"), "image_id")


@query(
    "j6_pool_completeness",
    f"""WITH {IMAGES_SQL}, h AS (SELECT DISTINCT image_id FROM embed WHERE image_id IS NOT NULL), j AS (SELECT i.pool_seed, i.image_id, h.image_id IS NOT NULL AS has FROM images i LEFT JOIN h USING (image_id)),
    m AS (SELECT pool_seed, list(image_id ORDER BY image_id) AS missing FROM (SELECT *, row_number() OVER (PARTITION BY pool_seed ORDER BY image_id) AS r FROM j WHERE NOT has) WHERE r <= 3 GROUP BY pool_seed)
    SELECT j.pool_seed, count(*) AS wanted, count(*) FILTER (WHERE has) AS have, bool_and(has) AS complete, coalesce(any_value(m.missing), []::VARCHAR[]) AS missing
    FROM j LEFT JOIN m ON m.pool_seed = j.pool_seed GROUP BY j.pool_seed""",
)
def j6(spark, sf):
    return C.completeness(images(spark, sf), read(spark, sf, "embed"), "pool_seed", "image_id")


@query(
    "j7_coverage_by_generator",
    f"""WITH {IMAGES_SQL}, {SCORED_SQL} SELECT generator_id, kind, count(*) AS images, count(DISTINCT pool_seed) AS pools, count(s.score) AS scored FROM images i LEFT JOIN scored s USING (image_id) GROUP BY ALL""",
)
def j7(spark, sf):
    j = images(spark, sf).join(scored(spark, sf), "image_id", "left")
    return j.groupBy("generator_id", "kind").agg(F.count("*").alias("images"), F.countDistinct("pool_seed").alias("pools"), F.count("score").alias("scored"))


@query(
    "j8_paired_templates",
    f"""WITH {ITEMS_SQL}, p AS (SELECT country, template, pool_id // 16 AS j, avg(score) AS v FROM items GROUP BY ALL)
    SELECT a.country, count(*) AS pairs, round(avg(a.v - b.v), 6) AS difference FROM p a JOIN p b ON a.country = b.country AND a.j = b.j AND a.template = 0 AND b.template = 1 GROUP BY a.country""",
)
def j8(spark, sf):
    """Differences between two conditions of the same design place, by one conditional sum a place."""
    p = items(spark, sf).groupBy("country", F.expr("pool_id DIV 16").alias("j")).agg(
        F.avg(F.when(F.col("template") == 0, F.col("score"))).alias("a"), F.avg(F.when(F.col("template") == 1, F.col("score"))).alias("b")
    )
    p = p.where("a IS NOT NULL AND b IS NOT NULL")
    return rounded(p.groupBy("country").agg(F.count("*").alias("pairs"), F.avg(F.col("a") - F.col("b")).alias("difference")))


#: A name as normalized, in SQL: accents off (the labels are Latin), no parentheses and signs, one leading article off.
def norm_sql(c: str) -> str:
    plain = f"strip_accents(lower(nfc_normalize({c})))"
    words = f"trim(regexp_replace(regexp_replace(regexp_replace({plain}, '\\([^)]*\\)', ' ', 'g'), '&', ' and ', 'g'), '[^\\p{{L}}\\p{{N}}\\p{{M}}]+', ' ', 'g'))"
    return f"regexp_replace({words}, '^(the|a|an) +', '')"


@query(
    "j14_vocabulary_status",
    f"""WITH {READINGS_SQL}, {PHOTOS_SQL}, v AS (SELECT DISTINCT country, {norm_sql("name")} AS name FROM vocab),
    s AS (SELECT r.reader, CASE WHEN r.label IS NULL THEN 'unresolved' WHEN r.country IS NULL OR p.country IS NULL OR r.country <> p.country THEN 'off_country'
        WHEN EXISTS (SELECT 1 FROM v WHERE v.country = p.country) AND NOT EXISTS (SELECT 1 FROM v WHERE v.country = p.country AND v.name = {norm_sql("r.label")}) THEN 'plausible_unlisted'
        ELSE 'established' END AS status FROM readings r LEFT JOIN pictures p USING (image_id))
    SELECT reader, count(*) AS n, round(avg((status = 'unresolved')::INT), 6) AS unresolved_rate, round(avg((status = 'off_country')::INT), 6) AS off_country_rate,
        round(avg((status = 'plausible_unlisted')::INT), 6) AS plausible_unlisted_rate, round(avg((status = 'established')::INT), 6) AS established_rate,
        round(1 - avg((status = 'established')::INT), 6) AS deficit FROM s GROUP BY reader""",
)
def j14(spark, sf):
    """The status of every reading, the country claimed against the photo's before the vocabulary of that country."""
    p = pictures(spark, sf).select("image_id", F.col("country").alias("prompted"))
    rows = readings(spark, sf).join(p, "image_id", "left")
    return rounded(K.status_shares(K.statuses(rows, "label", "country", "prompted", read(spark, sf, "vocab"), "name", "country"), ["reader"]))


@query(
    "j15_reader_report",
    f"""WITH {READINGS_SQL}, {CHECKS_SQL}, a AS (SELECT reader, avg((label IS NOT NULL)::INT) AS resolved FROM readings GROUP BY reader), b AS (SELECT reader, avg(kept::INT) AS keep FROM checks GROUP BY reader)
    SELECT a.reader, round(resolved, 6) AS resolved, coalesce(printf('%.3f', keep), 'n/a') AS keep FROM a LEFT JOIN b USING (reader)""",
)
def j15(spark, sf):
    a = readings(spark, sf).groupBy("reader").agg(F.avg(F.col("label").isNotNull().cast("int")).alias("resolved"))
    b = checks(spark, sf).groupBy("reader").agg(F.avg(F.col("kept").cast("int")).alias("k"))
    j = a.join(b, "reader", "left")
    return rounded(j.select("reader", "resolved", F.coalesce(F.format_string("%.3f", F.col("k")), F.lit("n/a")).alias("keep")))


@query(
    "j16_missing_cells",
    f"""WITH {IMAGES_SQL}, e AS (SELECT DISTINCT country FROM vocab WHERE country IS NOT NULL), t AS (SELECT DISTINCT template FROM images WHERE template IS NOT NULL)
    SELECT e.country, t.template FROM e CROSS JOIN t EXCEPT SELECT country, template FROM images""",
)
def j16(spark, sf):
    i = images(spark, sf)
    e = read(spark, sf, "vocab").where("country IS NOT NULL").select("country").distinct()
    t = i.where("template IS NOT NULL").select("template").distinct()
    return C.missing_members(e.join(F.broadcast(t)), i, ["country", "template"])


@query(
    "v1_mixed_generators",
    """WITH m AS (SELECT pool_seed, generator_id FROM manifest UNION ALL SELECT pool_seed, generator_id || '-other' FROM manifest WHERE kind = 'tune' AND idx = 0)
    SELECT pool_seed, count(DISTINCT generator_id) AS generators FROM m GROUP BY pool_seed HAVING count(DISTINCT generator_id) > 1""",
)
def v1(spark, sf):
    """Pools of several generators: the table has none, so the tuning pools get an image of another."""
    m = read(spark, sf, "manifest")
    other = m.where("kind = 'tune' AND idx = 0").select("pool_seed", F.concat("generator_id", F.lit("-other")).alias("generator_id"))
    g = m.select("pool_seed", "generator_id").unionByName(other).groupBy("pool_seed").agg(F.countDistinct("generator_id").alias("generators"))
    return g.where("generators > 1")


@query(
    "v2_pool_sizes",
    f"""WITH {IMAGES_SQL}, w AS (SELECT pool_seed, 8 AS wanted FROM pool_specs WHERE kind = 'tune' UNION ALL SELECT pool_seed, len(dishes) FROM pool_specs WHERE dishes IS NOT NULL AND kind <> 'tune'),
    n AS (SELECT w.pool_seed, w.wanted, count(i.image_id) AS images FROM w LEFT JOIN images i USING (pool_seed) GROUP BY ALL) SELECT pool_seed, wanted::BIGINT AS wanted, images FROM n WHERE images <> wanted""",
)
def v2(spark, sf):
    """Pools with more or fewer images than their plan: as many as dishes, and here 8 for tuning pools."""
    specs = read(spark, sf, "pool_specs")
    wanted = F.when(F.col("kind") == "tune", 8).otherwise(F.size("dishes"))
    w = specs.where("kind = 'tune' OR dishes IS NOT NULL").select("pool_seed", wanted.cast("long").alias("wanted"))
    n = images(spark, sf).groupBy("pool_seed").agg(F.count("*").alias("images"))
    j = w.join(n, "pool_seed", "left").withColumn("images", F.coalesce("images", F.lit(0)))
    return j.where("images <> wanted").select("pool_seed", "wanted", "images")


@query(
    "v3_country_mismatch",
    f"WITH {IMAGES_SQL}, s AS (SELECT DISTINCT pool_seed, country AS wanted FROM pool_specs) SELECT i.image_id, i.country, s.wanted FROM images i JOIN s USING (pool_seed) WHERE i.country IS DISTINCT FROM s.wanted",
)
def v3(spark, sf):
    s = read(spark, sf, "pool_specs").select("pool_seed", F.col("country").alias("wanted")).distinct()
    return images(spark, sf).join(s, "pool_seed").where(~F.col("country").eqNullSafe(F.col("wanted"))).select("image_id", "country", "wanted")


@query("v4_repeated_images", "SELECT image_id, count(*) AS rows FROM manifest GROUP BY image_id HAVING count(*) > 1")
def v4(spark, sf):
    return C.duplicates(read(spark, sf, "manifest"), ["image_id"])


@query(
    "v5_repeated_seeds",
    "WITH s AS (SELECT pool_seed FROM pool_specs UNION ALL SELECT pool_seed FROM pool_specs WHERE kind = 'tune') SELECT pool_seed, count(*) AS rows FROM s GROUP BY pool_seed HAVING count(*) > 1",
)
def v5(spark, sf):
    """Seeds given twice: the table has none, so the tuning pools are planned again."""
    s = read(spark, sf, "pool_specs").select("pool_seed", "kind")
    return C.duplicates(s.unionByName(s.where("kind = 'tune'")), ["pool_seed"])


@query(
    "v6_image_ids",
    """WITH m AS (SELECT image_id, generator_id, prompt_id, pool_seed, idx FROM manifest UNION ALL SELECT image_id, generator_id, prompt_id, pool_seed, idx + 1 FROM manifest WHERE kind = 'tune')
    SELECT image_id FROM m WHERE generator_id IS NULL OR prompt_id IS NULL OR image_id IS DISTINCT FROM generator_id || '#' || prompt_id || '#' || pool_seed || '#' || printf('%04d', idx) GROUP BY image_id""",
)
def v6(spark, sf):
    """Ids that are not those of their parts: tuning images with a shifted index are added, since the table has none."""
    m = read(spark, sf, "manifest").select("image_id", "generator_id", "prompt_id", "pool_seed", "idx", "kind")
    m = m.unionByName(m.where("kind = 'tune'").withColumn("idx", (F.col("idx") + 1).cast("int")))
    return m.where(~m["image_id"].eqNullSafe(X.image_id(m["generator_id"], m["prompt_id"], m["pool_seed"], m["idx"]))).select("image_id").distinct()


@query("plan_pool_items", "SELECT kind, prompt_id, pool_seed, (unnest(range(1, len(dishes) + 1)) - 1)::INT AS idx, unnest(dishes) AS dish FROM pool_specs")
def pool_items(spark, sf):
    p = read(spark, sf, "pool_specs")
    return p.select("kind", "prompt_id", "pool_seed", F.posexplode("dishes").alias("idx", "dish"))


@query(
    "plan_prompts",
    """WITH c AS (SELECT DISTINCT country FROM vocab WHERE country IS NOT NULL UNION ALL SELECT 'GLOBAL'),
    f AS (SELECT * FROM (VALUES ('cuisine', 'A', 'A photo of {domain}{country}'), ('cuisine', 'B', 'People enjoying {domain}{country}'), ('landmark', 'A', 'A photo of {domain}{country}'), ('landmark', 'B', 'People enjoying {domain}{country}')) t(domain, template, form))
    SELECT lower(replace(country, ' ', '_')) || '-' || domain || '-' || template AS prompt_id, replace(replace(form, '{domain}', domain), '{country}', CASE WHEN country = 'GLOBAL' THEN '' ELSE ' from ' || country END) AS text,
        country, domain, template FROM c CROSS JOIN f""",
)
def plan_prompts(spark, sf):
    return K.prompt_grid(read(spark, sf, "vocab"), "country", ["cuisine", "landmark"], {"A": "A photo of {domain}{country}", "B": "People enjoying {domain}{country}"})


@query(
    "plan_pools",
    """WITH p AS (SELECT prompt_id, row_number() OVER (ORDER BY prompt_id) - 1 AS i FROM (SELECT DISTINCT prompt_id FROM manifest)),
    k AS (SELECT * FROM (VALUES ('main', 0, 16), ('known', 500000, 4), ('tune', 900000, 4)) t(kind, base, pools))
    SELECT kind, prompt_id, j::INT AS pool, (base + 1000 * i + j)::BIGINT AS pool_seed, 64 AS n FROM p CROSS JOIN k CROSS JOIN (SELECT unnest(range(0, 16)) AS j) WHERE j < pools""",
)
def plan_pools(spark, sf):
    prompts = read(spark, sf, "manifest").select("prompt_id").distinct()
    return K.pool_plan(prompts, {"main": (0, 16), "known": (500_000, 4), "tune": (900_000, 4)}, 64)


_RECORDS = "(SELECT country, dish AS name, gt_label AS p31, license AS p279, url AS p361, dish_id AS p527, CASE WHEN gt_in_cspace THEN path END AS title FROM photos)"
_FILLED = " + ".join(f"(CASE WHEN trim(coalesce({c}, '')) IN ('', 'None', '[]', 'nan') THEN 0.0 ELSE 1.0 END)" for c in ("p31", "p279", "p361", "p527"))
_PROMINENCE = f"""SELECT country, name, max((({_FILLED}) / 4 + CASE WHEN trim(coalesce(title, '')) IN ('', 'None', '[]', 'nan') THEN 0.0 ELSE 1.0 END) / 2) AS prominence
    FROM {_RECORDS} r WHERE name IS NOT NULL AND name NOT IN ('', 'None') GROUP BY ALL"""


def _records(spark, sf):
    p = read(spark, sf, "photos")
    return p.select("country", F.col("dish").alias("name"), F.col("gt_label").alias("p31"), F.col("license").alias("p279"), F.col("url").alias("p361"), F.col("dish_id").alias("p527"), F.when(F.col("gt_in_cspace"), F.col("path")).alias("title"))


@query("kb_prominence", _PROMINENCE)
def kb(spark, sf):
    return K.kb_prominence(_records(spark, sf), ["p31", "p279", "p361", "p527"], "title", "name", "country")


@query("kb_rekeyed")
def kb_rekeyed(spark, sf):
    p = K.kb_prominence(_records(spark, sf), ["p31", "p279", "p361", "p527"], "title", "name", "country")
    return rounded(K.rekeyed_prominence(p, "name", "prominence", ["country"]))


#: Adjectives of the countries of the test tables.
PEOPLE = {"marovian": "Marovia", "belucarran": "Belucarra", "teshkari": "Teshkara", "sevranese": "Sevrana", "ondrezian": "Ondrezia", "itoruwan": "Itoruwa", "kulamban": "Kulamba", "halvenmarker": "Halvenmark"}


@query("t7_matched_labels")
def t7(spark, sf):
    """Every typed label matched to the vocabulary by the first of the five rules."""
    return K.match_labels(read(spark, sf, "reader_labels"), "raw", read(spark, sf, "vocab"), "name", "country", PEOPLE)


@query("reader_label_records")
def records(spark, sf):
    """What each reader said, from the stored reply where there is one, and what the vocabulary makes of it."""
    r = readings(spark, sf)
    reply = F.when(F.col("raw").isNotNull(), F.to_json(F.struct(F.col("raw").alias("dish"), "country")))
    tags = r.select("image_id", "reader", "label", "country", reply.alias("reply"))
    said = tags.select(F.explode(F.array(X.json_field(F.col("reply"), "dish"), F.col("label"))).alias("said"))
    matches = K.match_labels(said, "said", read(spark, sf, "vocab"), "name", "country", PEOPLE)
    rows = K.reader_records(tags, "reply", "label", "country", matches, "said").groupBy("reader")
    return rows.agg(F.count("*").alias("readings"), F.count("said").alias("resolved"), F.count_if("in_vocab").alias("in_vocab"), F.countDistinct("matched").alias("labels"))


_KEYS_SQL = f"keys AS (SELECT DISTINCT {norm_sql('name')} AS k FROM vocab WHERE name IS NOT NULL)"
_BAG = "list_aggregate(list_sort([CASE WHEN length(w) > 3 AND w LIKE '%s' THEN w[:-2] ELSE w END for w in string_split({}, ' ')]), 'string_agg', ' ')"


@query(
    "t7_rules_by_name",
    f"""WITH {_KEYS_SQL}, d AS (SELECT DISTINCT label AS raw, {norm_sql("label")} AS n FROM reader_labels WHERE label IS NOT NULL),
    b AS (SELECT {_BAG.format("k")} AS bag, count(*) AS c, min(k) AS k FROM keys GROUP BY bag HAVING count(*) = 1)
    SELECT raw, CASE WHEN k1.k IS NOT NULL THEN k1.k ELSE b.k END AS matched, CASE WHEN k1.k IS NOT NULL THEN 1 ELSE 4 END AS rule
    FROM d LEFT JOIN keys k1 ON k1.k = d.n LEFT JOIN b ON b.bag = {_BAG.format("d.n")} WHERE k1.k IS NOT NULL OR b.k IS NOT NULL""",
)
def t7_rules(spark, sf):
    """The rules that compare whole names, on the readers' labels."""
    found = K.match_labels(read(spark, sf, "reader_labels"), "label", read(spark, sf, "vocab"), "name", "country", {})
    return found.where("rule IN (1, 4)").select(F.col("label").alias("raw"), "matched", "rule")


@query(
    "t8_replies",
    r"""WITH r AS (SELECT vocab_id, name, CASE vocab_id % 5 WHEN 0 THEN 'Sure: {"dish": "' || name || '", "country": "' || country || '"} as asked {"dish": "no"}' WHEN 1 THEN '{"dish": 5, "country": null}'
        WHEN 2 THEN '{"dish": "unknown", "country": "' || country || '"}' WHEN 3 THEN 'no idea' ELSE '```json {"dish": "' || name || '", } ```' END AS reply FROM vocab WHERE name IS NOT NULL AND country IS NOT NULL)
    SELECT vocab_id, CASE WHEN vocab_id % 5 = 0 THEN json_extract_string(regexp_extract(reply, '\{.*?\}'), '$.dish') END AS dish,
        CASE WHEN vocab_id % 5 IN (0, 2) THEN json_extract_string(regexp_extract(reply, '\{.*?\}'), '$.country') END AS country FROM r""",
)
def t8(spark, sf):
    """The first JSON of replies that are whole, of another type, unknown, without JSON, or broken."""
    v = read(spark, sf, "vocab").where("name IS NOT NULL AND country IS NOT NULL")
    reply = F.expr("""CASE vocab_id % 5 WHEN 0 THEN concat('Sure: {"dish": "', name, '", "country": "', country, '"} as asked {"dish": "no"}') WHEN 1 THEN '{"dish": 5, "country": null}'
        WHEN 2 THEN concat('{"dish": "unknown", "country": "', country, '"}') WHEN 3 THEN 'no idea' ELSE concat('```json {"dish": "', name, '", } ```') END""")
    r = v.select("vocab_id", reply.alias("reply"))
    return r.select("vocab_id", X.json_field(F.col("reply"), "dish").alias("dish"), X.json_field(F.col("reply"), "country").alias("country"))


@query(
    "t1_normalized_ascii",
    """WITH n AS (SELECT DISTINCT dish, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(dish), '\\([^)]*\\)', ' ', 'g'), '&', ' and ', 'g'), '[^a-z0-9 ]', ' ', 'g'), ' +', ' ', 'g')) AS n
        FROM photos WHERE dish IS NOT NULL AND regexp_full_match(dish, '[ -~]*')) SELECT dish, regexp_replace(n, '^(the|a|an) +', '') AS norm FROM n""",
)
def t1(spark, sf):
    d = read(spark, sf, "photos").where("dish IS NOT NULL").select("dish").distinct().where(F.col("dish").rlike("^[ -~]*$"))
    return d.select("dish", X.normalize_ascii(F.col("dish")).alias("norm"))


@query("t1_normalized")
def t1u(spark, sf):
    return read(spark, sf, "photos").where("dish IS NOT NULL").select("dish").distinct().select("dish", X.normalize("dish").alias("norm"))


_EDITED = """WITH v AS (SELECT vocab_id, regexp_replace(name, '[^ -~]', 'e', 'g') AS name FROM vocab WHERE name IS NOT NULL) SELECT vocab_id, name, unnest([name, substr(name, 2, 1) || substr(name, 1, 1) || substr(name, 3), substr(name, 1, 2) || substr(name, 4), name || 'x', 'q' || substr(name, 2), 'qz' || substr(name, 3),
    substr(name, 3, 1) || substr(name, 2, 1) || substr(name, 1, 1) || substr(name, 4)]) AS other FROM v"""


@query("t3_one_edit_names", f"WITH e AS ({_EDITED}) SELECT DISTINCT vocab_id, other, damerau_levenshtein(name, other) = 1 AS one FROM e")
def t3(spark, sf):
    """Names of the list beside edited ones: the same, two letters swapped, one lost, added, replaced, two replaced, two swapped over a third."""
    n = read(spark, sf, "vocab").where("name IS NOT NULL").select("vocab_id", F.regexp_replace("name", "[^ -~]", "e").alias("name"))
    x = "array(name, concat(substr(name, 2, 1), substr(name, 1, 1), substr(name, 3)), concat(substr(name, 1, 2), substr(name, 4)), concat(name, 'x'), concat('q', substr(name, 2)), concat('qz', substr(name, 3)), concat(substr(name, 3, 1), substr(name, 2, 1), substr(name, 1, 1), substr(name, 4)))"
    e = n.select("vocab_id", "name", F.explode(F.expr(x)).alias("other"))
    return e.select("vocab_id", "other", X.one_edit(F.col("name"), F.col("other")).alias("one")).distinct()


@query(
    "t6_bag_keys",
    "SELECT vocab_id, list_aggregate(list_sort([CASE WHEN length(w) > 3 AND w LIKE '%s' THEN w[:-2] ELSE w END for w in string_split(name, ' ')]), 'string_agg', ' ') AS bag FROM vocab WHERE name IS NOT NULL",
)
def t6(spark, sf):
    return read(spark, sf, "vocab").where("name IS NOT NULL").select("vocab_id", X.bag_key(F.col("name")).alias("bag"))


@query("t11_fingerprints", "SELECT DISTINCT generator_id, substr(sha256(generator_id), 1, 12) AS fingerprint FROM manifest WHERE generator_id IS NOT NULL")
def t11(spark, sf):
    g = read(spark, sf, "manifest").where("generator_id IS NOT NULL").select("generator_id").distinct()
    return g.select("generator_id", X.short_hash(F.col("generator_id")).alias("fingerprint"))


@query(
    "t14_decoys",
    """WITH d AS (SELECT v.country, v.name, o.name AS decoy, row_number() OVER (PARTITION BY v.country, v.name ORDER BY md5(concat_ws('#', 'decoy', v.name, o.name)), o.name) AS r
        FROM vocab v JOIN vocab o ON v.country = o.country AND v.name <> o.name) SELECT country, name, decoy FROM d WHERE r <= 3""",
)
def t14(spark, sf):
    """Three decoys of its country for each entry of the fixed reference list."""
    from pyspark.sql import Window

    v = read(spark, sf, "vocab").select("country", "name")
    o = v.withColumnRenamed("name", "decoy")
    j = v.join(o, "country").where("name <> decoy").withColumn("p", F.md5(F.concat_ws("#", F.lit("decoy"), "name", "decoy")))
    return j.withColumn("r", F.row_number().over(Window.partitionBy("country", "name").orderBy("p", "decoy"))).where("r <= 3").select("country", "name", "decoy")


@query(
    "io6_vocabulary",
    "SELECT country, name, max(kb_prominence) AS kb_prominence FROM vocab WHERE country IS NOT NULL AND name IS NOT NULL AND kb_prominence >= 0.5 AND NOT isnan(kb_prominence) GROUP BY ALL",
)
def io6(spark, sf):
    """The list written as one nested document and read from it."""
    from plumbline.runtime import shared_dir

    v = read(spark, sf, "vocab").where("country IS NOT NULL AND name IS NOT NULL")
    known = v.where("kb_prominence IS NOT NULL AND NOT isnan(kb_prominence)")
    names = v.groupBy("country").agg(F.collect_set("name").alias("names"))
    ranks = known.groupBy("country", "name").agg(F.max("kb_prominence").alias("p")).groupBy("country").agg(F.map_from_entries(F.collect_list(F.struct("name", "p"))).alias("ranks"))
    both = names.join(ranks, "country", "left")
    # The reference list is one document by nature, so one row holds it.
    doc = both.agg(F.map_from_entries(F.collect_list(F.struct("country", "names"))).alias("vocab"), F.map_from_entries(F.collect_list(F.struct("country", "ranks"))).alias("kb_prominence"))
    path = f"{shared_dir(spark)}/plumbline/vocabulary-{uuid.uuid4().hex}"
    doc.coalesce(1).write.json(path)
    return read_vocabulary(spark, path, 0.5)


@query("names_distinct", "SELECT DISTINCT dish AS name FROM manifest WHERE dish IS NOT NULL AND dish NOT IN ('None', '')")
def names(spark, sf):
    return read(spark, sf, "manifest").where("dish IS NOT NULL AND dish NOT IN ('None', '')").select(F.col("dish").alias("name")).distinct()


@query("io15_first_store_wins", f"WITH {IMAGES_SQL} SELECT image_id, kind FROM images WHERE kind = 'main' UNION ALL SELECT image_id, 'other' FROM images WHERE kind <> 'main' OR kind IS NULL")
def io15(spark, sf):
    i = images(spark, sf)
    return C.first_wins([i.where("kind = 'main'").select("image_id", "kind"), i.select("image_id", F.lit("other").alias("kind"))], ["image_id"])
