"""Free labels matched to a vocabulary by joins, and what readers' replies say."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.text import bag_key, json_field, normalize, spelling_variant, strip_steps
from plumbline.runtime import materialize, salted_join

# Adjectives of countries and the countries they mean, where the vocabulary has these.
DEMONYMS = {
    "american": "United States", "brazilian": "Brazil", "french": "France", "indian": "India",
    "italian": "Italy", "japanese": "Japan", "nigerian": "Nigeria", "turkish": "Turkey",
}
#: A name is crowded if another name is as similar as this.
CROWDED = 0.9
#: Words shorter than this are never taken for misspelt.
SPELLED_LETTERS = 5


def _deletions(word: Column) -> Column:
    """A word and all that is left of it without one letter: words one edit apart have one of these in common."""
    places = F.sequence(F.lit(1), F.greatest(F.length(word), F.lit(1)))
    return F.array_distinct(F.concat(F.array(word), F.transform(places, lambda i: F.concat(F.substr(word, F.lit(1), i - 1), F.substr(word, i + 1, F.length(word))))))


def match_labels(labels: DataFrame, label: str, vocabulary: DataFrame, name: str, country: str | None = None, demonyms: dict[str, str] | None = None) -> DataFrame:
    """``(label, matched, in_vocab, rule)`` of every distinct label, by the first of five rules that finds a name.

    All names and labels are normalized. Rules: 1 the label is a name; 2 it is one after serving phrases, qualifiers or articles are taken off,
    the least first; 3 after a country's adjective the rest is a name of that country; 4 the only name with the same words in any order,
    plural or not; 5 the only name that it misspells, unless another name is much like that. A label that none finds is returned without its
    serving phrases; an empty or unknown one gives null.

    Each rule is an equi-join of distinct labels with the vocabulary: for the fifth on the first words' deletions, which all pairs one edit apart share,
    so no label meets names it cannot be.

    Defined cases: null labels are no rows; names that normalize alike are one; an empty vocabulary matches nothing.
    """
    demonyms = DEMONYMS if demonyms is None else demonyms
    names = vocabulary.select(normalize(F.col(name)).alias("key"), (F.col(country) if country else F.lit(None).cast("string")).alias("home"))
    names = materialize(names.where("key <> ''").distinct(), "names")
    keys = names.select("key").distinct()
    n_names = names.count()
    distinct = labels.select(F.col(label).cast("string").alias("raw")).where("raw IS NOT NULL").distinct()
    rows = distinct.select("raw", normalize("raw").alias("n"))
    named = materialize(rows.where("n NOT IN ('', 'unknown')").withColumn("steps", strip_steps(F.col("n"))).withColumn("bare", F.element_at("steps", -1)), "labels")

    steps = named.select("raw", F.posexplode("steps").alias("at", "key"))
    first = salted_join(steps, keys, ["key"], n_names, 128).groupBy("raw").agg(F.min(F.struct("at", "key")).alias("hit"))
    by_name = first.select("raw", F.when(F.col("hit.at") == 0, 1).otherwise(2).alias("rule"), F.col("hit.key").alias("matched"))

    if demonyms and country:
        homes = F.create_map(*[F.lit(x) for kv in demonyms.items() for x in kv])
        head = F.split("bare", " ")[0]
        rest = F.expr("substring(bare, length(split(bare, ' ')[0]) + 2)")
        after = named.select("raw", F.try_element_at(homes, head).alias("home"), rest.alias("rest")).where("home IS NOT NULL AND rest <> ''")
        after = after.select("raw", "home", F.posexplode(strip_steps(F.col("rest"))).alias("at", "key"))
        hits = salted_join(after, names, ["key", "home"], n_names, 128).groupBy("raw").agg(F.min(F.struct("at", "key")).alias("hit"))
        by_home = hits.select("raw", F.lit(3).alias("rule"), F.col("hit.key").alias("matched"))
    else:
        by_home = by_name.limit(0)

    bags = keys.groupBy(bag_key(F.col("key")).alias("bag")).agg(F.count("*").alias("n"), F.min("key").alias("key")).where("n = 1").select("bag", "key")
    by_bag = salted_join(named.select("raw", bag_key(F.col("bare")).alias("bag")), bags, ["bag"], n_names, 128)
    by_bag = by_bag.select("raw", F.lit(4).alias("rule"), F.col("key").alias("matched"))

    # The words of a vocabulary are at most as many as it has; they stand beside each pair as one array of those the label uses.
    words = keys.select(F.explode(F.split("key", " ")).alias("w")).distinct().withColumn("known", F.lit(True))
    mine = salted_join(named.select("raw", "bare", F.explode(F.split("bare", " ")).alias("w")), words, ["w"], n_names, 64, "left")
    mine = mine.groupBy("raw", "bare").agg(F.collect_set(F.when(F.col("known"), F.col("w"))).alias("known"))
    sig = lambda c: F.explode(_deletions(F.split(c, " ")[0])).alias("sig")
    size = lambda c: F.size(F.split(c, " ")).alias("words")
    pairs = mine.select("raw", "bare", "known", size("bare"), sig("bare")).join(keys.select("key", size("key"), sig("key")), ["words", "sig"])
    close = pairs.where(spelling_variant(F.col("bare"), F.col("key"), F.col("known"), SPELLED_LETTERS)).select("raw", "key").distinct()
    close = close.groupBy("raw").agg(F.count("*").alias("n"), F.min("key").alias("key")).where("n = 1")
    lonely = _lonely(close.select("key").distinct(), keys)
    by_spelling = close.join(lonely, "key").select("raw", F.lit(5).alias("rule"), F.col("key").alias("matched"))

    hits = by_name.unionByName(by_home).unionByName(by_bag).unionByName(by_spelling)
    best = hits.groupBy("raw").agg(F.min(F.struct("rule", "matched")).alias("best"))
    out = rows.join(named.select("raw", "bare"), "raw", "left").join(best, "raw", "left")
    return out.select(
        F.col("raw").alias(label), F.coalesce("best.matched", "bare").alias("matched"), F.col("best").isNotNull().alias("in_vocab"), F.col("best.rule").alias("rule")
    )


def _lonely(some: DataFrame, keys: DataFrame) -> DataFrame:
    """Those of some names that no other name resembles by ``CROWDED``. Only names of nearly their length can, so pairs meet by ranges of length."""
    ratio = 2 * (1 - CROWDED) / CROWDED  # of the longer's letters beyond the shorter's, to the shorter's
    reach = F.ceil(F.length("key") * ratio).cast("int")
    wanted = some.select("key", F.explode(F.sequence(F.length("key") - reach, F.length("key") + reach)).alias("size"))
    pairs = wanted.join(keys.select(F.col("key").alias("other"), F.length("key").alias("size")), "size").where("key <> other")

    @F.pandas_udf("boolean")
    def alike(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([difflib.SequenceMatcher(None, y, x).ratio() >= CROWDED for x, y in zip(a, b)], dtype=bool)

    crowded = pairs.where(alike("key", "other")).select("key").distinct()
    return some.join(crowded, "key", "left_anti")


def statuses(tags: DataFrame, label: str, country: str, prompted: str, vocabulary: DataFrame, name: str, home: str) -> DataFrame:
    """The tags with ``status``: unresolved without a label; else off_country if the country claimed is not the prompted one; else plausible_unlisted
    if the prompted country has a vocabulary without the label; else established. Names are compared as normalized."""
    known = vocabulary.select(normalize(F.col(name)).alias("_key"), F.col(home).alias("_home")).where("_key <> ''").distinct()
    listed = known.select("_home").distinct().withColumn("_has", F.lit(True))
    n = known.count()
    rows = tags.withColumn("_key", normalize(F.col(label))).withColumn("_home", F.col(prompted))
    rows = salted_join(rows, listed, ["_home"], n, 64, "left")
    rows = salted_join(rows, known.withColumn("_in", F.lit(True)), ["_key", "_home"], n, 128, "left")
    status = (
        F.when(F.col(label).isNull(), "unresolved")
        .when(~F.coalesce(F.col(country) == F.col(prompted), F.lit(False)), "off_country")
        .when(F.col("_has") & F.col("_in").isNull(), "plausible_unlisted")
        .otherwise("established")
    )
    return rows.withColumn("status", status).drop("_key", "_home", "_has", "_in")


def reader_records(tags: DataFrame, reply: str, label: str, country: str, matches: DataFrame, raw: str) -> DataFrame:
    """The tags with ``said``, ``said_country``, ``matched`` and ``in_vocab``: the dish and country of the stored reply where there is one, else as stored,
    and what the dish was matched to by ``match_labels`` (``matches`` with its column ``raw``)."""
    has = F.coalesce(F.col(reply) != "", F.lit(False))
    rows = tags.withColumn("said", F.when(has, json_field(F.col(reply), "dish")).otherwise(F.col(label)))
    rows = rows.withColumn("said_country", F.when(has, json_field(F.col(reply), "country")).otherwise(F.col(country)))
    found = matches.select(F.col(raw).alias("said"), "matched", "in_vocab")
    return salted_join(rows, found, ["said"], found.count(), 256, "left").withColumn("in_vocab", F.coalesce("in_vocab", F.lit(False)))


def status_shares(rows: DataFrame, by: list[str]) -> DataFrame:
    """``(by, n, unresolved_rate, off_country_rate, plausible_unlisted_rate, established_rate, deficit)``; the deficit is the share not established."""
    share = {s: F.avg((F.col("status") == s).cast("double")) for s in ("unresolved", "off_country", "plausible_unlisted", "established")}
    return rows.groupBy(*by).agg(F.count("*").alias("n"), *[v.alias(f"{s}_rate") for s, v in share.items()], (1 - share["established"]).alias("deficit"))


def kb_prominence(records: DataFrame, properties: list[str], title: str, name: str, country: str) -> DataFrame:
    """``(country, name, prominence)``: of a knowledge base's records the share of properties that are filled, averaged with whether there is a title;
    the greatest of a name's records. ``None``, ``[]`` and ``nan`` are written for missing values."""
    filled = lambda c: (~F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")).isin("", "None", "[]", "nan")).cast("double")
    value = (sum((filled(p) for p in properties[1:]), filled(properties[0])) / len(properties) + filled(title)) / 2
    named = records.where(F.col(name).isNotNull() & ~F.col(name).isin("", "None"))
    return named.groupBy(country, name).agg(F.max(value).alias("prominence"))


def rekeyed_prominence(prominence: DataFrame, name: str, value: str, by: list[str]) -> DataFrame:
    """``(by, key, value)``: prominence by normalized name, the mean where several names normalize alike."""
    return prominence.groupBy(*by, normalize(F.col(name)).alias("key")).agg(F.avg(value).alias(value)).where("key <> ''")


def prompt_grid(countries: DataFrame, country: str, domains: list[str], templates: dict[str, str]) -> DataFrame:
    """``(prompt_id, text, country, domain, template)``: every country with every domain and template, and each domain without a country (GLOBAL).
    A template has the places ``{domain}`` and ``{country}``; domains and templates are few, so only the countries are a table."""
    grid = [(d, t, x) for d in domains for t, x in templates.items()]
    spark = countries.sparkSession
    forms = F.broadcast(spark.createDataFrame(grid, "domain string, template string, form string"))
    every = countries.select(F.col(country).alias("country")).where("country IS NOT NULL").distinct().unionByName(spark.createDataFrame([("GLOBAL",)], "country string"))
    rows = every.crossJoin(forms)  # domains x templates rows a country
    place = F.when(F.col("country") == "GLOBAL", F.lit("")).otherwise(F.concat(F.lit(" from "), "country"))
    text = F.replace(F.replace("form", F.lit("{domain}"), "domain"), F.lit("{country}"), place)
    return rows.select(F.concat_ws("-", F.lower(F.regexp_replace("country", " ", "_")), "domain", "template").alias("prompt_id"), text.alias("text"), "country", "domain", "template")


def pool_plan(prompts: DataFrame, kinds: dict[str, tuple[int, int]], n: int) -> DataFrame:
    """``(kind, prompt_id, pool, pool_seed, n)``: ``kinds`` maps a kind to its base seed and number of pools a prompt; the seed of pool j of the i-th
    prompt is base + 1000 i + j. Prompts are numbered by id. Two pools with one seed raise."""
    numbered = prompts.withColumn("i", F.row_number().over(Window.orderBy("prompt_id")) - 1)  # prompts are a design, not data
    parts = None
    for kind, (base, pools) in kinds.items():
        if pools > 1000:
            raise ValueError("a prompt may have at most 1000 pools of a kind")
        one = numbered.select(F.lit(kind).alias("kind"), "prompt_id", F.explode(F.sequence(F.lit(0), F.lit(pools - 1))).alias("pool"), (F.lit(base).cast("long") + 1000 * F.col("i")).alias("from"))
        one = one.select("kind", "prompt_id", "pool", (F.col("from") + F.col("pool")).alias("pool_seed"), F.lit(n).alias("n"))
        parts = one if parts is None else parts.unionByName(one)
    twice = parts.groupBy("pool_seed").agg(F.count("*").alias("c")).where("c > 1").limit(1).collect()
    if twice:
        raise ValueError(f"pool seed {twice[0]['pool_seed']} is given twice")
    return parts
