"""Joins that must not lose or mix rows, and the checks that say so."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest(df: DataFrame, key: list[str], at: str) -> DataFrame:
    """The last version of each key: by ``at``, then by all other columns, so that the choice does not depend on order. One hash aggregation, no sort."""
    rest = [c for c in df.columns if c not in key and c != at]
    return df.groupBy(*key).agg(F.max(F.struct(at, *rest)).alias("_")).select(*key, "_.*").select(*df.columns)


def resume(wanted: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """The items without an output row yet."""
    return wanted.join(done.select(key).where(F.col(key).isNotNull()), key, "left_anti")


def first_wins(parts: list[DataFrame], key: list[str]) -> DataFrame:
    """The union of several stores in which the first that has a key supplies all its rows."""
    out = None
    for n, p in enumerate(parts):
        p = p.withColumn("_store", F.lit(n))
        out = p if out is None else out.unionByName(p)
    best = out.groupBy(*key).agg(F.min("_store").alias("_store"))
    return out.join(best, [*key, "_store"], "left_semi").drop("_store")


def join_checked(left: DataFrame, right: DataFrame, key: list[str]) -> DataFrame:
    """Inner join on a unique right key; a repeated right key is raised when rows are computed."""
    n = right.groupBy(*key).agg(F.count("*").alias("_n"), *[F.first(c).alias(c) for c in right.columns if c not in key])
    ok = n.withColumn("_ok", F.when(F.col("_n") == 1, True).otherwise(F.raise_error(F.lit("the right key repeats")).cast("boolean")))
    return left.join(ok, key).where("_ok").drop("_n", "_ok")


def completeness(wanted: DataFrame, have: DataFrame, group: str, key: str, examples: int = 3) -> DataFrame:
    """``(group, wanted, have, complete, missing)`` with up to three missing keys, the least ones, as examples."""
    mark = have.select(F.col(key)).distinct().withColumn("_have", F.lit(True))
    j = wanted.select(group, key).distinct().join(mark, key, "left")
    g = j.groupBy(group).agg(F.count("*").alias("wanted"), F.count("_have").alias("have"))
    w = j.where("_have IS NULL").withColumn("_r", F.row_number().over(_order(group, key))).where(F.col("_r") <= examples)
    miss = w.groupBy(group).agg(F.sort_array(F.collect_list(key)).alias("missing"))
    return g.join(miss, group, "left").select(
        group, "wanted", "have", (F.col("wanted") == F.col("have")).alias("complete"), F.coalesce("missing", F.array().cast("array<string>")).alias("missing")
    )


def _order(group: str, key: str):
    from pyspark.sql import Window

    return Window.partitionBy(group).orderBy(key)


def duplicates(df: DataFrame, key: list[str]) -> DataFrame:
    return df.groupBy(*key).agg(F.count("*").alias("rows")).where("rows > 1")


def missing_members(expected: DataFrame, observed: DataFrame, key: list[str]) -> DataFrame:
    """Members of the design that have no row."""
    return expected.select(*key).distinct().join(observed.select(*key).distinct(), key, "left_anti")


def differing(a: DataFrame, b: DataFrame, key: list[str], value: str, tolerance: float) -> DataFrame:
    """Keys whose values differ by more than a tolerance, or that one side lacks: the reproduction check."""
    j = a.select(*key, F.col(value).alias("va")).join(b.select(*key, F.col(value).alias("vb")), key, "full")
    return j.where(F.col("va").isNull() | F.col("vb").isNull() | (F.abs(F.col("va") - F.col("vb")) > tolerance))


def required(df: DataFrame, bad: Column, message: Column) -> DataFrame:
    """The rows, of which a bad one raises when it is computed."""
    ok = F.when(~F.coalesce(bad, F.lit(False)), True).otherwise(F.raise_error(message).cast("boolean"))
    return df.where(ok)


def items_with_scores(items: DataFrame, scores: DataFrame, key: str, text: str, select_text: str) -> DataFrame:
    """Items with their score. An item without one, or scored on another text, raises."""
    s = scores.select(key, "score", F.col(text).alias("_text"), F.lit(True).alias("_has"))
    j = items.join(s, key, "left")
    j = required(j, F.col("_has").isNull(), F.concat(F.lit("no score for "), F.col(key)))
    return required(j, ~F.col("_text").eqNullSafe(F.col(select_text)), F.concat(F.lit("scored on another text: "), F.col(key))).drop("_text", "_has")


def items_with_tags(items: DataFrame, tags: DataFrame, key: str) -> DataFrame:
    """Items with their tags; an item without raises."""
    j = items.join(tags.withColumn("_has", F.lit(True)), key, "left")
    return required(j, F.col("_has").isNull(), F.concat(F.lit("no tag for "), F.col(key))).drop("_has")


def items_with_verification(items: DataFrame, verify: DataFrame, key: str, known: Column, threshold: float = 0.5) -> DataFrame:
    """Items with ``keep``: of known ones the verifier's ``kept``, or if it has none whether ``p_yes`` reaches the threshold; a known item without
    verification raises. Others are kept."""
    j = items.withColumn("_known", known).join(verify.select(key, "kept", "p_yes", F.lit(True).alias("_has")), key, "left")
    j = required(j, F.col("_known") & F.col("_has").isNull(), F.concat(F.lit("no verification for "), F.col(key)))
    keep = F.when(F.col("_known"), F.coalesce("kept", F.col("p_yes") >= threshold, F.lit(False))).otherwise(True)
    return j.withColumn("keep", keep).drop("_known", "_has", "kept", "p_yes")


def text_mismatches(items: DataFrame, scores: DataFrame, key: str, text: str, select_text: str) -> DataFrame:
    """``(key, select_text, text)`` of the items that were scored on another text."""
    j = items.select(key, select_text).join(scores.select(key, F.col(text).alias("scored_text")), key)
    return j.where(~F.col("scored_text").eqNullSafe(F.col(select_text)))


def holds_all(have: DataFrame, wanted: DataFrame, key: str) -> bool:
    """Whether every wanted key is there: the test by which a finished stage is skipped."""
    return wanted.join(have.select(key), key, "left_anti").limit(1).count() == 0


def mixed_sources(labels: DataFrame, group: str, source: str) -> DataFrame:
    """``(group, sources)`` of the groups whose labels come from several sources."""
    return labels.groupBy(group).agg(F.countDistinct(source).alias("sources")).where("sources > 1")


def grid_differences(planned: DataFrame, found: DataFrame, config: list[str]) -> DataFrame:
    """``(config, side)``: configurations that only the plan or only the results have; null parameters equal each other."""
    mark = lambda df, name: df.select(*config).distinct().withColumn("side", F.lit(name))
    both = mark(planned, "planned").unionByName(mark(found, "found"))
    return both.groupBy(*config).agg(F.count("*").alias("n"), F.min("side").alias("side")).where("n = 1").select(*config, "side")


def blank_ids(df: DataFrame, key: str) -> DataFrame:
    """Rows whose key is null, blank, or has another number of parts than four."""
    c = F.col(key)
    return df.where(c.isNull() | (F.trim(c) == "") | (F.size(F.split(c, "#")) != 4) | F.exists(F.split(c, "#"), lambda x: F.trim(x) == ""))
