"""What reports are made of, as relations: repetition across pools, rankings, variants, reasons, tables by reader, formats."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.stats import t_ppf
from plumbline.operators.draws import drawn_labels
from plumbline.operators.selection import top_k
from plumbline.runtime import materialize


# ---- repetition


def mean_jaccard(sets: DataFrame, keys: list[str], pools: DataFrame) -> DataFrame:
    """``(keys, jaccard)``: the mean Jaccard similarity over the pairs of a group's pools, from ``(keys, pool_id, label)`` with distinct labels.

    Pairs of two empty sets are no pairs. ``pools`` has all ``(keys, pool_id)``, also those without a label.
    """
    own = sets.groupBy(*keys, "pool_id").agg(F.sort_array(F.collect_set("label")).alias("labels"))
    every = pools.join(own, [*keys, "pool_id"], "left").select(*keys, F.coalesce("labels", F.array().cast(own.schema["labels"].dataType)).alias("labels"))
    return set_jaccard(every, keys, {"jaccard": "labels"})


def set_jaccard(pools: DataFrame, keys: list[str], columns: dict[str, str]) -> DataFrame:
    """``(keys, <a column for each name>)``: of each named column of sorted label sets, one row a pool, the mean Jaccard similarity over pairs of pools.

    Equal sets are counted first, so pairs are made of different sets only, weighted by the numbers of their pools. They meet by their common labels; those
    without one add 0 to the mean, and pairs of two empty sets are no pairs.
    """
    kinds = F.explode(F.array(*[F.struct(F.lit(name).alias("_kind"), F.col(c).alias("_set")) for name, c in columns.items()]))
    by = [*keys, "_kind"]
    counted = pools.select(*keys, kinds.alias("_")).select(*keys, "_.*").groupBy(*by, "_set").agg(F.count("*").alias("c"))
    counted = materialize(counted.withColumn("id", F.row_number().over(Window.partitionBy(*by).orderBy("_set"))), "sets")
    size = F.size("_set")
    full = counted.where(size > 0)
    side = lambda s: full.select(*by, F.explode("_set").alias("label"), F.col("id").alias(s), size.alias(f"s{s}"), F.col("c").alias(f"c{s}"))
    pairs = side("a").join(side("b"), [*by, "label"]).where("a < b").groupBy(*by, "a", "b")
    pairs = pairs.agg(F.count("*").alias("common"), *[F.first(x).alias(x) for x in ("sa", "sb", "ca", "cb")])
    part = F.col("ca") * F.col("cb") * (F.col("common") / (F.col("sa") + F.col("sb") - F.col("common")))
    total = pairs.groupBy(*by).agg(F.sum(part).alias("sum"))
    two = lambda n: n * (n - 1) / 2
    n = counted.groupBy(*by).agg(F.sum("c").alias("n"), F.sum(F.when(size == 0, F.col("c")).otherwise(0)).alias("empty"), F.sum(F.when(size > 0, two(F.col("c"))).otherwise(0)).alias("same"))
    many = two(F.col("n")) - two(F.col("empty"))
    j = n.join(total, by, "left").select(*by, F.when(many > 0, (F.coalesce("sum", F.lit(0.0)) + F.col("same")) / many).alias("jaccard"))
    return j.groupBy(*keys).pivot("_kind", list(columns)).agg(F.first("jaccard"))


def repetition(items: DataFrame, k: int, draws: int, salt: str = "rep") -> DataFrame:
    """``(country, pools, jaccard_top, jaccard_random, excess, excess_matched, modal, modal_top, modal_pool, modal_excess, set_top, set_random)``.

    Whether the best k of a country's pools repeat the same labels more than random k's do; ``excess_matched`` with both sets of a pool cut, by hash, to
    the smaller one, so their sizes make no difference. ``modal`` is the country's most frequent label, of equally frequent ones the least, and the modal
    shares count items without a label as other.
    """
    rows = items.select("country", "pool_id", "idx", "label", "score")
    pools = rows.select("country", "pool_id").distinct()
    top = materialize(top_k(rows, k).select("country", "pool_id", "label"), "top")
    none = F.array().cast(f"array<{dict(rows.dtypes)['label']}>")
    t = top.groupBy("country", "pool_id").agg(F.sort_array(F.collect_set("label")).alias("t"))
    t = pools.join(t, ["country", "pool_id"], "left").withColumn("t", F.coalesce("t", none))
    r = drawn_labels(rows, k, draws, "country", salt).withColumnRenamed("labels", "r")
    many = t.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws)))).join(r, ["country", "pool_id", "draw"], "left").withColumn("r", F.coalesce("r", none))

    def cut(name: str, labels: str) -> Column:
        order = lambda x: F.md5(F.concat_ws("#", F.lit(f"{salt}-{name}"), F.col("draw").cast("string"), F.col("pool_id").cast("string"), x.cast("string")))
        ranked = F.array_sort(F.transform(labels, lambda x: F.struct(order(x).alias("at"), x.alias("label"))))
        return F.sort_array(F.transform(F.slice(ranked, 1, F.least(F.size("t"), F.size("r"))), lambda x: x["label"]))

    many = materialize(many.select("country", "pool_id", "draw", "t", "r", cut("top", "t").alias("mt"), cut("random", "r").alias("mr")), "drawn")
    jt = set_jaccard(t, ["country"], {"jaccard_top": "t"})
    j = set_jaccard(many, ["country", "draw"], {"jaccard": "r", "top": "mt", "other": "mr"}).groupBy("country")
    jr = j.agg(F.avg("jaccard").alias("jaccard_random"), F.avg(F.col("top") - F.col("other")).alias("excess_matched"))

    counts = rows.where("label IS NOT NULL").groupBy("country", "label").agg(F.count("*").alias("c"))
    modal = counts.groupBy("country").agg(F.min_by("label", F.struct(-F.col("c"), F.col("label"))).alias("modal"))
    is_modal = F.coalesce((F.col("label") == F.col("modal")).cast("double"), F.lit(0.0))
    share = lambda df, name: df.join(modal, "country", "left").groupBy("country", "pool_id").agg(F.avg(is_modal).alias("s")).groupBy("country").agg(F.avg("s").alias(name))
    sizes = many.groupBy("country").agg(F.avg(F.size("t")).alias("set_top"), F.avg(F.size("r")).alias("set_random"), F.countDistinct("pool_id").alias("pools"))
    out = sizes
    for part in (jt, jr, modal, share(top, "modal_top"), share(rows, "modal_pool")):
        out = out.join(part, "country", "left")
    return out.select(
        "country", "pools", "jaccard_top", "jaccard_random", (F.col("jaccard_top") - F.col("jaccard_random")).alias("excess"), "excess_matched", "modal", "modal_top", "modal_pool",
        (F.col("modal_top") - F.col("modal_pool")).alias("modal_excess"), "set_top", "set_random",
    )


def t_interval(df: DataFrame, value: str) -> dict:
    """The mean of a few values with a 95 % t interval, null for fewer than two."""
    x = F.when(~F.isnan(value), F.col(value))
    r = df.agg(F.count(x).alias("n"), F.avg(x).alias("m"), F.stddev_samp(x).alias("sd"), F.count_if(x > 0).alias("positive")).first()
    half = t_ppf(0.975, r["n"] - 1) * r["sd"] / math.sqrt(r["n"]) if r["n"] > 1 else None
    return {"mean": r["m"], "lo": None if half is None else r["m"] - half, "hi": None if half is None else r["m"] + half, "positive": r["positive"]}


# ---- rankings, reasons, variants


def country_ranking(rows: DataFrame, country: str, value: str) -> DataFrame:
    """``(country, value, rank, spread, sd)``: the countries by falling value, with the spread and standard deviation of all; one row a country, so
    the windows hold the design."""
    every = Window.partitionBy()
    best = F.row_number().over(Window.orderBy(F.desc_nulls_last(value), F.asc(country)))
    spread = F.max(value).over(every) - F.min(value).over(every)
    return rows.select(country, value, best.alias("rank"), spread.alias("spread"), F.coalesce(F.stddev_samp(value).over(every), F.lit(0.0)).alias("sd"))


def reason_histogram(rows: DataFrame, by: list[str]) -> DataFrame:
    """``(by, reason, pools)``: why pools have no estimate: the reason up to its first parenthesis."""
    reason = F.trim(F.substring_index(F.coalesce("reason", F.lit("unspecified")), "(", 1))
    return rows.where("non_estimable").groupBy(*by, reason.alias("reason")).agg(F.count("*").alias("pools"))


def leave_one_out(df: DataFrame, member: str) -> DataFrame:
    """The rows once for each member left out, with ``left_out``, and once whole (null). Members are a design; each row is repeated for all others."""
    members = df.select(F.col(member).alias("left_out")).where("left_out IS NOT NULL").distinct()
    members = members.unionByName(df.sparkSession.createDataFrame([(None,)], members.schema))
    return df.join(F.broadcast(members), ~F.coalesce(F.col(member) == F.col("left_out"), F.lit(False)))


def capped(df: DataFrame, group: list[str], item: str, most: int, salt: str = "cap") -> DataFrame:
    """At most ``most`` rows of each group, by hash: a variant that limits what one group can weigh."""
    order = F.md5(F.concat_ws("#", F.lit(salt), *[F.col(g).cast("string") for g in group], F.col(item).cast("string")))
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*group).orderBy(order, item))).where(F.col("_r") <= most).drop("_r")


def variant_range(rows: DataFrame, by: list[str]) -> DataFrame:
    """``(by, least, greatest, below_zero, variants)`` of the estimates of several variants, for a table of their sensitivity."""
    return rows.groupBy(*by).agg(F.min("estimate").alias("least"), F.max("estimate").alias("greatest"), F.count_if(F.col("hi") < 0).alias("below_zero"), F.count("*").alias("variants"))


def half_sample_interval(reps: DataFrame, point: DataFrame, by: list[str], value: str) -> DataFrame:
    """``(by, estimate, lo, hi)``: the estimate plus the quantiles of the half samples about their mean."""
    stats = reps.groupBy(*by) if by else reps.groupBy()
    q = stats.agg(F.avg(value).alias("mid"), F.percentile(value, 0.025).alias("a"), F.percentile(value, 0.975).alias("b"))
    j = point.join(q, by) if by else point.crossJoin(q)
    return j.select(*by, "estimate", (F.col("estimate") + F.col("a") - F.col("mid")).alias("lo"), (F.col("estimate") + F.col("b") - F.col("mid")).alias("hi"))


def by_reader(rows: DataFrame, cell: list[str], value: str, readers: list[str]) -> DataFrame:
    """A column a reader, with ``n/a`` where a reader has no value."""
    wide = rows.groupBy(*cell).pivot("reader", readers).agg(F.first(F.format_string("%.3f", F.col(value)), True))
    return wide.select(*cell, *[F.coalesce(F.col(f"`{r}`"), F.lit("n/a")).alias(r) for r in readers])


# ---- formats


def percent(log: Column) -> Column:
    """A log contrast as a change in percent."""
    return 100 * F.expm1(log)


def shown(x: Column, digits: int = 1, sign: bool = True) -> Column:
    """A number for a table, ``n/a`` if there is none."""
    bad = x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.when(bad, "n/a").otherwise(F.format_string(f"%{'+' if sign else ''}.{digits}f", x))


def shown_interval(lo: Column, hi: Column, digits: int = 1) -> Column:
    missing = (shown(lo) == "n/a") | (shown(hi) == "n/a")
    return F.when(missing, "n/a").otherwise(F.concat(F.lit("["), shown(lo, digits), F.lit(", "), shown(hi, digits), F.lit("]")))


def shown_p(p: Column) -> Column:
    return F.when(p.isNull() | F.isnan(p), "n/a").when(p < 0.001, "<0.001").otherwise(F.format_string("%.3f", p))


def markdown(rows: DataFrame, columns: list[str]) -> str:
    """A small relation as a table of text; all its rows reach the driver."""
    lines = ["| " + " | ".join(columns) + " |", "|" + "---|" * len(columns)]
    for r in rows.select(*columns).collect():
        lines.append("| " + " | ".join("n/a" if v is None else str(v).replace("|", "\\|") for v in r) + " |")
    return "\n".join(lines)


def latex_escaped(c: Column) -> Column:
    """Text with the signs that LaTeX takes for commands escaped."""
    return F.regexp_replace(c, r"([&%$#_{}])", r"\\$1")
