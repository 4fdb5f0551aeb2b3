"""Consensus of several annotators' labels, with agreement and reliability."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from plumbline.runtime import materialize, salted_join

#: Dirichlet prior of each class, in items.
CLASS_PRIOR = 0.5
#: Beta prior of the right and wrong share of an annotator's row, in readings.
RIGHT_PRIOR, WRONG_PRIOR = 7.0, 3.0
#: Dirichlet prior of a wrong value: so many readings for each value of the field on average, half of it by its frequency.
WRONG_VALUE = 1.0
#: A class with at least this share of a field's readings has a row of its own; an annotator's other classes share one.
OWN_ROW_SHARE = 0.02
#: The rounds end once the bound rises by less than this for each disputed item, or after so many.
TOLERANCE, MOST_ROUNDS = 1e-4, 100
#: Expected logarithms are sent to the tasks as one array if it has at most so many places (8 bytes each); else they are joined.
MOST_PLACES = 1_000_000
#: Parts in which the annotators and values of a field are numbered.
PARTS = 64


def digamma(x: Column) -> Column:
    """Digamma for positive x: the recurrence up to x + 6, then the asymptotic series (error below 1e-9)."""
    y = x + 6.0
    low = sum((1.0 / (x + float(j)) for j in range(1, 6)), 1.0 / x)
    z = 1.0 / (y * y)
    return F.ln(y) - 0.5 / y - z * (1 / 12 - z * (1 / 120 - z * (1 / 252 - z * (1 / 240 - z / 132)))) - low


def trigamma(x: Column) -> Column:
    """Trigamma for positive x, likewise."""
    y = x + 6.0
    low = sum((1.0 / ((x + float(j)) * (x + float(j))) for j in range(1, 6)), 1.0 / (x * x))
    z = 1.0 / (y * y)
    return 1.0 / y + z / 2 + (z / y) * (1 / 6 - z * (1 / 30 - z * (1 / 42 - z / 30))) + low


def ln_gamma(x: Column) -> Column:
    """The logarithm of the gamma function for positive x, likewise."""
    y = x + 6.0
    low = sum((F.ln(x + float(j)) for j in range(1, 6)), F.ln(x))
    z = 1.0 / (y * y)
    return (y - 0.5) * F.ln(y) - y + 0.9189385332046727 + (1.0 / y) * (1 / 12 - z * (1 / 360 - z * (1 / 1260 - z / 1680))) - low


def _readings(df: DataFrame, field: str, item: str, annotator: str, value: str) -> DataFrame:
    return df.select(
        F.col(field).cast("string").alias("f"),
        F.col(item).cast("string").alias("i"),
        F.col(annotator).cast("string").alias("a"),
        F.col(value).cast("string").alias("v"),
    ).where("f IS NOT NULL AND i IS NOT NULL AND a IS NOT NULL AND v IS NOT NULL")


def clean_readings(df: DataFrame, field: str, item: str, annotator: str, value: str) -> DataFrame:
    """``(f, i, a, v)`` with one value at most for each field, item and annotator: the least, should several be given."""
    rows = _readings(df, field, item, annotator, value)
    return rows.groupBy("f", "i", "a").agg(F.min("v").alias("v"))


class Consensus:
    """The fitted model: ``consensus``, ``reliability``, ``alpha`` are DataFrames, ``bounds`` the variational bound after each round."""

    def __init__(self, items: DataFrame, right: DataFrame, bounds: list[float]):
        self.items, self.right, self.bounds = items, right, bounds

    def consensus(self) -> DataFrame:
        """``(field, item, value, probability, annotators, distinct_values, agreement)``, one row an item and field.

        ``agreement`` is the share of pairs of its annotators that agree, null for a single annotator. Of equally
        probable values the one given more often wins, then the lesser.
        """
        ranked = F.expr("array_sort(transform(classes, (c, k) -> struct(-round(p[k], 9) AS least, -c.votes AS fewer, c.v AS v)))")
        n = F.expr("aggregate(classes, 0L, (s, c) -> s + c.votes)")
        pairs = F.expr("aggregate(classes, 0L, (s, c) -> s + c.votes * (c.votes - 1))")
        return (
            self.items.withColumn("best", F.get(ranked, F.lit(0))).withColumn("n", n)
            .select(
                F.col("f").alias("field"),
                F.col("i").alias("item"),
                F.col("best.v").alias("value"),
                (-F.col("best.least")).alias("probability"),
                F.col("n").alias("annotators"),
                F.size("classes").alias("distinct_values"),
                F.when(F.col("n") > 1, F.round(pairs / (F.col("n") * (F.col("n") - 1)), 9)).alias("agreement"),
            )
        )

    def reliability(self) -> DataFrame:
        """``(field, annotator, readings, reliability, low, high)``: posterior mean of the share of right values, and a
        95 % interval from the posterior's mean and variance on the logit scale, to which the variance of the number of right
        values is added, since what is right is itself uncertain. An annotator all of whose items have no
        other reading has the prior."""
        a, b = F.col("right") + RIGHT_PRIOR, F.col("n") - F.col("right") + WRONG_PRIOR
        slope = 1 / a + 1 / b
        mid, sd = digamma(a) - digamma(b), F.sqrt(trigamma(a) + trigamma(b) + F.col("spread") * slope * slope)
        logistic = lambda x: 1.0 / (1.0 + F.exp(-x))
        return self.right.select(
            F.col("f").alias("field"),
            F.col("a").alias("annotator"),
            F.col("n").cast("double").alias("readings"),
            F.round(a / (a + b), 6).alias("reliability"),
            F.round(logistic(mid - 1.959964 * sd), 6).alias("low"),
            F.round(logistic(mid + 1.959964 * sd), 6).alias("high"),
        )

    def alpha(self) -> DataFrame:
        return _alpha(self.items.select("f", "i", F.explode("classes").alias("k")).select("f", "i", "k.v", F.col("k.votes").alias("c")))


def krippendorff_alpha(readings: DataFrame) -> DataFrame:
    """``(field, items, pairable_values, alpha)`` for nominal values, from counts a value and item: items with a single value do not
    count; alpha is null if fewer than two values differ."""
    return _alpha(readings.groupBy("f", "i", "v").agg(F.count("*").alias("c")))


def _alpha(counts: DataFrame) -> DataFrame:
    items = counts.groupBy("f", "i").agg(F.sum("c").alias("m"), F.sum(F.col("c") * F.col("c")).alias("cc"))
    items = items.where("m > 1")
    observed = items.groupBy("f").agg(
        F.count("*").alias("items"), F.sum("m").alias("n"), F.sum((F.col("m") * F.col("m") - F.col("cc")) / (F.col("m") - 1)).alias("apart")
    )
    totals = counts.join(items.select("f", "i"), ["f", "i"]).groupBy("f", "v").agg(F.sum("c").alias("t"))
    expected = totals.groupBy("f").agg(F.sum(F.col("t").cast("double") * F.col("t")).alias("tt"))
    n = F.col("n").cast("double")
    spread = (n * n - F.col("tt")) / (n - 1)
    return observed.join(expected, "f").select(
        F.col("f").alias("field"), "items", F.col("n").alias("pairable_values"), F.when(spread > 0, F.round(1 - F.col("apart") / spread, 6)).alias("alpha")
    )



def _numbered(names: DataFrame) -> DataFrame:
    """Adds ``no``, a number from 0 for each different ``x`` of a field ``f``, without gaps: within parts by hash, which need only their sizes."""
    parted = names.withColumn("part", F.pmod(F.xxhash64("x"), F.lit(PARTS)).cast("int"))
    sizes = parted.groupBy("f", "part").agg(F.count("*").alias("size"))
    before = Window.partitionBy("f").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("f", "part", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("start"))
    place = F.row_number().over(Window.partitionBy("f", "part").orderBy("x")) - 1
    return parted.withColumn("place", place).join(starts, ["f", "part"]).select(*names.columns, (F.col("start") + F.col("place")).cast("long").alias("no"))


class _Model:
    """Numbers of the model's units, and their expected logarithms from counts.

    A field with A annotators, V values and G kinds of rows has the units: V classes; A G right readings; A G V wrong ones.
    """

    def __init__(self, readings: DataFrame):
        values = readings.groupBy("f", F.col("v").alias("x")).agg(F.count("*").alias("c"))
        self.values = materialize(_numbered(values), "values")
        people = readings.groupBy("f", F.col("a").alias("x")).agg(F.count("*").alias("c"))
        self.people = materialize(_numbered(people), "annotators")
        sizes = self.values.groupBy("f").agg(F.count("*").alias("values"), F.sum("c").alias("all"))
        sizes = sizes.join(self.people.groupBy("f").agg(F.count("*").alias("people")), "f")
        # One row a field.
        self.fields, self.places = {}, 0
        own = self.values.join(F.broadcast(sizes), "f").where(F.col("c") >= OWN_ROW_SHARE * F.col("all")).select("f", "x", "no")
        rows: dict[str, list[int]] = {}
        for r in own.orderBy("f", "no").collect():  # at most 1 / OWN_ROW_SHARE a field
            rows.setdefault(r["f"], []).append(r["no"])
        for r in sizes.orderBy("f").collect():
            mine = rows.get(r["f"], [])
            self.fields[r["f"]] = (self.places, r["values"], r["people"], len(mine) + 1, mine, r["all"])
            self.places += r["values"] + r["people"] * (len(mine) + 1) * (1 + r["values"])
        spark = readings.sparkSession
        table = [(f, o, v, a, g, n) for f, (o, v, a, g, _, n) in self.fields.items()]
        self.sizes = F.broadcast(spark.createDataFrame(table, "f string, o long, nv long, na long, ng long, n_all long"))
        kinds = [(f, no, k) for f, x in self.fields.items() for k, no in enumerate(x[4])]
        self.kinds = F.broadcast(spark.createDataFrame(kinds, "f string, no long, kind long"))
        self.n_values, self.n_people = self.values.count(), self.people.count()

    def items(self, readings: DataFrame) -> DataFrame:
        """``(f, i, classes, units, n)``: the item's values with their votes, and for each of these as its class the units of its readings."""
        known = self.values.join(self.kinds, ["f", "no"], "left").join(self.sizes, "f")
        known = known.select("f", F.col("x").alias("v"), F.col("no").alias("vn"), F.coalesce("kind", F.col("ng") - 1).alias("g"))
        people = self.people.select("f", F.col("x").alias("a"), F.col("no").alias("an"))
        rows = salted_join(readings, known, ["f", "v"], self.n_values, 64)
        rows = salted_join(rows, people, ["f", "a"], self.n_people, 64)
        items = rows.groupBy("f", "i").agg(F.array_sort(F.collect_set(F.struct("an", "v", "vn", "g"))).alias("rs")).join(self.sizes, "f")
        items = items.withColumn("rs", F.expr("filter(rs, (r, j) -> j = 0 OR rs[j - 1].an <> r.an)"))
        classes = F.expr("array_sort(array_distinct(transform(rs, r -> struct(r.v AS v, r.vn AS vn, r.g AS g))))")
        items = items.withColumn("ks", classes)
        units = """transform(ks, k -> concat(array(o + k.vn), transform(rs, r -> IF(r.vn = k.vn, o + nv + r.an * ng + k.g,
            o + nv + na * ng + (r.an * ng + k.g) * nv + r.vn))))"""
        votes = "transform(ks, k -> struct(k.v AS v, CAST(size(filter(rs, r -> r.vn = k.vn)) AS BIGINT) AS votes))"
        return items.select("f", "i", F.expr(votes).alias("classes"), F.expr(units).alias("units"), F.size("rs").alias("n"))

    def describe(self, counts: DataFrame, fixed: DataFrame) -> None:
        """Makes ``units``: every unit that has a count, its row and prior, and its ``fixed`` count; these stay the same in all rounds."""
        seen = counts.where("u >= 0").select("u").join(fixed.withColumnRenamed("c", "fixed"), "u", "full")
        spans = self.sizes.select("f", "o", "nv", "na", "ng", "n_all", (F.col("o") + F.col("nv") + F.col("na") * F.col("ng") * (1 + F.col("nv"))).alias("end"))
        rows = seen.join(spans, (F.col("u") >= F.col("o")) & (F.col("u") < F.col("end")))
        at = F.col("u") - F.col("o") - F.col("nv")
        wrong = at - F.col("na") * F.col("ng")
        kind = F.when(at < 0, "class").when(wrong < 0, "right").otherwise("wrong")
        row = F.when(at < 0, -1).when(wrong < 0, at).otherwise(F.floor(wrong / F.col("nv")))
        rows = rows.select("*", kind.alias("kind"), row.cast("long").alias("row"), F.when(wrong >= 0, wrong % F.col("nv")).alias("vn"))
        # The prior of each wrong value, and of all of a row: without the row's own class, if it has a row to itself.
        alpha = lambda c: WRONG_VALUE * F.col("nv") * (0.5 * c / F.col("n_all") + 0.5 / F.col("nv"))
        often = self.values.select("f", F.col("no").alias("vn"), F.col("c").alias("often"))
        rows = salted_join(rows, often, ["f", "vn"], self.n_values, 64, "left")
        own = self.kinds.join(self.values.select("f", "no", F.col("c").alias("own_c")), ["f", "no"]).select("f", F.col("kind").alias("own"), "own_c")
        rows = rows.withColumn("own", F.when(F.col("row") >= 0, F.col("row") % F.col("ng"))).join(F.broadcast(own), ["f", "own"], "left")
        rows = rows.select(
            "u", "f", "row", "kind", F.coalesce("fixed", F.lit(0.0)).alias("fixed"), (CLASS_PRIOR * F.col("nv")).alias("all_classes"),
            F.when(F.col("kind") == "wrong", alpha(F.col("often"))).otherwise(CLASS_PRIOR).alias("alpha"),
            (WRONG_VALUE * F.col("nv") - F.coalesce(alpha(F.col("own_c")), F.lit(0.0))).alias("all_wrong"),
        )
        self.units = materialize(rows, "units")

    def logs(self, counts: DataFrame) -> DataFrame:
        """``(u, c, l, sure, kl)`` of each unit: its expected count and logarithm, what the items without dispute add to the bound, and
        the unit's part of the divergence of the posterior from the prior. The evidence of the disputed items stands at unit -1."""
        new = counts.where("u >= 0").withColumnRenamed("c", "new")
        rows = self.units.join(new, "u", "left").withColumn("c", F.col("fixed") + F.coalesce("new", F.lit(0.0)))
        of_row = Window.partitionBy("f", "row")
        total = lambda kind: F.sum(F.when(F.col("kind") == kind, F.col("c")).otherwise(0.0)).over(of_row)
        rows = rows.select("*", total("right").alias("nr"), total("wrong").alias("nw"), total("class").alias("nc"), F.count("*").over(of_row).alias("in_row"))
        is_class, is_wrong = F.col("kind") == "class", F.col("kind") == "wrong"
        c, nr, nw, a0 = F.col("c"), F.col("nr"), F.col("nw"), F.col("alpha")
        right, wrong = F.lit(RIGHT_PRIOR), F.lit(WRONG_PRIOR)
        # The Dirichlet of classes or wrong values to which the unit belongs: its prior and counts in all.
        a_all, n_all = F.when(is_class, F.col("all_classes")).otherwise(F.col("all_wrong")), F.when(is_class, F.col("nc")).otherwise(nw)
        rows = rows.select("*", (digamma(a0 + c) - digamma(a_all + n_all)).alias("l_value"), a_all.alias("a_all"), n_all.alias("n_all"))
        rows = rows.select("*", digamma(right + wrong + nr + nw).alias("l_row"))
        rows = rows.select("*", (digamma(right + nr) - F.col("l_row")).alias("l_right"), (digamma(wrong + nw) - F.col("l_row")).alias("l_wrong"))
        one = lambda prior, n, log: ln_gamma(prior) - ln_gamma(prior + n) + n * log
        value, hit, miss = F.col("l_value"), F.col("l_right"), F.col("l_wrong")
        # What belongs to a whole row is given to each of its units in equal shares.
        whole = ln_gamma(F.col("a_all") + F.col("n_all")) - ln_gamma(F.col("a_all"))
        split = ln_gamma(right + wrong + nr + nw) - ln_gamma(right + wrong) + one(right, nr, hit) + one(wrong, nw, miss)
        mine = F.when(F.col("kind") == "right", 0.0).otherwise(one(a0, c, value))
        log = F.when(is_class, value).when(is_wrong, miss + value).otherwise(hit)
        kl = mine + (whole + F.when(is_class, 0.0).otherwise(split)) / F.col("in_row")
        rows = rows.select("u", "c", log.alias("l"), (F.col("fixed") * log).alias("sure"), kl.alias("kl"))
        zero = F.lit(0.0)
        return rows.unionByName(counts.where("u < 0").select("u", F.lit(0.0).alias("c"), F.col("c").alias("l"), zero.alias("sure"), zero.alias("kl")))


    def right(self, fitted: DataFrame) -> DataFrame:
        """``(f, a, n, right, spread)``: each annotator's readings of items with another reading, how many of them are expected to be right,
        and the variance of that number."""
        rows = fitted.where("n > 1").join(self.sizes, "f").select("f", "o", "nv", "na", "ng", F.explode(F.arrays_zip("units", "p")).alias("x"))
        rows = rows.select("f", "o", "nv", "na", "ng", F.col("x.p").alias("p"), F.explode("x.units").alias("u")).where(F.col("u") >= F.col("o") + F.col("nv"))
        at = F.col("u") - F.col("o") - F.col("nv")
        wrong = at - F.col("na") * F.col("ng")
        no = F.floor(F.when(wrong < 0, at).otherwise(F.floor(wrong / F.col("nv"))) / F.col("ng"))
        p, zero = F.col("p"), F.lit(0.0)
        sums = rows.select("f", no.cast("long").alias("no"), "p", (wrong < 0).alias("hit")).groupBy("f", "no").agg(
            F.sum("p").alias("n"), F.sum(F.when(F.col("hit"), p).otherwise(0.0)).alias("right"), F.sum(F.when(F.col("hit"), p * (1 - p)).otherwise(0.0)).alias("spread")
        )
        found = self.people.join(sums, ["f", "no"], "left")
        return found.select("f", F.col("x").alias("a"), *[F.coalesce(x, zero).alias(x) for x in ("n", "right", "spread")])


def _posterior(units: pa.ListArray, logs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the items' units: all units, how many each class has, the classes' posterior, how many classes each item has, and its log evidence."""
    inner = units.flatten()
    flat = inner.flatten().to_numpy(zero_copy_only=False)
    n_units = np.diff(inner.offsets.to_numpy())
    n_classes = np.diff(units.offsets.to_numpy())
    score = np.add.reduceat(logs[flat], np.cumsum(n_units) - n_units)
    first = np.cumsum(n_classes) - n_classes
    most = np.maximum.reduceat(score, first)
    e = np.exp(score - np.repeat(most, n_classes))
    z = np.add.reduceat(e, first)
    return flat, n_units, e / np.repeat(z, n_classes), n_classes, most + np.log(z)


class _Logs:
    """The expected logarithms of the units, as an array if they have few places, else as a table, and the round's bound."""

    def __init__(self, model: _Model, counts: DataFrame):
        self.array = self.table = None
        logs = model.logs(counts)
        if model.places <= MOST_PLACES:
            got = logs.toPandas()
            u, self.array = got["u"].to_numpy(), np.zeros(model.places)
            self.array[u[u >= 0]] = got["l"].to_numpy()[u >= 0]
            self.evidence, self.rest = got["l"].to_numpy()[u < 0].sum(), got["sure"].sum() - got["kl"].sum()
        else:
            logs = materialize(logs, "logs")
            self.table = logs.where("u >= 0").select("u", "l")
            r = logs.agg(F.sum(F.when(F.col("u") < 0, F.col("l"))), F.sum("sure"), F.sum("kl")).first()
            self.evidence, self.rest = r[0] or 0.0, (r[1] or 0.0) - (r[2] or 0.0)


def _expect(items: DataFrame, logs: _Logs | None) -> DataFrame:
    """The items with ``p``, the posterior of their classes, and ``evidence``; without logarithms ``p`` is the share of the votes."""
    if logs is None:
        return items.select("*", F.expr("transform(classes, c -> c.votes / n)").alias("p"), F.lit(0.0).alias("evidence"))
    if logs.array is not None:
        shared = items.sparkSession.sparkContext.broadcast(logs.array)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    _, _, p, n_classes, evidence = _posterior(b.column("units"), shared.value)
                    offsets = np.concatenate([[0], np.cumsum(n_classes)]).astype(np.int32)
                    p = pa.ListArray.from_arrays(pa.array(offsets), pa.array(p))
                    yield pa.RecordBatch.from_arrays([*b.columns, p, pa.array(evidence)], names=[*b.schema.names, "p", "evidence"])

        return items.mapInArrow(run, StructType([*items.schema.fields, StructField("p", ArrayType(DoubleType())), StructField("evidence", DoubleType())]))
    each = items.select("f", "i", F.posexplode("units").alias("k", "us")).select("f", "i", "k", F.explode("us").alias("u"))
    scores = each.join(logs.table, "u").groupBy("f", "i", "k").agg(F.sum("l").alias("s"))
    scores = scores.groupBy("f", "i").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "s"))), lambda x: x["s"]).alias("s"))
    scores = scores.withColumn("e", F.expr("transform(s, x -> exp(x - array_max(s)))")).withColumn("z", F.expr("aggregate(e, 0D, (a, x) -> a + x)"))
    found = scores.select("f", "i", F.expr("transform(e, x -> x / z)").alias("p"), (F.array_max("s") + F.ln("z")).alias("evidence"))
    return items.join(found, ["f", "i"])


def _count(items: DataFrame, logs: _Logs | None) -> DataFrame:
    """``(u, c)``: the expected counts of the units; the sum of the items' evidence stands at unit -1."""
    if logs is not None and logs.array is not None:
        shared = items.sparkSession.sparkContext.broadcast(logs.array)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums, total = np.zeros(len(shared.value)), 0.0
            for b in batches:
                if b.num_rows:
                    flat, n_units, p, _, evidence = _posterior(b.column(0), shared.value)
                    sums += np.bincount(flat, np.repeat(p, n_units), len(sums))
                    total += evidence.sum()
            at = np.flatnonzero(sums)
            yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(sums[at], total))], names=["u", "c"])

        return items.select("units").mapInArrow(run, "u long, c double").groupBy("u").agg(F.sum("c").alias("c"))
    rows = _expect(items, logs)
    each = rows.select(F.explode(F.arrays_zip("units", "p")).alias("x")).select(F.explode("x.units").alias("u"), F.col("x.p").alias("c"))
    each = each.unionByName(rows.select(F.lit(-1).cast("long").alias("u"), F.col("evidence").alias("c")))
    return each.groupBy("u").agg(F.sum("c").alias("c"))


def fit_consensus(
    df: DataFrame, field: str, item: str, annotator: str, value: str, tolerance: float = TOLERANCE, most_rounds: int = MOST_ROUNDS
) -> Consensus:
    """Mean-field variational inference of the confusion model, for all fields at once.

    Each item of a field has a class, drawn with Dirichlet-distributed class shares. Each annotator has for each class a row of
    what they write: right or wrong by a Beta (two-valued Dirichlet) share, and if wrong, a value by a Dirichlet over the
    field's values; classes too rare to learn a row for each (``OWN_ROW_SHARE``) share one row an annotator. All priors are
    fixed, a value that an annotator never wrote has its prior in closed form. The posteriors of classes, rows and items'
    classes are updated in turn: a round sums the items' posteriors to expected counts, by a group-by over (annotator, row,
    value), turns the counts through digamma into expected logarithms, and sums these over each item's readings. The bound
    on the evidence rises in every round (``bounds``), and the rounds end when it hardly does (``tolerance`` nats a disputed
    item). In a shared row, a wrong value that happens to be right is not counted as such.

    An item's candidate classes are the values that its annotators gave. So an item on which all agree has its value with
    certainty in every round: its counts are summed once. An item with a single reading could only vouch for itself, and is no evidence.

    Readings are shuffled once, by item; a round reads each item's units as numbers, sends the logarithms to the tasks as an
    array (``MOST_PLACES``, beyond it they are joined) and shuffles one partial sum a unit and task. So neither an annotator
    nor a value with a third of all readings is a hot task; an item has as many readings as annotators at most.

    Defined cases: a null value, field, item or annotator is no reading; one annotator's repeated readings of an item count
    once, of different ones the least value (pick the valid one before); an item with one reading gets that value
    with probability 1; an empty table gives empty results; other columns are ignored.
    """
    readings = materialize(_readings(df, field, item, annotator, value), "readings")
    model = _Model(readings)
    items = materialize(model.items(readings), "items")
    disputed = items.where(F.size("classes") > 1)
    agreed = items.where((F.size("classes") == 1) & (F.col("n") > 1))
    fixed = agreed.select(F.explode(F.get("units", F.lit(0))).alias("u")).groupBy("u").agg(F.count("*").cast("double").alias("c"))
    fixed = materialize(fixed, "fixed")
    n_disputed, bounds, logs = disputed.count(), [], None
    for _ in range(most_rounds):
        counts = materialize(_count(disputed, logs), "counts")
        if logs is None:
            model.describe(counts, fixed)
        new = _Logs(model, counts)
        if logs is not None:
            bounds.append(new.evidence + logs.rest)
        if len(bounds) > 1 and bounds[-1] - bounds[-2] <= tolerance * n_disputed:
            break
        logs = new
    sure = items.where(F.size("classes") == 1).withColumn("p", F.array(F.lit(1.0)))
    fitted = materialize(_expect(disputed, logs).drop("evidence").unionByName(sure), "fitted")
    return Consensus(fitted, model.right(fitted), bounds)
