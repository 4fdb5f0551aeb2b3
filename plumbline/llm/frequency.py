"""Frequency of every distinct value or term, with marks on those too rare or too common."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.runtime import materialize

#: Distinct keys held by one task before it hands its partial sums on.
FLUSH_KEYS = 200_000

_RUNS = regex.compile(r"[\p{L}\p{Nd}]+")


def letter_digit_terms(text: str) -> list[str]:
    """The longest runs of letters and digits of the NFC lower-case form."""
    return _RUNS.findall(unicodedata.normalize("NFC", unicodedata.normalize("NFC", text).lower()))


def whole_value(text: str) -> list[str]:
    """The whole value in lower case, outer blanks removed and inner ones made single; none for a blank value."""
    one = " ".join(text.lower().split())
    return [one] if one else []


def term_frequencies(
    df: DataFrame,
    fields: dict[str, Callable[[str], list[str]]],
    rare_records: int = 2,
    common_percent: int = 5,
) -> DataFrame:
    """``(field, term, occurrences, records, field_records, mark)`` for each term of each field.

    ``fields`` maps a column to the function that gives a value's terms. A term held by at most ``rare_records``
    records is ``rare``, else one held by at least ``common_percent`` % of the field's non-null records is
    ``common``; the mark of the others is null.

    Method: each task counts the terms record by record and combines the counts by hash in a dictionary that it
    hands on whenever it holds ``FLUSH_KEYS`` keys, so one very common term leaves a task as few rows; Spark sums
    those partial counts before and after the shuffle on (field, term). The shuffled volume follows the distinct
    terms of each task, not the rows.

    Defined cases: a null value is no record of its field; blank values and values without letters are records
    without terms; repeated rows count as often as they are given (dedupe first if copies count once); an empty
    table gives no rows; other columns are ignored. Values of any length are read whole.
    """
    names = list(fields)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[tuple[str, str | None], list[int]] = {}

        def out() -> pd.DataFrame:
            part = pd.DataFrame(
                [(f, t, o, r) for (f, t), (o, r) in sums.items()], columns=["field", "term", "occurrences", "records"]
            )
            sums.clear()
            return part

        for pdf in batches:
            for k, name in enumerate(names):
                terms_of, known = fields[name], {}
                # A value met again in the batch is split once: its counts are weighted.
                for value, times in pdf.iloc[:, k].value_counts().items():
                    sums.setdefault((name, None), [0, 0])[1] += times
                    known.clear()
                    for t in terms_of(value):
                        known[t] = known.get(t, 0) + 1
                    for t, c in known.items():
                        s = sums.setdefault((name, t), [0, 0])
                        s[0] += c * times
                        s[1] += times
                    if len(sums) >= FLUSH_KEYS:
                        yield out()
        if sums:
            yield out()

    parts = df.select(*[F.col(n).cast("string").alias(f"v{k}") for k, n in enumerate(names)]).mapInPandas(
        count, "field string, term string, occurrences long, records long"
    )
    sums = parts.groupBy("field", "term").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))
    sums = materialize(sums, "terms")  # read twice below; the values are split only once
    # One row a field: the null term carries the number of the field's records.
    totals = sums.where("term IS NULL").select(F.col("field").alias("f"), F.col("records").alias("field_records"))
    records = F.col("records")
    return (
        sums.where("term IS NOT NULL")
        .join(F.broadcast(totals), F.col("field") == F.col("f"))
        .select(
            "field",
            "term",
            "occurrences",
            "records",
            "field_records",
            F.when(records <= rare_records, "rare").when(records * 100 >= F.col("field_records") * common_percent, "common").alias("mark"),
        )
    )
