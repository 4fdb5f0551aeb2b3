"""Contracts of the stages that need a model: what goes in, what comes out, and that nothing is made twice or lost. Models are passed in."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.text import image_id, item_seed


def generate(specs: DataFrame, generator_id: str, n: int, render: Callable[[str, int], str]) -> DataFrame:
    """The manifest of pools: ``n`` items of each spec ``(kind, prompt_id, prompt_text, country, template, pool_seed)``, each with its id, a seed of its own, and
    the path that ``render(prompt, seed)`` gives. The model is called in the tasks, item by item of a batch."""
    plan = specs.withColumn("idx", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    plan = plan.withColumn("generator_id", F.lit(generator_id)).withColumn("image_seed", item_seed(F.col("pool_seed"), F.col("idx")))
    plan = plan.withColumn("image_id", image_id(F.col("generator_id"), F.col("prompt_id"), F.col("pool_seed"), F.col("idx")))

    @F.pandas_udf("string")
    def rendered(prompt: pd.Series, seed: pd.Series) -> pd.Series:
        return pd.Series([render(p, int(s)) for p, s in zip(prompt, seed)], dtype=object)

    return plan.withColumn("path", rendered("prompt_text", "image_seed"))


def score(items: DataFrame, model: Callable[[pd.Series, pd.Series], pd.Series], path: str = "path", text: str = "select_text") -> DataFrame:
    """``(image_id, score, text)``: the score of each item against its text, which is stored beside it so that a later join can check it."""

    @F.pandas_udf("double")
    def scored(paths: pd.Series, texts: pd.Series) -> pd.Series:
        return model(paths, texts).astype(float)

    return items.select("image_id", scored(path, text).alias("score"), F.col(text).alias("text"))


def tag(items: DataFrame, model: Callable[[pd.Series], pd.Series], path: str = "path") -> DataFrame:
    """``(image_id, reply)``: what a reader says of each item. It is given paths alone: a reader must not see scores."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"image_id": pdf["image_id"], "reply": model(pdf["path"]).astype(object)})

    return items.select("image_id", F.col(path).alias("path")).mapInPandas(run, "image_id string, reply string")


def embed(items: DataFrame, model: Callable[[pd.Series], pd.Series], path: str = "path") -> DataFrame:
    """``(image_id, embedding)`` of each item."""

    @F.pandas_udf("array<float>")
    def vectors(paths: pd.Series) -> pd.Series:
        return model(paths)

    return items.select("image_id", vectors(path).alias("embedding"))
