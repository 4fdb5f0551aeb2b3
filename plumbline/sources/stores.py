"""Readers and writers of item stores: JSON lines, CSV, vocabulary JSON, wide photo tables, result documents."""

from __future__ import annotations

import ast
import io
import json
import math
import tarfile
from collections.abc import Iterator
from dataclasses import MISSING, dataclass, field, fields
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

MANIFEST = (
    "image_id string, generator_id string, kind string, prompt_id string, country string, template string, pool_seed bigint, idx int, "
    "image_seed bigint, gen_prompt string, select_text string, dish string, path string"
)
SCORES = "image_id string, score double, text string"
TAGS = "image_id string, reply string, dish string, country string"
VERIFY = (
    "image_id string, dish string, option_list array<string>, true_pos int, p_choice array<double>, chosen int, kept boolean, p_yes double, "
    "decoy string, p_yes_decoy double"
)
EMBED = "image_id string, embedding array<float>"


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path of any file system is there."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def read_jsonl(spark: SparkSession, path: str, schema: str, torn_tail: bool = True) -> DataFrame:
    """A JSON-lines store under an explicit schema (DDL). Blank lines are skipped, a missing path is an empty store. A bad line is an error, but
    for one at the very end of a file without a final newline, which an interrupted writer leaves, if ``torn_tail``.

    The store may lie in any file system Spark reads; of a file with a bad line only as many bytes at its end are read as the line has.
    """
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_file")).where(F.trim("value") != "")
    parsed = lines.select("value", "_file", F.from_json("value", f"{schema}, _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"}).alias("r"))
    rotten = F.col("r").isNull() | F.col("r._corrupt").isNotNull()
    wrong = parsed.where(rotten).select("value", "_file").limit(2).collect()
    if wrong and not (torn_tail and len(wrong) == 1 and _ends_with(spark, wrong[0]["_file"], wrong[0]["value"].encode())):
        raise ValueError(f"{path}: not JSON: {wrong[0]['value'][:80]}")
    return parsed.where(~rotten).select("r.*").drop("_corrupt")


def _ends_with(spark: SparkSession, path: str, tail: bytes) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    size = files.getFileStatus(at).getLen()
    stream = files.open(at)
    try:
        stream.seek(max(0, size - len(tail)))
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)) == tail
    finally:
        stream.close()


def append_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def read_vocabulary(spark: SparkSession, path: str, least: float | None = None) -> DataFrame:
    """``(country, name, kb_prominence)`` of a vocabulary document, by country and name, at or above ``least`` if given."""
    schema = "vocab map<string,array<string>>, kb_prominence map<string,map<string,double>>"
    doc = spark.read.schema(schema).option("multiLine", True).json(path)
    names = doc.select(F.explode("vocab").alias("country", "names"), "kb_prominence").select("country", F.explode("names").alias("name"), "kb_prominence")
    prominence = F.try_element_at(F.try_element_at(F.col("kb_prominence"), F.col("country")), F.col("name"))
    out = names.select("country", "name", prominence.alias("kb_prominence"))
    return (out.where(F.col("kb_prominence") >= least) if least is not None else out).orderBy("country", "name")


def read_annotations(spark: SparkSession, path: str) -> DataFrame:
    """``(image_id, country, artifact)`` of adjudicated rows of an annotation sheet; an empty artifact is ``unresolved``. Missing columns, blank and repeated
    ids are errors."""
    df = spark.read.option("header", True).csv(path)
    lacking = {"image_id", "country", "artifact"} - set(df.columns)
    if lacking:
        raise ValueError(f"{path}: no column {', '.join(sorted(lacking))}")
    text = lambda c: F.trim(F.coalesce(F.col(c), F.lit("")))
    if "adjudicated" in df.columns:
        df = df.where(F.lower(text("adjudicated")).isin("yes", "y", "true", "1"))
    out = df.select(text("image_id").alias("image_id"), text("country").alias("country"), F.coalesce(F.nullif(text("artifact"), F.lit("")), F.lit("unresolved")).alias("artifact"))
    wrong = out.groupBy("image_id").count().where("image_id = '' OR count > 1").limit(3).collect()
    if wrong:
        raise ValueError(f"{path}: blank or repeated image_id: {[r['image_id'] for r in wrong]}")
    return out


def write_annotation_template(df: DataFrame, path: str) -> None:
    """A sheet to be filled in by annotators who must not see scores."""
    blank = ["artifact", "annotator_a", "annotator_b", "adjudicated", "notes"]
    df.select("image_id", "country", "prompt_id", "path", *[F.lit("").alias(c) for c in blank]).write.mode("overwrite").option("header", True).csv(path)


def unpivot_photos(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row an image from a table with an image column each; null images are left out."""
    ids = [c for c in df.columns if c not in columns]
    return df.unpivot(ids, columns, "slot", "image").where("image IS NOT NULL")


@F.pandas_udf(ArrayType(StringType()))
def parse_aliases(s: pd.Series) -> pd.Series:
    """The strings of a Python literal: a list of strings, or of dictionaries with one under ``name`` or ``value``."""

    def one(text: str | None) -> list[str]:
        try:
            value = ast.literal_eval(text) if text else []
        except (ValueError, SyntaxError):
            return []
        flat = []
        for x in value if isinstance(value, (list, tuple)) else [value]:
            flat += [v for v in (x.get("name"), x.get("value")) if isinstance(v, str)][:1] if isinstance(x, dict) else [x] if isinstance(x, str) else []
        return flat

    return s.map(one)


def only_country(column: str, names: list[str]):
    """Rows whose countries, an array in JSON or a single name, are exactly one of ``names``."""
    listed = F.from_json(column, "array<string>")
    c = F.coalesce(listed, F.array(column))
    return (F.size(c) == 1) & F.get(c, F.lit(0)).isin(names)


def plain(value):
    """A value for JSON: numbers that are not finite become null, tuples lists, keys text."""
    if isinstance(value, float):
        return value if math.isfinite(value) else None
    if isinstance(value, dict):
        return {"|".join(map(str, k)) if isinstance(k, tuple) else str(k): plain(v) for k, v in value.items()}
    if isinstance(value, (list, tuple, set)):
        return [plain(v) for v in (sorted(value, key=str) if isinstance(value, set) else value)]
    return value


def write_result(document: dict, path: str) -> None:
    """Merges a result document into the one at ``path`` if both have the same provenance; else refuses. NaN and infinite numbers become null."""
    p = Path(path)
    old = json.loads(p.read_text()) if p.exists() else {}
    if old and old.get("provenance") != plain(document.get("provenance")):
        raise ValueError(f"{path} holds results of another provenance")
    p.write_text(json.dumps(old | plain(document), indent=1, sort_keys=True, default=str))


def read_results(spark: SparkSession, folder: str) -> DataFrame:
    """``(file, generator, document)`` of a folder's JSON documents that name a generator; none at all is an error."""
    docs = spark.read.option("pathGlobFilter", "*.json").text(folder, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.col("value").alias("document"))
    found = docs.select("file", F.get_json_object("document", "$.generator").alias("generator"), "document").where("generator IS NOT NULL")
    if not found.limit(1).count():
        raise ValueError(f"{folder}: no result document")
    return found


def write_vectors(df: DataFrame, path: str) -> bool:
    """Writes ``(image_id, embedding)`` unless the store at ``path`` already has all its ids; whether it wrote."""
    spark = df.sparkSession
    if exists(spark, path):
        if df.select("image_id").join(spark.read.parquet(path).select("image_id"), "image_id", "left_anti").limit(1).count() == 0:
            return False
        have = spark.read.parquet(path).select("image_id")
        df = df.join(have, "image_id", "left_anti")
    df.select("image_id", F.col("embedding").cast("array<float>").alias("embedding")).write.mode("append").parquet(path)
    return True


def read_knowledge(spark: SparkSession, path: str, schema: str, member: str = ".json") -> DataFrame:
    """Knowledge records from a JSON document that is a list: the document, an archive (.tar.gz) that holds it, or a folder with such an archive.

    Archives are opened by the executors, one a task; hidden members are skipped. Each record follows ``schema`` (DDL).
    """
    docs = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "content")

    def open_all(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = []
            for name, raw in zip(pdf["path"], pdf["content"]):
                if name.endswith((".tar.gz", ".tgz")):
                    with tarfile.open(fileobj=io.BytesIO(raw), mode="r:gz") as archive:
                        inside = [m for m in archive.getmembers() if m.isfile() and m.name.endswith(member) and not m.name.rpartition("/")[2].startswith(".")]
                        texts += [archive.extractfile(m).read().decode() for m in inside]
                elif name.endswith(".json"):
                    texts.append(raw.decode())
            rows = [json.dumps(x) for t in texts for x in json.loads(t)]
            yield pd.DataFrame({"record": pd.Series(rows, dtype=object)})

    return docs.mapInPandas(open_all, "record string").select(F.from_json("record", schema).alias("r")).select("r.*")


def read_prompts(spark: SparkSession, path: str) -> DataFrame:
    """``(prompt_id, text, country, domain, template)`` of a prompt document, a list of objects; prompts without text are left out."""
    schema = "prompt_id string, text string, country string, domain string, template string"
    return spark.read.schema(schema).option("multiLine", True).json(path).where("text IS NOT NULL")


def reader_path(root: str, part: str, tag: str, reader: str | None, plain_reader: str = "qwen") -> str:
    """Where a reader's rows lie: the registered reader under the plain name, any other beside it under its own."""
    name = tag if reader in (None, plain_reader) else f"{tag}__{reader}"
    return f"{root}/{part}/{name}.jsonl"


@dataclass
class RunConfig:
    """A study's design, checked before anything runs. ``warnings`` holds what is allowed but weakens a claim."""

    domain: str
    countries: list[str]
    templates: list[str]
    n: int
    n_pools: int
    k: int
    m_auth: int
    secondary_k: list[int] = field(default_factory=list)
    generators: list[dict] = field(default_factory=list)
    known_label: dict = field(default_factory=dict)
    tune: dict = field(default_factory=dict)
    warnings: list[str] = field(default_factory=list)

    #: Countries below which no verdict is taken, and pools a country below which the test of differences is not calibrated.
    MIN_COUNTRIES, MIN_POOLS = 4, 8

    def __post_init__(self):
        for name in ("n", "n_pools", "k", "m_auth"):
            v = getattr(self, name)
            if isinstance(v, bool) or not isinstance(v, int) or v < 1:
                raise ValueError(f"{name} must be a positive integer")
        if self.k > self.n:
            raise ValueError(f"k = {self.k} exceeds the pool size n = {self.n}")
        if self.m_auth > self.k:
            raise ValueError(f"m_auth = {self.m_auth} exceeds k = {self.k}")
        self.secondary_k = [self.secondary_k] if isinstance(self.secondary_k, int) else list(self.secondary_k or [])
        if any(x > self.n for x in self.secondary_k):
            raise ValueError(f"a secondary_k exceeds n = {self.n}")
        if len(set(self.countries)) != len(self.countries):
            raise ValueError("a country is given twice")
        if len(self.countries) < self.MIN_COUNTRIES:
            raise ValueError(f"{len(self.countries)} countries; at least {self.MIN_COUNTRIES} are needed")
        if len(self.templates) * self.n_pools < self.MIN_POOLS:
            self.warnings.append(f"fewer than {self.MIN_POOLS} pools a country: differences between countries are underpowered")
        if not self.known_label.get("pools_per_country"):
            self.warnings.append("no known labels: the reader cannot be checked")

    @classmethod
    def of(cls, document: dict) -> RunConfig:
        """From a parsed document; unknown keys are ignored, missing required ones are an error."""
        names = {f.name: f for f in fields(cls)}
        lacking = [n for n, f in names.items() if f.default is MISSING and f.default_factory is MISSING and n not in document]
        if lacking:
            raise ValueError(f"missing keys: {', '.join(lacking)}")
        return cls(**{k: v for k, v in document.items() if k in names and k != "warnings" and v is not None})

    def budget(self) -> dict:
        """How many images the design takes."""
        models, prompts, size = max(1, len(self.generators)), len(self.countries) * len(self.templates), len(self.countries) * self.n
        each = prompts * self.n_pools * self.n
        return {
            "prompts": prompts, "images_per_model": each, "models": models, "images": each * models, "pools_per_country": len(self.templates) * self.n_pools,
            "known_images": self.known_label.get("pools_per_country", 0) * size * models, "tuning_images": self.tune.get("pools_per_country", 0) * size * models,
        }
