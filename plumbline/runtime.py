"""Session, lineage and broadcast helpers shared by every operator."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only if its serialized size is known to stay below this.
BROADCAST_LIMIT_BYTES = 64 << 20
#: Salts over which a join deals the rows of each key.
SALTS = 32


def session(app: str = "plumbline", cores: str = "8", partitions: int = 8) -> SparkSession:
    """A local session for tests and the bench; on a cluster pass your own session instead."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: the session's ``spark.checkpoint.dir``.

    Where the session has none (tests), a temporary folder is set for it, which only suits local mode.
    """
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="plumbline-")
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


#: The tables written by this process and not yet removed, and those of them that ``cached`` may give again.
_WRITTEN: list[str] = []
_CACHED: dict[tuple, DataFrame] = {}


def materialize(df: DataFrame, name: str = "part") -> DataFrame:
    """Writes ``df`` once to the shared folder and reads it back, which cuts the lineage.

    Unlike a cached block the files survive the loss of executors, and unlike an RDD checkpoint they are
    compressed columns from which later scans prune. The files stay until ``clean``, since lazy results may still read them.
    """
    path = f"{shared_dir(df.sparkSession)}/plumbline/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _WRITTEN.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cached(spark: SparkSession, key: tuple, build: Callable[[], DataFrame]) -> DataFrame:
    """The table of a key, written when first asked for in this session and read again later, until ``clean``. The key names all that
    the table depends on; its sources must not change in the meantime."""
    full = (spark.sparkContext.applicationId, *key)
    if full not in _CACHED:
        _CACHED[full] = materialize(build(), str(key[0]))
    return _CACHED[full]


def clean(spark: SparkSession) -> int:
    """Removes the tables that ``materialize`` wrote in this process; call it when no result is going to be read any more. Their number."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    removed = len(_WRITTEN)
    for path in _WRITTEN:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(conf).delete(at, True)
    _WRITTEN.clear()
    _CACHED.clear()
    return removed


def bounded_broadcast(df: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    """Hints a broadcast if ``rows`` (a proven bound) times ``row_bytes`` stays below the limit; else leaves the
    choice to the optimizer."""
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_LIMIT_BYTES else df


def salted_join(left: DataFrame, right: DataFrame, on: list[str], right_rows: int, row_bytes: int, how: str = "inner") -> DataFrame:
    """An equi-join (inner or left) to a ``right`` side of ``right_rows`` rows with different keys: broadcast if that is proven small;
    else each key is repeated for ``SALTS`` salts and the left rows are dealt over them by hash, so a key with any share of the rows
    is spread."""
    if right_rows * row_bytes <= BROADCAST_LIMIT_BYTES:
        return left.join(F.broadcast(right), on, how)
    salted = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = left.withColumn("_salt", F.pmod(F.xxhash64(*left.columns), F.lit(SALTS)).cast("int"))
    return dealt.join(salted, [*on, "_salt"], how).drop("_salt")


def rank_score(c: Column) -> Column:
    """The score with NaN mapped to NULL, so that ``DESC NULLS LAST`` puts both after every number."""
    return F.when(~F.isnan(c), c)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
