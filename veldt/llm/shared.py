"""What the operators share: the shared work folder, written tables, text columns."""

from __future__ import annotations

import atexit
import gc
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def work_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir or set as checkpoint folder, which driver and executors share."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        jdir = spark.sparkContext._jsc.sc().getCheckpointDir()
        path = jdir.get() if jdir.isDefined() else None
    if not path:
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return path.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"


_made: list[tuple[SparkSession, str]] = []


def clear(since: int = 0) -> None:
    """Removes the written tables of this process from the since-th on; results that read them must have been stored by
    then. Also runs when the driver's Python ends."""
    while len(_made) > since:
        spark, path = _made.pop()
        if spark.sparkContext._jsc is not None:
            discard(spark, path)


def stages(functions: list[tuple[str, Callable]]) -> list[tuple[str, Callable]]:
    """Stages that are called in turn, each after its predecessor's result has been stored: a stage first removes the
    tables that the one before it wrote."""
    last: list[tuple[SparkSession, str]] = []

    def clean(function: Callable) -> Callable:
        def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
            for session, path in last:
                if (session, path) in _made:
                    _made.remove((session, path))
                    discard(session, path)
            last.clear()
            release(spark)
            since = len(_made)
            out = function(spark, docs, sf_dir)
            last.extend(_made[since:])
            return out

        return run

    return [(name, clean(f)) for name, f in functions]


def written_at(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Cuts lineage: writes df as Parquet into the shared folder and reads it again; the path, for discard."""
    spark = df.sparkSession
    path = new_path(spark, name)
    if not _made:
        atexit.register(clear)
    _made.append((spark, path))
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def written(df: DataFrame, name: str) -> DataFrame:
    return written_at(df, name)[0]


def discard(spark: SparkSession, path: str) -> None:
    """Removes a table of written_at, once other written tables stand for all that was read from it."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def parts(spark: SparkSession, at_least: int = 1) -> int:
    return max(at_least, int(spark.conf.get("spark.sql.shuffle.partitions")))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(col: str = "text") -> Column:
    return F.coalesce(F.col(col), F.lit(""))


def nested(docs: DataFrame) -> DataFrame:
    """All columns as one struct named row, so that columns of any name can stand beside those a stage adds."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))


def release(spark: SparkSession) -> None:
    """Lets Spark remove shuffle files that no live DataFrame needs, once a written table stands for them."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
