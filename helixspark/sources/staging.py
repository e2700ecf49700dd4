"""Tables kept between steps of a job, in the folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
_made: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; a temporary one of our own only where that is unset and Spark runs in this process (local tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="helixspark-")
    return _own[app]


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses; it is removed when the driver ends."""
    path = f"{shared_dir(spark)}/helixspark-{name}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _clean() -> None:
    for spark, path in _made:
        try:
            remove(spark, path)
        except Exception:  # noqa: BLE001  the session may be gone already
            continue


class Stage:
    """A DataFrame written as Parquet in the shared folder: cuts lineage, survives lost executors, is computed once."""

    def __init__(self, df: DataFrame, name: str, codec: str = "zstd"):
        self.spark, self.path = df.sparkSession, new_path(df.sparkSession, name)
        df.write.option("compression", codec).parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        remove(self.spark, self.path)


def staged(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    return Stage(df, name, codec).df


class Grown:
    """A table that grows by whole parts; all of it is one scan, however many parts it has."""

    def __init__(self, first: DataFrame, name: str):
        self.spark, self.schema, self.path = first.sparkSession, first.schema, new_path(first.sparkSession, name)
        self.parts: list[str] = []
        self.add(first)

    def add(self, part: DataFrame) -> DataFrame:
        """Writes a part and gives it back as it was written."""
        at = f"{self.path}/part-{len(self.parts):04d}"
        part.select(self.schema.names).write.option("compression", "zstd").parquet(at)
        self.parts.append(at)
        return self.spark.read.schema(self.schema).parquet(at)

    @property
    def df(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*self.parts)
