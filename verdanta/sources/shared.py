"""Tables that cut lineage: written to the folder that the whole cluster shares, then read again."""

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """A new folder under ``spark.checkpoint.dir``; in local mode, where all tasks share one machine, that setting may be missing."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = tempfile.gettempdir() + "/verdanta-checkpoints"
    return f"{root.rstrip('/')}/verdanta/{uuid.uuid4().hex}"


class Scratch:
    """The tables of one computation that nothing needs any more once its result is written."""

    def __init__(self):
        self.paths: list[tuple[SparkSession, str]] = []

    def stored(self, df: DataFrame) -> DataFrame:
        return stored(df, self)

    def clear(self) -> None:
        for spark, path in self.paths:
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
        self.paths = []


def stored(df: DataFrame, scratch: Scratch | None = None, codec: str = "zstd", then: Scratch | None = None) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and return a reader of that table.

    The table goes with ``scratch`` if there is one, and at the end of the application at the latest. What ``then``
    holds goes at once, since nothing but ``df`` has needed it.
    """
    spark = df.sparkSession
    path = shared_dir(spark)
    df.write.option("compression", codec).parquet(path)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    if scratch is not None:
        scratch.paths.append((spark, path))
    if then is not None:
        then.clear()
    return spark.read.schema(df.schema).parquet(path)
