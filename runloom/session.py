"""Session helpers: settings and the shared folder for intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "runloom", cores: int | None = None, **conf: str) -> SparkSession:
    """A local session for tests and benches. On a cluster, bring your own."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
    )
    if cores:
        builder = builder.master(f"local[{cores}]").config("spark.sql.shuffle.partitions", str(cores))
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach, from `spark.checkpoint.dir`.

    Only a local session without the setting gets a folder of its own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors can reach")
    folder = tempfile.mkdtemp(prefix="runloom-")
    spark.sparkContext.setCheckpointDir(folder)
    return spark.sparkContext.getCheckpointDir()


def park(df: DataFrame, name: str = "table") -> DataFrame:
    """Write an intermediate table once and read it back.

    Cuts the lineage, survives executor loss, and gives the planner the true
    size, so that Spark broadcasts it only when it is small.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/runloom/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of a table that `sized` lets Spark broadcast.
BROADCAST_ROWS = 1 << 20


def sized(parked: DataFrame) -> DataFrame:
    """A parked table of narrow rows as one side of a join: broadcast up to a number of rows, else sorted and merged.

    Counting reads the files' footers only. Their size says little: Parquet of repeated
    values takes a hundredth of the memory that a broadcast of them would take on the driver.
    """
    few = parked.count() <= BROADCAST_ROWS
    return parked.hint("broadcast" if few else "merge")


class Shelf:
    """Owner of intermediate tables: parks them and removes their files when they are done with.

    Use it as a context around work whose result is written before the context
    ends; a table must not be dropped while a plan that reads it is still to run.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.held: dict[int, tuple[DataFrame, str]] = {}

    def __enter__(self) -> Shelf:
        return self

    def __exit__(self, *failure) -> None:
        for df, _ in list(self.held.values()):
            self.drop(df)

    def put(self, df: DataFrame, name: str = "table") -> DataFrame:
        path = f"{shared_folder(self.spark)}/runloom/{name}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        parked = self.spark.read.schema(df.schema).parquet(path)
        self.held[id(parked)] = (parked, path)
        return parked

    def drop(self, *tables: DataFrame) -> None:
        for df in tables:
            _, path = self.held.pop(id(df))
            place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(place, True)
