"""Session helpers: settings, table reading and lineage cuts that survive lost executors."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_FALLBACK: dict[str, str] = {}


def get_session(app: str = "planloom", cores: str = "*", **conf: str) -> SparkSession:
    """A local session with the settings the library expects; on a cluster use the session given."""
    b = (
        SparkSession.builder.appName(app)
        .master(f"local[{cores}]")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
    )
    for k, v in conf.items():
        b = b.config(k, v)
    return b.getOrCreate()


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (spark.checkpoint.dir); on one machine a temporary one where it is unset."""
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if d:
        return d.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if "dir" not in _FALLBACK:
        _FALLBACK["dir"] = tempfile.mkdtemp(prefix="planloom-")
        atexit.register(shutil.rmtree, _FALLBACK["dir"], ignore_errors=True)
    return "file://" + _FALLBACK["dir"]


def _file_system(spark: SparkSession, path: str):  # noqa: ANN202
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def cut(df: DataFrame, name: str = "t", instead_of: DataFrame | None = None) -> DataFrame:
    """Write df as a table in the shared folder and read it back: lineage ends there, and the
    planner sees true sizes. The table it replaces in an iteration is deleted, the others when
    the session's process ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/planloom/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    fs, p = _file_system(spark, path)
    fs.deleteOnExit(p)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    if instead_of is not None:
        drop_cut(instead_of)
    return out


def drop_cut(df: DataFrame) -> None:
    """Delete the files of a table that cut() returned and no later step reads; other frames are left alone."""
    path = getattr(df, "_cut_path", None)
    if path:
        fs, p = _file_system(df.sparkSession, path)
        fs.delete(p, True)
        df._cut_path = None


class Scratch:
    """Tables of one computation: those that its result no longer reads are deleted by clear()."""

    def __init__(self) -> None:
        self.tables: list[DataFrame] = []

    def cut(self, df: DataFrame, name: str = "t") -> DataFrame:
        t = cut(df, name)
        self.tables.append(t)
        return t

    def clear(self) -> None:
        for t in self.tables:
            drop_cut(t)
        self.tables = []


class Rounds:
    """A table written in rounds: each round's rows are written once and all are read as one table, however many rounds there are."""

    def __init__(self, spark: SparkSession, name: str = "rounds") -> None:
        self.spark, self.path, self.n = spark, f"{shared_dir(spark)}/planloom/{name}-{uuid.uuid4().hex[:12]}", 0
        self.schema = None

    def add(self, df: DataFrame) -> DataFrame:
        """Write df and give it back as read."""
        path = f"{self.path}/r{self.n}"
        df.write.parquet(path)
        if self.schema is None:
            fs, p = _file_system(self.spark, self.path)
            fs.deleteOnExit(p)
            self.schema = df.schema
        self.n += 1
        return self.spark.read.schema(self.schema).parquet(path)

    def all(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/*")

    def drop(self) -> None:
        fs, p = _file_system(self.spark, self.path)
        fs.delete(p, True)


def spread(df: DataFrame) -> DataFrame:
    """df over as many partitions as the session has cores, where its scan has fewer; large inputs stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
