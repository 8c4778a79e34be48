"""Session helpers: the shared folder for lineage cuts, working sets and a local session for tests."""

from __future__ import annotations

import tempfile
import uuid
from contextvars import ContextVar

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``.

    On a cluster this is set by the operator and read back here.  Only when it
    is unset and the master is local (unit tests, a laptop) do we create one;
    elsewhere executors would write to their own disks, so that is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError(f"set spark.checkpoint.dir to a folder that all executors share (master {master})")
        # ``spark.checkpoint.dir`` cannot be changed on a running session; the
        # context's checkpoint folder is the runtime setting, read back above.
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="segrules-ckpt-"))
        root = spark.sparkContext.getCheckpointDir()
    return root.rstrip("/")


_OWNER: ContextVar[WorkingSet | None] = ContextVar("segrules_owner", default=None)


class WorkingSet:
    """Owner of the tables, saved models and caches that a job makes on its way; releases them when it is left.

        with WorkingSet(spark) as work:
            report = work.keep(segment_steps(...))

    Inside the block every :func:`cut_lineage` and :func:`shared_path` lands in the folder of one database in the shared
    folder, and :meth:`persist` notes what it caches.  Leaving the block, by an error too, unpersists the
    caches and drops the database, its folder included; sets may be nested, each owns what is made while it is the innermost.

    Frames are lazy, so a result that still reads the set's tables would lose them: what is handed out goes
    through :meth:`keep` (rows bounded by a model or a caller's number, held by the plan itself) or
    :meth:`keep_table` (any size, a table of the set or folder around this one).
    """

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.name, self.cached = spark, f"segrules_{uuid.uuid4().hex}", []
        self.outer = _OWNER.get()
        self.folder = f"{checkpoint_root(spark)}/{self.name}"

    def __enter__(self) -> WorkingSet:
        self.spark.sql(f"CREATE DATABASE {self.name} LOCATION '{self.folder}'")
        self._token = _OWNER.set(self)
        return self

    def __exit__(self, *error: object) -> None:
        _OWNER.reset(self._token)
        for df in self.cached:
            df.unpersist()
        self.spark.sql(f"DROP DATABASE {self.name} CASCADE")

    def persist(self, df: DataFrame) -> DataFrame:
        """``df`` in executor memory, on their disks beyond it, until the set is left."""
        self.cached.append(df.persist(StorageLevel.MEMORY_AND_DISK))
        return df

    def keep(self, df: DataFrame) -> DataFrame:
        """A bounded result (a report, a node table) that outlives the set: its rows become part of the plan."""
        return self.spark.createDataFrame(df.collect(), df.schema)

    def keep_table(self, df: DataFrame, name: str = "kept") -> DataFrame:
        """A result of any size that outlives the set: written beside it, owned by the set around it, if any."""
        path = f"{self.outer.folder if self.outer else checkpoint_root(self.spark)}/{name}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        return self.spark.read.parquet(path)


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique path under the shared checkpoint folder, or under the working set's part of it."""
    owner = _OWNER.get()
    return f"{owner.folder if owner else checkpoint_root(spark)}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame, name: str = "cut", file_rows: int | None = None) -> DataFrame:
    """Write ``df`` as a parquet table in the shared folder and scan it back.

    Survives executor loss (the data is in shared storage, not in executor
    memory or on a local disk) and keeps later plans short.  Unlike an RDD
    checkpoint the table is columnar and compressed, and later reads prune
    columns and push filters into the scan.  ``file_rows`` bounds the rows of a file.
    """
    spark = df.sparkSession
    path = shared_path(spark, name)
    writer = df.write.mode("overwrite")
    (writer.option("maxRecordsPerFile", file_rows) if file_rows else writer).parquet(path)
    return spark.read.parquet(path)


def local_session(
    cores: int | str = "*", partitions: int = 8, app: str = "segrules", extra: dict[str, str] | None = None
) -> SparkSession:
    """Session for tests and the local bench; production callers pass their own."""
    builder = SparkSession.builder
    for k, v in (extra or {}).items():
        builder = builder.config(k, v)
    spark = (
        builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_root(spark)
    return spark
