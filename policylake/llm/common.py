"""What several operators share: reading tables, and tables written to the shared checkpoint folder."""

from __future__ import annotations

import atexit
import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_written: dict[str, tuple[weakref.ref, str]] = {}
_own_root: list[str] = []


#: Rows and bytes of an Arrow batch, at most: the defaults of 10 000 rows and 64 MB are held several times over, by the JVM, on
#: the way and by the worker, and for each task; where long documents lie together, rows alone bound nothing.
BATCH_ROWS, BATCH_BYTES = 2_000, 4_000_000


def small_batches(spark: SparkSession) -> None:
    """Bound the session's Arrow batches, if they are larger."""
    rows, size = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < int(spark.conf.get(rows)) <= BATCH_ROWS:
        spark.conf.set(rows, str(BATCH_ROWS))
    given = spark.conf.get(size).removesuffix("b")  # a size in other units is set anew
    if not given.isdigit() or not 0 < int(given) <= BATCH_BYTES:
        spark.conf.set(size, f"{BATCH_BYTES}b")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, else the session's checkpoint folder. Where neither is set, a local session (tests,
    local runs) gets a temporary folder of this driver; on a cluster, whose executors have other disks, that is an error."""
    root = spark.conf.get("spark.checkpoint.dir", "")
    if not root:
        own = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = own.get() if own.isDefined() else ""
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir isn't set: tables are kept in a folder that driver and executors share")
    if not _own_root:
        _own_root.append("file://" + tempfile.mkdtemp(prefix="policylake-"))
    return _own_root[0]


def scratch_path(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder, removed by release() or when the driver ends."""
    path = f"{shared_root(spark)}/policylake-{tag}-{uuid.uuid4().hex}"
    _written[path] = (weakref.ref(spark.sparkContext), tag)
    return path


def materialize(df: DataFrame, tag: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Cut lineage: write ``df`` as Parquet to the shared folder and read it back, so that a lost executor loses no work."""
    spark = df.sparkSession
    path = scratch_path(spark, tag)
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def release(spark: SparkSession, before: set[str] | None = None) -> None:
    """Remove scratch tables: all, or those named in ``before``. Call it only when nothing lazy reads them any more."""
    for path in [p for p in _written if before is None or p in before]:
        _written.pop(path)
        _delete(spark, path)


def scratch_paths() -> set[str]:
    return set(_written)


def _at_exit() -> None:
    spark = SparkSession.getActiveSession()
    if spark is None:
        return
    try:
        release(spark)
    except Exception:  # the JVM may be gone already; nothing is left to clean with
        pass


atexit.register(_at_exit)


def row_key(id_col: str = "doc_id", text_col: str = "text") -> list:
    """Columns that name a row by content: rows alike in both are alike in every result."""
    return [F.col(id_col), F.xxhash64(F.col(text_col))]
