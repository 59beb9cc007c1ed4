"""Getting this package to the executors, and tables in the folder they share."""

from __future__ import annotations

import atexit
import pathlib
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

#: Bytes in one Arrow batch sent to Python.  Texts are long, and JVM and worker each hold copies of a batch; Spark's own limit is 64 MB.
BATCH_LIMIT, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "8m"

_shipped: set[str] = set()
_own: dict[str, str] = {}


def ship(spark: SparkSession) -> None:
    """Send the package once per application, so that its functions can be imported wherever tasks run.

    Batches for Python are kept small, unless the session has a limit of its own.
    """
    if BATCH_LIMIT not in spark.conf.getAll:
        spark.conf.set(BATCH_LIMIT, BATCH_BYTES)
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    here = pathlib.Path(__file__).parent
    target = pathlib.Path(tempfile.mkdtemp(prefix="glyphmill-")) / "glyphmill_package.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(here.rglob("*.py")):
            z.write(p, p.relative_to(here.parent))
    spark.sparkContext.addPyFile(str(target))
    _shipped.add(app)


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (``spark.checkpoint.dir``).

    Where it is unset a local session gets one of its own; on a cluster that is an error, as executors share no local folder.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        app = spark.sparkContext.applicationId
        if app not in _own:
            _own[app] = tempfile.mkdtemp(prefix="glyphmill-checkpoint-")
        found = _own[app]
    return found.rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    try:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # noqa: BLE001  the session may be gone by then
        pass


def scratch(df: DataFrame, name: str) -> DataFrame:
    """Write the rows as Parquet into the shared folder and read them back: cut lineage that outlives executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/glyphmill/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    atexit.register(_remove, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def spread(spark: SparkSession) -> int:
    """Partitions for work that every core should have a share of."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)


def drop_scratch(*frames: DataFrame) -> None:
    """Remove scratch tables that no later step reads."""
    for df in frames:
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles() if "/glyphmill/" in f}:
            _remove(df.sparkSession, folder)
