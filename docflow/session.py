"""Session settings and shared storage used by every operator."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", partitions: int = 8) -> SparkSession:
    """A local session for tests and benches; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("docflow")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    A cluster names it in ``spark.checkpoint.dir``. Only where that is unset
    (local tests) a temporary folder is made and set.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isDefined():
        return str(context._jsc.sc().getCheckpointDir().get()).rstrip("/")
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="docflow-"))
    return str(context._jsc.sc().getCheckpointDir().get()).rstrip("/")


def cut(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage like ``checkpoint()``, keeps Parquet's column pruning and
    sizes, and survives the loss of any executor.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/docflow-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._docflow_path = path
    return out


def drop_cut(df: DataFrame) -> None:
    """Delete the files of a table made by :func:`cut` that nothing reads any more."""
    path = getattr(df, "_docflow_path", None)
    if path:
        jvm, spark = df.sparkSession._jvm, df.sparkSession
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(target, True)


def forget(spark: SparkSession) -> None:
    """Let the driver give up plans, shuffles and memory that nothing uses any more, which a loop of many small plans gathers."""
    gc.collect()
    spark._jvm.System.gc()
    with contextlib.suppress(AttributeError, OSError):  # glibc alone keeps freed blocks, and has the call to return them
        ctypes.CDLL(None).malloc_trim(0)
    with contextlib.suppress(Py4JError):  # the same for the JVM's own blocks; an older or other JVM has no such command
        trim_jvm(spark)


def trim_jvm(spark: SparkSession) -> str:
    """Let the driver's JVM return the blocks outside its heap that it has freed; what it says of them."""
    jvm = spark._jvm
    beans = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()
    # By reflection, as the server's class is hidden and its interface is not.
    call = next(m for m in jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() == "invoke")
    given = spark.sparkContext._gateway.new_array(jvm.java.lang.Object, 4)
    given[0], given[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
    return call.invoke(beans, given)


def bounded_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Let Python workers take ``rows`` rows at a time, so that long texts do not fill their memory."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables below ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
