"""Sessions, input tables and the shared folder for written intermediates."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import cache

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def local_session(cores: str = "*", app: str = "tillwork", **conf: str) -> SparkSession:
    """A single-machine session for tests and the bench; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]").appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.adaptive.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


class Tables:
    """Lazy access to the parquet tables of one folder: ``Tables(spark, dir).lineitem``."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root

    def __getattr__(self, name: str) -> DataFrame:
        if name not in TABLES:
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.root}/{name}.parquet")


_RUN_FOLDERS: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir``.

    Only a local session may run without that setting; it gets a fresh folder of its own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return _local_fallback(spark.sparkContext.applicationId)


@cache
def _local_fallback(application: str) -> str:
    return tempfile.mkdtemp(prefix=f"tillwork-{application}-")


def run_folder(spark: SparkSession) -> str:
    """This application's own folder below the shared one; ``release`` or the end of the process removes it."""
    application = spark.sparkContext.applicationId
    if application not in _RUN_FOLDERS:
        folder = f"{shared_dir(spark)}/tillwork-{application}-{uuid.uuid4().hex[:8]}"
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        system = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        system.mkdirs(path)

        def remove() -> None:
            with contextlib.suppress(Exception):  # the JVM may be gone already
                system.delete(path, True)

        _RUN_FOLDERS[application] = folder
        _REMOVERS[application] = remove
        atexit.register(remove)
    return _RUN_FOLDERS[application]


_REMOVERS: dict[str, Callable[[], None]] = {}


def release(spark: SparkSession) -> None:
    """Delete every written intermediate of this application. Frames that still read them can't be used afterwards."""
    application = spark.sparkContext.applicationId
    if application in _RUN_FOLDERS:
        _REMOVERS.pop(application)()
        del _RUN_FOLDERS[application]


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{run_folder(spark)}/{label}-{uuid.uuid4().hex[:12]}"


# Fixed value: Spark removes the shuffle files of a query when it ends, instead of when the driver collects its garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Queries that run inside leave no shuffle files behind; what they wrote is all that later queries read."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


def pin(df: DataFrame, label: str = "pinned", codec: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder once and read it back.

    Cuts lineage so that several branches see the very same rows, survives the loss of executors,
    and gives the optimizer a real size for the result. The shuffle files behind it go when it is written. ``codec`` is
    for rows whose size on disk counts more than the writers' time and memory.
    """
    path = fresh_path(df.sparkSession, label)
    with shuffles_removed(df.sparkSession):
        (df.write.option("compression", codec) if codec else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def trim_driver(spark: SparkSession) -> bool:
    """Hand native memory that the driver's JVM has freed back to the system; False where the JVM has no command for it.

    The C library keeps what compiler threads and buffers free, arena by arena, so a driver that runs hundreds of small
    jobs holds the peaks of all its threads at once. The heap is not touched.
    """
    jvm, array = spark.sparkContext._jvm, spark.sparkContext._gateway.new_array
    of = jvm.java.lang.Class.forName
    try:
        kinds, given = array(jvm.java.lang.Class, 4), array(jvm.java.lang.Object, 4)
        for i, kind in enumerate(("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")):
            kinds[i] = of(kind)
        given[0], given[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        # By its interface: the class of the JVM's registry is not open to calls.
        of("javax.management.MBeanServer").getMethod("invoke", kinds).invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), given)
    except Py4JError:
        return False
    return True
